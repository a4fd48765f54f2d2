"""DuckDB SQL for the queries whose results SQL can say."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS MATERIALIZED (
  SELECT c.a, c.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY 1, 2) c
  JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) m USING (doc_id)
"""

_ESCAPED = r"replace(replace({0}, '\', '\\'), '<|', '<\|')"
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT *, sum(length('<|im_start|>') + length(replace({_ESCAPED.format('role')}, chr(10), '\n')) + 1 + length({_ESCAPED.format('text')})
                    + length('<|im_end|>') + 1) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS turns,
             coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss,
             sum(upto) FILTER (role = 'assistant' OR k = n) AS formatted FROM f GROUP BY 1)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM g
"""

RANGE_JOIN = """
WITH RECURSIVE v AS (SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
e AS MATERIALIZED (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v
  WHERE len(v) > 0 AND len([x FOR x IN v IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN v IF x <> 0]) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT v.vec_id, CAST((SELECT count(*) FROM l WHERE l.a = v.vec_id) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c USING (vec_id)
"""

WARC = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
w AS (SELECT *, n >= 1000 AND page_id < max(page_id) OVER (PARTITION BY digest) AS again, max(page_id) OVER (PARTITION BY digest) AS last FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN last END AS refers_to FROM w
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM d WHERE n >= 50) x),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY w) AS again FROM s) x WHERE again),
b AS (SELECT x.doc_id, x.p, x.c, f.i IS NOT NULL AS begun FROM
      (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS c FROM (SELECT doc_id, h, unnest(range(n)) AS p FROM d) y) x LEFT JOIN f ON f.doc_id = x.doc_id AND f.i = x.p),
g AS (SELECT doc_id, p, c, bool_or(begun) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM b),
k AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY doc_id ORDER BY p) AS first FROM g),
a AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (first) AS n_spans, string_agg(c, '' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, CAST(d.n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""

RESAMPLING = rf"""
WITH RECURSIVE t AS (SELECT 0 AS which, doc_id, coalesce(text, '') AS text FROM documents
           UNION ALL SELECT 1, NULL, coalesce(text, '') FROM benchmark),
w AS MATERIALIZED (SELECT which, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
f AS MATERIALIZED (
  SELECT which, doc_id, f, count(*) AS k FROM (
    SELECT which, doc_id, unnest(w) AS f FROM w
    UNION ALL SELECT which, doc_id, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
    UNION ALL SELECT which, doc_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w) x
  GROUP BY 1, 2, 3),
entry(b, k, c) AS (SELECT b, 0, b FROM range(256) r(b)
                   UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM entry WHERE k < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM entry WHERE k = 8),
h AS MATERIALIZED (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f) y),
step(f, h, n, i, c) AS (
  SELECT f, h, length(h) // 2, 0, 4294967295::BIGINT FROM h
  UNION ALL
  SELECT f, h, n, i + 1, xor(tab[(xor(c, ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) & 255) + 1], c >> 8) FROM step, tab WHERE i < n),
b AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE i = n),
n AS (SELECT bucket, sum(k) FILTER (which = 0) AS s, sum(k) FILTER (which = 1) AS t FROM f JOIN b USING (f) GROUP BY 1),
g AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce(sum(s) OVER (), 0) + 10000)::DOUBLE
                  / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce(sum(t) OVER (), 0) + 10000)::DOUBLE))) AS BIGINT) AS gain FROM n),
d AS (SELECT doc_id, sum(k) AS n_features, sum(k * gain) AS weight FROM f JOIN b USING (f) JOIN g USING (bucket) WHERE which = 0 GROUP BY 1),
r AS (SELECT w.doc_id, len(w) >= 20 AS able, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
      FROM w LEFT JOIN d USING (doc_id) WHERE which = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY able) AS all_able FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * all_able // 100 THEN k END AS rank FROM o
"""

SQL = {"op4_ngram_jaccard": JACCARD, "op6_prefix_target_chat": CHAT, "op7_metric_range_join": RANGE_JOIN, "op8_indexed_warc": WARC, "op10_suffix_repeats": REPEATS,
       "op13_overlapped_resampling": RESAMPLING}
