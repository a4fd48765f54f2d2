"""Personal data: base spans against the plain patterns, added spans by what they must and must not touch."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortline.llm import pii, queries

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+".replace("\\x20-", "\\x20\\-"),
         r"\+[0-9][\x20().0-9-]+[0-9]"]


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(x) <= 255 for x in m[0].split(".")) if kind == 1 else True, 13 <= len(number) <= 19 and luhn(number), 9 <= len(number) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return tuple(sorted(out))


def base_of(rows):
    return Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.base)) for r in rows)


def card(rng, n=16):
    body = [str(rng.randint(1, 9)) for _ in range(n - 1)]
    return next("".join(body) + str(k) for k in range(10) if luhn("".join(body) + str(k)))


ODD = ["", None, " ", "a@b.c@d.e", "x@y.z@w.v", "a@b.c_d@e.f", "@a.b", "a@b", "a@b.", "me@x-y.co.uk.", "é@a.b", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.0.0.1", "1.2.3", "00000001.2.3.4",
       "+1 (743) 555-3824", "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7", "++1 234 567 890", "12 +3456789012 34", "+ 123456789", "+1-2+345678901", "4111 1111 1111 1111", "4111-1111-1111-1111.",
       "4111  1111 1111 1111", "🙂 4111111111111111 🙂 b@c.de", "1" * 13, "0" * 16, "0" * 5000, "1 " * 4000, "9." * 3000, "+" * 3000, "(" * 2000 + "1" + ")" * 2000, "a" * 20000 + "@b.c", "@" * 2000,
       "1234-5678+12345678901", "\n+1 234\n567 890\n", "12345\t6789012345678", "tel +49 30 (123) 45-67 89 mail", "x1.2.3.4y", "-1-2-3-4-5-6-7-8-9-0-1-2-3-"]


def test_base_spans_of_odd_texts(spark):
    rng = random.Random(8)
    signs = "0123456789" * 2 + "  ..--()+@@ab%_é\n,"
    texts = ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    texts += [f"call +{rng.randint(1, 99)} {rng.randint(100, 999)} {rng.randint(1000, 99999)}, card {card(rng)} at 10.{rng.randint(0, 300)}.0.1, a{rng.randint(1, 9)}@b.com" for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, "no id a@b.cd"), (3, "again a@b.cd"), (3, "again a@b.cd")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, `a.b` long").repartition(3)
    found = pii.find(docs).collect()
    assert base_of(found) == Counter((d, plain(t)) for d, t in rows)
    for r in found:
        base = [s for s in r.spans if s.base]
        added = sorted((s.start, s.end) for s in r.spans if not s.base)
        assert all(s.end <= a or e <= s.start for s in base for a, e in added)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:]))


def planted(rng, n):
    """Texts with valid and invalid numbers, and phones in local form, in prose."""
    words = ["some", "words", "that", "stand", "here", "without", "any", "meaning"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        what = (f"+1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}", f"+{rng.randint(1, 9)}{rng.randint(10, 99)}{rng.randint(100, 999)}",
                card(rng), str(rng.randint(10 ** 15, 10 ** 16 - 1)), f"{rng.randint(1, 255)}.{rng.randint(0, 255)}.1.{rng.randint(0, 255)}", f"{rng.randint(300, 900)}.1.{rng.randint(300, 900)}.4",
                f"who.{i}@mail.example.com", f"who{i}@local")[i % 8]
        rows.append((i, f"{prose(5)} {what} {prose(5)}"))
    return rows


def test_trees_add_what_looks_alike(spark):
    rng = random.Random(2)
    rows = planted(rng, 2400)
    local = [(10_000 + k, f"some words that ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} stand here") for k in range(20)]
    clean = [(20_000 + k, f"in the year {1900 + k} there were {k} of 1234 and 3.14 and 2020-01-{k % 28 + 1:02}") for k in range(40)]
    found = {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(rows + local + clean, "doc_id long, text string")).collect()}
    assert sum(any(s.kind == 3 for s in found[d]) for d, _ in local) >= 18  # no plus sign: none is a base span
    assert not any(s.base for d, _ in local for s in found[d])
    assert not any(found[d] for d, _ in clean)


def test_thresholds():
    assert pii.threshold([(90, 30, 30), (50, 10, 12), (10, 0, 40)]) == 0.9
    assert pii.threshold([(90, 30, 30), (10, 0, 5)]) == pii.UNCALIBRATED
    assert pii.threshold([(99, 10, 40), (50, 30, 60)]) > 1


def test_query_digests(spark, tmp_path, corpus):
    rows = planted(random.Random(4), 80)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op11_boosted_candidates(spark, str(tmp_path)).collect():
        own = plain(dict(rows)[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in own)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in own) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_native_and_odd_tables(spark, corpus, nothing):
    assert pii.find(nothing).count() == 0
    found = pii.find(corpus)
    assert found.count() == corpus.count()
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("columns", ["doc_id long, text string, `a.b` long, row string"])
def test_redacted_rows_keep_all_columns(spark, columns):
    docs = spark.createDataFrame([(1, "mail a@b.cd now 10.0.0.1", 1, "r"), (1, None, 2, "r"), (None, "+1 234 567 890", 3, None), (2, "nothing", 4, "")], columns)
    out = pii.redact(docs)
    assert out.schema == docs.schema
    assert Counter(map(tuple, out.collect())) == Counter([(1, "mail [email] now [ip]", 1, "r"), (1, None, 2, "r"), (None, "[phone]", 3, None), (2, "nothing", 4, "")])


def test_trees_and_thresholds_come_from_all_decided_candidates(spark, monkeypatch):
    n, seen, told = 130_000, {}, {}
    rows = spark.range(n).select(
        F.lit(0).alias("kind"), F.lit(True).alias("decided"), (F.col("id") % 2 == 0).alias("passes"), F.col("id").alias("draw"),
        *[(F.col("id") % (i + 2)).cast("double").alias(c) for i, c in enumerate(pii.FEATURES[1:])], F.lit(0.0).alias("f_kind"))
    fit = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", lambda self, df: seen.setdefault("rows", df.agg(F.sum("weight")).first()[0]) and fit(self, df))
    monkeypatch.setattr(pii, "threshold", lambda steps: told.setdefault(len(told), sum(s[2] for s in steps)))
    pii.boosted(rows)
    assert seen["rows"] == n - n // pii.HELD_OUT and told[0] == n // pii.HELD_OUT
