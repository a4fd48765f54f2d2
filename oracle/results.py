"""SQL for operations on results, coverage, retrieval and name resolution."""

from __future__ import annotations

from cohortline.operators.resolve import CUTOFFS, PLACES, WHOLE_STATE
from workload.results import ALIASES, ENTITY_ALIASES, FIXED_ENTITIES, GRID, HELD, WRITTEN

from .catalogue import CARE, CD, SQL as CATALOGUE, summary
from .model import complete, rounded

_S = f"(SELECT * FROM ({CATALOGUE['D18']}) d WHERE district_name IS NOT NULL) s"
_SIZE = GRID["pixel_deg"] * 50
CELLS = (f"(SELECT r, c, pop, ROUND({GRID['origin_lat']}::DOUBLE - (r + 0.5) * {_SIZE}::DOUBLE, 4) AS lat, ROUND({GRID['origin_lng']}::DOUBLE + (c + 0.5) * {_SIZE}::DOUBLE, 4) AS lng FROM "
         "(SELECT CAST(floor(rw / 50) AS BIGINT) AS r, CAST(floor(cl / 50) AS BIGINT) AS c, CAST(SUM(pop) AS BIGINT) AS pop FROM (SELECT (c_custkey * 7) % 613 AS rw, (c_custkey * 13) % 727 AS cl, "
         f"floor(abs(c_acctbal)) AS pop FROM customer) p WHERE rw < {GRID['height'] // 50 * 50} AND cl < {GRID['width'] // 50 * 50} GROUP BY 1, 2) x WHERE pop >= 10)")


def km(a: str, b: str, c: str, d: str) -> str:
    h = f"(power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))"
    return f"(6371.0::DOUBLE * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


SITES = ("(SELECT 24.0::DOUBLE + (s_suppkey * 37 % 113) / 20.0::DOUBLE AS slat, 77.0::DOUBLE + (s_suppkey * 53 % 131) / 18.0::DOUBLE AS slng, (s_suppkey % 10 + 1) / 10.0::DOUBLE AS strength FROM "
         "supplier JOIN hm_specialty_offered ON hospital_id = 'HS' || s_suppkey WHERE specialty_code = 'SP2')")
_D = km("lat", "lng", "slat", "slng")
_NEAR = f"(SELECT r, c, pop, lat, lng, MIN({_D}) AS dist_km FROM {CELLS} k, {SITES} s GROUP BY 1, 2, 3, 4, 5)"
_COS = ("WITH mean AS (SELECT label, i, AVG(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, generate_series(1, 64) g(i) GROUP BY 1, 2), q AS (SELECT label AS query_id, list(m ORDER BY i) AS v, "
        "sqrt(SUM(m * m)) AS n FROM mean GROUP BY 1), e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings), sc AS (SELECT query_id, vec_id AS entry_id, label, "
        "list_dot_product(q.v, e.v) / (q.n * sqrt(list_dot_product(e.v, e.v))) AS score FROM q, e), rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY ROUND(score, 12) DESC, entry_id) AS "
        "rank FROM sc)").replace(" sc AS", " cosine AS").replace("FROM sc)", "FROM cosine)")
_GOLD = (_COS + ", gr AS (SELECT g.query_id, CAST(COUNT(CASE WHEN s.score > g.score + 1e-12 THEN 1 END) AS BIGINT) AS rank FROM (SELECT query_id, score FROM cosine c JOIN (SELECT label, MIN(vec_id) AS gid "
         "FROM embeddings GROUP BY 1) m ON m.label = c.query_id AND m.gid = c.entry_id) g JOIN cosine s ON s.query_id = g.query_id GROUP BY 1), ls AS (SELECT list(rank ORDER BY rank) AS r, COUNT(*) AS n FROM gr)")


def _at(p: float) -> str:
    return f"(SELECT r[LEAST(n - 1, CAST(floor(n * {p}) AS BIGINT)) + 1] FROM ls)"


_WRITTEN = ("(SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN n_name WHEN 1 THEN ' ' || lower(n_name) || ' ' WHEN 2 THEN 'Seven' WHEN 3 THEN substr(n_name, 2, 20) WHEN 4 THEN n_name || 'x' ELSE c_mktsegment END "
            "AS raw FROM customer JOIN nation ON c_nationkey = n_nationkey)")
_SIM = "1 - levenshtein(lower(trim(raw)), lower(n_name)) / CAST(GREATEST(length(trim(raw)), length(n_name)) AS DOUBLE)"
_ALIAS = "CASE lower(trim(raw)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIASES.items()) + " END"
_ASKED = "(" + " UNION ALL ".join(f"SELECT DISTINCT '{kind}' AS entity_type, {said} AS raw FROM {table}" for kind, (table, said) in WRITTEN.items()) + ")"
_HELD = ("(" + " UNION ALL ".join(f"SELECT DISTINCT '{kind}' AS entity_type, {column} AS value FROM {table} WHERE {column} IS NOT NULL" for kind, (table, column) in HELD.items())
         + "".join(f" UNION ALL SELECT '{kind}', '{v}'" for kind, fixed in FIXED_ENTITIES.items() for v in fixed) + ")")


def _grams(x: str) -> str:
    return f"list_distinct([substr('^' || {x} || '$', i, 2) FOR i IN range(1, length({x}) + 2)])"


def _resolved(asked: str, held: str, aliases: dict, cutoffs: dict) -> str:
    """Every open name against every name of its type."""
    alias = "CASE " + " ".join(f"WHEN entity_type = {k!r} AND norm = '{n.lower()}' THEN '{v}'" for k, table in aliases.items() for n, v in table.items()) + " END"
    cutoff = "CASE entity_type " + " ".join(f"WHEN {k!r} THEN {v}" for k, v in cutoffs.items()) + " ELSE 85 END"
    refused = f"entity_type IN {PLACES} AND norm IN {WHOLE_STATE}" if 0 not in cutoffs else "FALSE"
    return (f"WITH w AS (SELECT *, lower(trim(raw)) AS norm FROM {asked} a WHERE raw IS NOT NULL), h AS (SELECT entity_type, lower(value) AS other, MIN(value) AS value, {_grams('lower(value)')} AS og "
            f"FROM {held} v GROUP BY entity_type, lower(value)), x AS (SELECT w.*, value AS ex, {alias.replace('entity_type', 'w.entity_type')} AS al, {refused.replace('entity_type', 'w.entity_type')} AS refused FROM w LEFT JOIN h ON "
            f"h.entity_type = w.entity_type AND other = norm), rest AS (SELECT entity_type, raw, norm, {_grams('norm')} AS g FROM x WHERE NOT refused AND ex IS NULL AND al IS NULL), "
            "f AS (SELECT entity_type, raw, value, other, g, og, ROUND(1 - levenshtein(norm, other) / CAST(GREATEST(length(norm), length(other)) AS DOUBLE), 9) AS sim FROM rest JOIN h USING (entity_type)), "
            f"m AS (SELECT entity_type, raw, arg_min(value, (-sim, value)) AS near FROM f WHERE {cutoff} < 100 AND sim * 100 >= {cutoff} GROUP BY ALL), "
            "kn AS (SELECT entity_type, gram, COUNT(*) AS n FROM (SELECT entity_type, unnest(og) AS gram FROM h) u GROUP BY ALL), "
            "ra AS (SELECT entity_type, raw, list(gram) AS rare FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY entity_type, raw ORDER BY n, gram) AS place FROM (SELECT entity_type, raw, unnest(g) AS gram FROM rest) u "
            "JOIN kn USING (entity_type, gram)) p WHERE place <= 3 GROUP BY ALL), "
            "s AS (SELECT entity_type, raw, string_agg(value, ';' ORDER BY rk) AS hints FROM (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY entity_type, raw ORDER BY len(list_intersect(g, og)) DESC, other) AS rk FROM f JOIN ra "
            "USING (entity_type, raw) WHERE list_has_any(og, rare)) q WHERE rk <= 3 GROUP BY ALL) "
            "SELECT entity_type, raw, CASE WHEN NOT refused THEN COALESCE(ex, al, near) END AS resolved, CASE WHEN refused THEN 'refused' WHEN ex IS NOT NULL THEN 'exact' WHEN al IS NOT NULL THEN 'alias' WHEN near "
            "IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS confidence, CASE WHEN NOT refused AND COALESCE(ex, al, near) IS NULL THEN COALESCE(hints, '') END AS suggestions FROM x LEFT JOIN m USING (entity_type, raw) "
            "LEFT JOIN s USING (entity_type, raw)")


def _zones(clear: float, margin: float) -> str:
    return (f"{_COS}, t AS (SELECT query_id, MAX(CASE WHEN rank = 1 THEN score END) AS first, MAX(CASE WHEN rank = 2 THEN score END) AS second FROM rk WHERE "
            f"rank <= 2 GROUP BY 1) SELECT *, CASE WHEN first < 0.3 THEN 'no_match' WHEN first < {clear} AND first - second < {margin} THEN 'ambiguous' "
            "ELSE 'proceed' END AS zone FROM t")


SQL = {
    "O1_sum": f"SELECT SUM(amount_claimed) AS value FROM {_S}",
    "O2_average": f"SELECT AVG(total_cases) AS value FROM {_S}",
    "O3_min": f"SELECT CAST(total_cases AS DOUBLE) AS value, district_name AS label FROM {_S} ORDER BY total_cases, district_name LIMIT 1",
    "O4_max": f"SELECT CAST(total_cases AS DOUBLE) AS value, district_name AS label FROM {_S} ORDER BY total_cases DESC, district_name LIMIT 1",
    "O5_count": f"SELECT CAST(COUNT(*) AS DOUBLE) AS value FROM {_S}",
    "O6_median": f"SELECT quantile_cont(CAST(total_cases AS DOUBLE), 0.5) AS value FROM {_S}",
    "O7_stdev": f"SELECT STDDEV(total_cases) AS value FROM {_S}",
    "O8_percentile": f"SELECT quantile_cont(CAST(total_cases AS DOUBLE), 0.9) AS value FROM {_S}",
    "O9_range": f"SELECT CAST(MAX(total_cases) - MIN(total_cases) AS DOUBLE) AS value, CAST(MIN(total_cases) AS DOUBLE) AS low, CAST(MAX(total_cases) AS DOUBLE) AS high, "
                f"arg_min(district_name, (total_cases, district_name)) AS low_label, arg_min(district_name, (-total_cases, district_name)) AS high_label FROM {_S}",
    "O9_operate_default_column": f"SELECT SUM(amount_claimed) AS value FROM {_S}",
    "O9_operate_loose_name": f"SELECT CAST(MAX(total_cases) AS DOUBLE) AS value, arg_min(district_name, (-total_cases, district_name)) AS label FROM {_S}",
    "O10_mode": f"SELECT COALESCE(string_agg(v, ';' ORDER BY v), '') AS modes, COUNT(*) AS ties, MAX(k) AS rows FROM (SELECT division_name AS v, COUNT(*) AS k, MAX(COUNT(*)) OVER () AS top FROM {_S} GROUP BY 1) x "
                "WHERE k = top AND k > 1",
    "O11_count_distinct": f"SELECT CAST(COUNT(DISTINCT division_name) AS DOUBLE) AS value FROM {_S}",
    "O12_share_of_total": f"SELECT *, ROUND(total_cases / SUM(CAST(total_cases AS DOUBLE)) OVER () * 100.0, 2) AS share_of_total_cases_pct FROM {_S}",
    "O13_percent_change": "SELECT f AS first, l AS last, CASE WHEN n >= 2 THEN ROUND((l - f) / NULLIF(ABS(f), 0) * 100.0, 2) END AS value, "
                          "CASE WHEN n < 2 THEN 'too few values' WHEN f = 0 THEN 'zero start' END AS refused FROM (SELECT COUNT(*) AS n, "
                          "min_by(CAST(case_count AS DOUBLE), month) AS f, "
                          f"max_by(CAST(case_count AS DOUBLE), month) AS l FROM ({CATALOGUE['T05']}) t) x",
    "O14_sort": f"SELECT * FROM {_S}",
    "O15_top_n": f"SELECT * FROM {_S} ORDER BY total_cases DESC, district_name LIMIT 5",
    "O16_bottom_n": f"SELECT * FROM {_S} ORDER BY total_cases, district_name LIMIT 3",
    "O17_filter_rows": f"SELECT * FROM {_S} WHERE total_cases > 500 AND lower(division_name) LIKE '%a%'",
    "O18_compare": " UNION ALL ".join(f"SELECT *, '{d}' AS compared_value FROM ({summary('ccl', [CD], f'hospital_district = {chr(39)}{d}{chr(39)}', tat=True)}) x"
                                      for d in ("NATION_7", "NATION_9", "NATION_11")),
    "C1_grid_cells": f"SELECT * FROM {CELLS} x",
    "C2_haversine": f"SELECT r, c, {km('lat', 'lng', '26.85::DOUBLE', '80.95::DOUBLE')} AS km FROM {CELLS} x",
    "C3_nearest_site": f"SELECT *, pop * dist_km AS raw, pop * dist_km / MAX(pop * dist_km) OVER () AS score FROM {_NEAR} x",
    "C3_nearest_site_by_rings": f"SELECT * FROM {_NEAR} x",
    "C4_coverage": f"SELECT r, c, pop, lat, lng, LEAST(1.0::DOUBLE, GREATEST(0, MAX(strength * exp(-{_D} / 50)))) AS coverage FROM {CELLS} k, {SITES} s GROUP BY 1, 2, 3, 4, 5",
    "C5_top_k_cosine": f"{_COS} SELECT query_id, entry_id, score, CAST(rank AS INT) AS rank FROM rk WHERE rank <= 10",
    "C6_recall": f"{_GOLD} SELECT COUNT(*) AS queries, " + ", ".join(f"AVG(CASE WHEN rank < {k} THEN 1 ELSE 0 END) AS recall_{k}" for k in (5, 10, 20, 30))
                 + f", {_at(0.5)} AS median_rank, {_at(0.9)} AS p90_rank, {_at(0.99)} AS p99_rank, MAX(rank) AS worst_rank FROM gr",
    "C6_crowding": f"{_COS} SELECT AVG(s) AS mean_same, MAX(s) AS max_same FROM (SELECT query_id, COUNT(CASE WHEN label = query_id THEN 1 END) AS s FROM rk WHERE rank <= 30 GROUP BY 1) x",
    "C7_zones": _zones(1.0, 0.02),
    "C7_zones_as_declared": _zones(0.5, 0.015),
    "C8_resolve_names": f"WITH w AS {_WRITTEN}, x AS (SELECT raw, (SELECT MIN(n_name) FROM nation WHERE lower(n_name) = lower(trim(raw))) AS ex, {_ALIAS} AS al FROM w), f AS (SELECT raw, n_name, ROUND({_SIM}, 9) AS "
                        f"sim, ROW_NUMBER() OVER (PARTITION BY raw ORDER BY ROUND({_SIM}, 9) DESC, n_name) AS rk FROM w, nation), b AS (SELECT raw, MAX(CASE WHEN rk = 1 THEN sim END) AS sim, MAX(CASE WHEN rk = 1 THEN "
                        "n_name END) AS nm, string_agg(n_name, ';' ORDER BY rk) AS sg FROM f WHERE rk <= 3 GROUP BY 1) SELECT raw, CASE WHEN ex IS NOT NULL THEN ex WHEN al IS NOT NULL THEN al WHEN sim >= 0.8 THEN nm "
                        "END AS resolved, CASE WHEN ex IS NOT NULL THEN 'exact' WHEN al IS NOT NULL THEN 'alias' WHEN sim >= 0.8 THEN 'fuzzy' ELSE 'unmatched' END AS confidence, CASE WHEN ex IS NULL AND al IS NULL AND "
                        "sim < 0.8 THEN sg END AS suggestions FROM x JOIN b USING (raw)",
    "C8_resolve_entities": _resolved(_ASKED, _HELD, ENTITY_ALIASES, CUTOFFS),
    "C9_entity_registry": "SELECT DISTINCT 'district' AS entity_type, district_name AS value FROM hm_hospital UNION ALL SELECT DISTINCT 'division', division_name FROM hm_hospital UNION ALL SELECT DISTINCT 'specialty', "
                          "specialty_code FROM hm_specialty_offered UNION ALL SELECT DISTINCT 'hospital', hospital_name FROM hm_hospital UNION ALL SELECT 'month', CAST(i AS VARCHAR) FROM generate_series(1, 12) g(i)",
    "C10_date_range": summary("ccl", [CD], f"{CARE['district']} AND admission_datetime >= TIMESTAMP '1997-01-01' AND admission_datetime < TIMESTAMP '1998-01-01'", tat=True),
}


def result_sql() -> dict[str, str]:
    return rounded({k: complete(v) for k, v in SQL.items()})
