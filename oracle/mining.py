"""SQL for mining: every text is made for one view in full, with its dimensions, measures and floor."""

from __future__ import annotations

import math
from itertools import combinations

from cohortline.operators.mining.scoring import entropy_bound
from cohortline.operators.mining.spec import DISTRICT_MONTH_CUBE, HOSPITAL_PERFORMANCE, ViewSpec
from workload.mining import GAMMAS, OVER_TIME

from .foundation import VIEW2, VIEW3
from .model import complete

def texts(spec: ViewSpec, view: str) -> dict[str, str]:
    """The SQL of every mining question over one view."""
    DIMS, TIME = spec.dimensions, spec.temporal
    SUMS = [m.name for m in spec.measures if m.agg == "sum"]
    AVGS = [m.name for m in spec.measures if m.agg == "avg"]

    def _sub(dims) -> str:
        return " || '|' || ".join(f"'{d}=' || {d}" for d in dims) if dims else "'{*}'"

    def _known(cols) -> str:
        return " AND ".join(f"{c} IS NOT NULL" for c in cols) or "TRUE"

    _FILTERS = [c for k in range(spec.depth + 1) for c in combinations(DIMS, k)]

    def _parts(filters) -> str:
        """The one or two filters of a subspace as columns."""
        cells = []
        for i in range(2):
            if i < len(filters):
                cells += [f"'{filters[i]}' AS d{i + 1}", f"{filters[i]} AS v{i + 1}"]
            else:
                cells += [f"CAST(NULL AS VARCHAR) AS d{i + 1}", f"CAST(NULL AS VARCHAR) AS v{i + 1}"]
        return ", ".join(cells)

    V = f"SELECT {', '.join((*DIMS, *TIME, *SUMS, *AVGS))} FROM ({view}) z"
    SPACE = " UNION ALL ".join(
        f"SELECT {_sub(f)} AS subspace, {_parts(f)}, " + ", ".join(f"COALESCE(SUM({m}), 0) / (SELECT SUM({m}) FROM v) AS i_{m}" for m in spec.impact)
        + f" FROM v WHERE {_known(f)}" + (f" GROUP BY {', '.join(f)}" if f else "") for f in _FILTERS)
    SPACES = f"SELECT *, GREATEST({', '.join(f'i_{m}' for m in spec.impact)}) AS max_impact FROM ({SPACE}) s"
    _AGG = ", ".join([f"COALESCE(SUM({m}), 0) AS {m}" for m in SUMS] + [f"AVG({m}) AS {m}" for m in AVGS])
    _WIDE = " UNION ALL ".join(
        f"SELECT {_sub(f)} AS subspace, {_parts(f)}, '{b}' AS breakdown, {'TRUE' if b in TIME else 'FALSE'} AS is_temporal, {b} AS label, {_AGG} FROM v "
        f"WHERE {_known((*f, b))} GROUP BY {', '.join((*f, b))}" for f in _FILTERS for b in (*DIMS, *TIME) if b not in f)
    DIST = " UNION ALL ".join(
        f"SELECT subspace, d1, v1, d2, v2, breakdown, is_temporal, '{m}' AS measure, label, ROUND(CAST({m} AS DOUBLE) * {d}) / {d} AS value FROM wide"
        for names, d in ((SUMS, '1e4'), (AVGS, '1e9')) for m in names)
    BASE = f"WITH v AS MATERIALIZED ({V}), space AS MATERIALIZED ({SPACES}), wide AS ({_WIDE}), dist AS MATERIALIZED ({DIST})"
    _KEY = "subspace, d1, v1, d2, v2, breakdown, is_temporal, measure"
    LISTS = (f"ls AS MATERIALIZED (SELECT {_KEY}, COUNT(*) AS n, SUM(value) AS total, list(value ORDER BY value DESC, label) AS hi, list(label ORDER BY value "
             "DESC, label) AS hil, list(value ORDER BY value, label) AS lo, list(label ORDER BY value, label) AS lol, AVG(value) AS m, STDDEV(value) AS s, "
             f"list(value ORDER BY label) AS xs, list(label ORDER BY label) AS labels FROM dist WHERE value IS NOT NULL GROUP BY {_KEY})")

    def _dev(sign: str, value: str, rest: str, k: str, plain: str) -> str:
        sd, mean = f"list_aggregate({rest}, 'stddev_samp')", f"list_avg({rest})"
        return f"CASE WHEN {sd} > 0 THEN ({value} - {mean}) / {sd} {sign} {k} ELSE {plain.format(m=mean)} END"

    _R = {
        "OUTSTANDING_1": ("n >= 3 AND total <> 0 AND " + _dev(">=", "hi[1]", "hi[2:]", "2", "hi[1] > {m}")
                          + " AND NOT (hi[2] > 0 AND hi[1] / hi[2] < 1.5)", "hil[1]"),
        "OUTSTANDING_LAST": ("n >= 3 AND total <> 0 AND " + _dev("<=", "lo[1]", "lo[2:]", "-2", "lo[1] < {m}")
                             + " AND NOT (lo[2] > 0 AND lo[1] / lo[2] > 0.67)", "lol[1]"),
        "TOP_TWO": ("n >= 4 AND total <> 0 AND " + _dev(">=", "hi[1]", "hi[3:]", "1.5", "hi[2] > {m}") + " AND "
                    + _dev(">=", "hi[2]", "hi[3:]", "1.5", "hi[2] > {m}") + " AND NOT (hi[3] > 0 AND hi[2] / hi[3] < 1.3)",
                    "LEAST(hil[1], hil[2]) || ',' || GREATEST(hil[1], hil[2])"),
        "LAST_TWO": ("n >= 4 AND total <> 0 AND " + _dev("<=", "lo[1]", "lo[3:]", "-1.5", "lo[2] < {m}") + " AND "
                     + _dev("<=", "lo[2]", "lo[3:]", "-1.5", "lo[2] < {m}") + " AND NOT (lo[3] > 0 AND lo[2] / lo[3] > 0.77)",
                     "LEAST(lol[1], lol[2]) || ',' || GREATEST(lol[1], lol[2])"),
        "EVENNESS": ("n >= 3 AND m <> 0 AND s / m < 0.15 AND NOT (hi[1] / total > 2.0 / n)", "'EVEN'"),
        "ATTRIBUTION": ("n >= 3 AND total <> 0 AND hi[1] / total > 0.5 AND NOT (hi[2] > 0 AND hi[1] / hi[2] < 2.0)", "hil[1]"),
    }
    HITS = "hit AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT {_KEY}, '{t}' AS type, {h} AS highlight FROM ls WHERE NOT is_temporal AND {c}" for t, (c, h) in _R.items()) + ")"
    _POINTS = ("pt AS (SELECT subspace, breakdown, measure, label, value, ROW_NUMBER() OVER w AS i, COUNT(*) OVER p AS n FROM dist WHERE is_temporal AND value IS "
               "NOT NULL WINDOW p AS (PARTITION BY subspace, breakdown, measure), w AS (PARTITION BY subspace, breakdown, measure ORDER BY label))")
    _G = "subspace, breakdown, measure"
    OUTLIER = (f"{BASE}, {_POINTS}, z AS (SELECT *, (value - AVG(value) OVER p) / NULLIF(STDDEV(value) OVER p, 0) AS z FROM pt WINDOW p AS (PARTITION BY {_G})) "
               f"SELECT {_G}, string_agg(label || CASE WHEN z > 0 THEN ' ABOVE' ELSE ' BELOW' END, ',' ORDER BY label) AS highlight FROM z WHERE n >= 5 AND ROUND(abs(z), 9) > 3 "
               f"GROUP BY {_G}, n HAVING COUNT(*) <= 0.2 * n")
    SEASON = (f"{BASE}, {_POINTS}, c AS (" + " UNION ALL ".join(
        f"SELECT a.subspace, a.breakdown, a.measure, {k} AS lag, corr(a.value, b.value) AS r FROM pt a JOIN pt b ON a.subspace = b.subspace AND a.breakdown = "
        f"b.breakdown AND a.measure = b.measure AND b.i = a.i + {k} WHERE a.n >= 12 AND {k} <= a.n // 2 GROUP BY 1, 2, 3" for k in (3, 4, 6, 12))
        + f") SELECT {_G}, 'PERIOD_' || lag AS highlight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_G} ORDER BY r DESC, lag) AS k FROM c WHERE r > 0.4 AND NOT "
        "isnan(r)) x WHERE k = 1")

    def _shape(name: str, pick: str, left: str, right: str) -> str:
        return (f"SELECT e.subspace, e.breakdown, e.measure, '{name},' || e.label AS highlight, (l + r) / 2 AS sc, '{name}' AS k FROM (SELECT e.*, (SELECT "
                f"AVG(CASE WHEN d.dv {left} 0 THEN 1.0 ELSE 0.0 END) FROM dd d WHERE d.subspace = e.subspace AND d.breakdown = e.breakdown AND d.measure = e.measure AND "
                f"d.i <= e.i AND d.i > 1) AS l, (SELECT AVG(CASE WHEN d.dv {right} 0 THEN 1.0 ELSE 0.0 END) FROM dd d WHERE d.subspace = e.subspace AND d.breakdown = "
                f"e.breakdown AND d.measure = e.measure AND d.i > e.i) AS r FROM (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_G} ORDER BY value {pick}, i) "
                "AS k FROM pt WHERE n >= 5) q WHERE k = 1 AND i BETWEEN 2 AND n - 1) e) e WHERE l >= 0.7 AND r >= 0.7")

    UNIMODAL = (f"{BASE}, {_POINTS}, dd AS (SELECT *, value - LAG(value) OVER (PARTITION BY {_G} ORDER BY i) AS dv FROM pt), sh AS ({_shape('PEAK', 'DESC', '>', '<')} "
                f"UNION ALL {_shape('VALLEY', 'ASC', '<', '>')}) SELECT {_G}, highlight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_G} ORDER BY sc DESC, k) AS rk "
                "FROM sh) x WHERE rk = 1")

    # Trend: rank correlation with time; the two-sided t probability for whole degrees of freedom is a finite sum.
    _RANKED = (f"rk AS (SELECT {_G}, i, n, RANK() OVER (PARTITION BY {_G} ORDER BY value) + (COUNT(*) OVER (PARTITION BY {_G}, value) - 1) / 2.0 AS r FROM pt WHERE n >= 4), "
               f"rho AS (SELECT {_G}, n - 2 AS v, corr(r, i) AS rho FROM rk GROUP BY {_G}, n HAVING MIN(r) < MAX(r)), "
               f"ang AS (SELECT {_G}, v, rho, atan(abs(rho) / sqrt((1 - rho) * (1 + rho))) AS a FROM rho WHERE abs(rho) < 1 - 1e-12 AND abs(rho) >= 0.5)")
    _ODD = "(2 / pi()) * (a + sin(a) * COALESCE(list_sum([exp(2 * k * ln(2) + 2 * lgamma(k + 1) - lgamma(2 * k + 2)) * cos(a) ** (2 * k + 1) for k in range(0, (v - 1) // 2)]), 0))"
    _EVEN = "sin(a) * list_sum([exp(lgamma(2 * k + 1) - 2 * k * ln(2) - 2 * lgamma(k + 1)) * cos(a) ** (2 * k) for k in range(0, v // 2)])"
    TREND = (f"{BASE}, {_POINTS}, {_RANKED} SELECT {_G}, CASE WHEN rho > 0 THEN 'INCREASING' ELSE 'DECREASING' END AS highlight FROM (SELECT {_G}, rho FROM rho WHERE abs(rho) >= "
             f"1 - 1e-12 UNION ALL SELECT {_G}, rho FROM ang WHERE 1 - CASE WHEN v % 2 = 1 THEN {_ODD} ELSE {_EVEN} END < 0.05) x")

    # Change of level: Welch's test of every split; the two-sided probability is an incomplete beta function, whose
    # continued fraction takes a step per round of the recursion.
    def _welch() -> str:
        first, rest = "ROWS UNBOUNDED PRECEDING", "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"
        parts = ", ".join(f"{f}({x}) OVER ({w} {r}) AS {f}{n}{s}" for s, r in (("a", first), ("b", rest)) for f, x, n in (("SUM", "x", "1"), ("SUM", "x * x", "2"), ("MIN", "x", ""), ("MAX", "x", ""))
                          for w in (f"PARTITION BY {_G} ORDER BY i",))
        sums = f"sm AS (SELECT *, {parts}, LEAD(label) OVER (PARTITION BY {_G} ORDER BY i) AS next FROM (SELECT *, value - AVG(value) OVER (PARTITION BY {_G}) AS x FROM pt WHERE n >= 6) y)"
        var = "CASE WHEN MIN{s} = MAX{s} THEN 0 ELSE GREATEST(SUM2{s} - SUM1{s} * SUM1{s} / {k}, 0) / ({k} - 1.0) END / {k}"
        sides = (f"sd AS (SELECT {_G}, i, n, next, SUM1a / i - SUM1b / (n - i) AS d, {var.format(s='a', k='i')} AS va, {var.format(s='b', k='(n - i)')} AS vb "
                 "FROM sm WHERE i BETWEEN 3 AND n - 3)")
        tests = (f"tt AS (SELECT {_G}, i, next, CASE WHEN va + vb > 0 THEN abs(d) / sqrt(va + vb) WHEN d <> 0 THEN 1e300 END AS t, CASE WHEN va + vb > 0 THEN (va + vb) ** 2 / (va ** 2 / (i - 1) "
                 "+ vb ** 2 / (n - i - 1)) ELSE 1 END AS df FROM sd)")
        args = (f"ag AS (SELECT *, x > (a + 1) / (a + 2.5) AS flip FROM (SELECT {_G}, i, next, t, df / 2 AS a, df / (df + t * t) AS x, t * t / (df + t * t) AS y FROM tt WHERE t > 2.5758 AND t < 1e299) z)")
        start = ("cf AS (SELECT *, 0 AS m, CAST(1 AS DOUBLE) AS c, 1 / (1 - (p + q) * u / (p + 1)) AS f, 1 / (1 - (p + q) * u / (p + 1)) AS h FROM (SELECT *, CASE WHEN flip THEN 0.5 ELSE a END AS p, "
                 "CASE WHEN flip THEN a ELSE 0.5 END AS q, CASE WHEN flip THEN y ELSE x END AS u FROM ag) z")
        keep = f"{_G}, i, next, t, a, x, y, flip"
        even, odd = "(m + 1) * (q - m - 1) * u / ((p + 2 * m + 1) * (p + 2 * m + 2))", "-(p + m + 1) * (p + q + m + 1) * u / ((p + 2 * m + 2) * (p + 2 * m + 3))"
        again = (f"UNION ALL SELECT {keep}, p, q, u, m + 1, 1 + o / c1, 1 / (1 + o * f1), h1 * (1 + o / c1) / (1 + o * f1) FROM (SELECT *, 1 + e / c AS c1, 1 / (1 + e * f) AS f1, h * (1 + e / c) / (1 + e * f) AS h1 "
                 f"FROM (SELECT {keep}, p, q, u, m, c, f, h, {even} AS e, {odd} AS o FROM cf WHERE m < 60) z) z)")
        start = start.replace("SELECT *, 0 AS m", f"SELECT {keep}, p, q, u, 0 AS m")
        front = "exp(lgamma(a + 0.5) - lgamma(a) - lgamma(0.5) + a * ln(x) + 0.5 * ln(y)) * h / p"
        return (f"{_POINTS}, {sums}, {sides}, {tests}, {args}, {start} {again}, pv AS (SELECT {_G}, i, next, CASE WHEN flip THEN 1 - {front} ELSE {front} END AS p FROM cf WHERE m = 60 "
                f"UNION ALL SELECT {_G}, i, next, 0 FROM tt WHERE t >= 1e299)")

    CHANGE = (f"{BASE.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_welch()} SELECT {_G}, next AS highlight FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {_G} ORDER BY ROUND(ln(GREATEST(p, 1e-300)), 6), i) AS k FROM pv WHERE p < 0.01) x WHERE k = 1")
    _TIMED = "timed AS (" + " UNION ALL ".join(f"SELECT {_G}, '{t}' AS type FROM ({q}) z" for t, q in (
        ("TREND", TREND), ("OUTLIER", OUTLIER), ("SEASONALITY", SEASON), ("CHANGE_POINT", CHANGE), ("UNIMODALITY", UNIMODAL))) + ")"

    # Sibling groups on categorical breakdowns.
    _B2 = "COALESCE({d} || '=' || {v}, '{{*}}')"
    MEMBER = (
        "mem AS MATERIALIZED (SELECT 'subspace' AS strategy, d1 AS ext_dim, breakdown, measure, " + _B2.format(d="d2", v="v2") + " AS base, v1 AS member, subspace "
        "FROM scope WHERE d1 IS NOT NULL UNION ALL SELECT 'subspace', d2, breakdown, measure, " + _B2.format(d="d1", v="v1") + ", v2, subspace FROM scope WHERE d2 IS "
        "NOT NULL UNION ALL SELECT 'measure', 'measure', breakdown, '(varies)', subspace, measure, subspace FROM scope)")
    DOMAIN = ("dom AS MATERIALIZED (SELECT d1 AS ext_dim, COUNT(*) AS hdp_size FROM space WHERE d1 IS NOT NULL AND d2 IS NULL GROUP BY 1 UNION ALL "
              f"SELECT 'measure', {len(spec.measures)})")
    _ALL = "strategy, ext_dim, breakdown, measure, base"
    GROUPS = (
        f"{BASE}, {LISTS}, {HITS}, scope AS MATERIALIZED (SELECT DISTINCT {_KEY} FROM dist WHERE NOT is_temporal), {MEMBER}, {DOMAIN}, "
        "mh AS MATERIALIZED (SELECT m.*, s.max_impact, h.type, h.highlight FROM mem m JOIN space s ON s.subspace = m.subspace JOIN hit h ON h.subspace = m.subspace AND "
        "h.breakdown = m.breakdown AND h.measure = CASE WHEN m.strategy = 'measure' THEN m.member ELSE m.measure END), "
        f"same AS (SELECT {_ALL}, type, highlight, COUNT(*) AS k, MAX(max_impact) AS mi FROM mh GROUP BY {_ALL}, type, highlight), "
        f"tot AS (SELECT {_ALL}, type, SUM(k) AS typed, MAX(mi) AS mi FROM same GROUP BY {_ALL}, type), "
        f"anyhit AS (SELECT {_ALL}, COUNT(DISTINCT member) AS any_k FROM mh GROUP BY {_ALL}), "
        f"cand AS (SELECT s.strategy, s.ext_dim, s.breakdown, s.measure, s.base, s.type AS pattern_type, d.hdp_size, s.highlight, s.k, CAST(t.typed - s.k AS INT) AS n_hc, "
        f"CAST(a.any_k - t.typed AS INT) AS n_tc, CAST(d.hdp_size - a.any_k AS INT) AS n_np, ROUND(CAST(s.k AS DOUBLE) / d.hdp_size, 4) AS alpha, t.mi FROM same s JOIN tot "
        f"t USING ({_ALL}, type) JOIN anyhit a USING ({_ALL}) JOIN dom d USING (ext_dim) WHERE d.hdp_size >= {spec.min_members} AND CAST(s.k AS DOUBLE) / d.hdp_size > {spec.tau}), "
        f"imp AS (SELECT strategy, ext_dim, base, " + ", ".join(f"LEAST(1.0, SUM(i_{m})) AS i_{m}" for m in spec.impact) + " FROM (SELECT 'subspace' AS strategy, d1 AS ext_dim, "
        + _B2.format(d="d2", v="v2") + " AS base, * FROM space WHERE d1 IS NOT NULL UNION ALL SELECT 'subspace', d2, " + _B2.format(d="d1", v="v1")
        + ", * FROM space WHERE d2 IS NOT NULL) x GROUP BY 1, 2, 3 UNION ALL SELECT 'measure', 'measure', subspace, " + ", ".join(f"i_{m}" for m in spec.impact) + " FROM space), "
        "trig AS (SELECT c.* FROM cand c LEFT JOIN (SELECT DISTINCT h.subspace AS base, h.breakdown, h.measure, h.type AS pattern_type FROM hit h JOIN space s ON s.subspace = "
        f"h.subspace WHERE s.max_impact >= {spec.min_impact}) p ON c.strategy = 'subspace' AND p.base = c.base AND p.breakdown = c.breakdown AND p.measure = c.measure AND "
        f"p.pattern_type = c.pattern_type WHERE c.mi >= {spec.min_impact} OR p.base IS NOT NULL)"
    )

    # Sibling groups of every scope that is evaluated: strong subspaces, their siblings, and what lies right below them.
    LIVE = (
        f"{BASE}, ext AS MATERIALIZED (SELECT subspace, max_impact, d1 AS dim, " + _B2.format(d="d2", v="v2") + " AS base FROM space WHERE d1 IS NOT NULL UNION ALL SELECT subspace, "
        "max_impact, d2, " + _B2.format(d="d1", v="v1") + f" FROM space WHERE d2 IS NOT NULL), live AS (SELECT subspace FROM space WHERE max_impact >= {spec.min_impact} UNION SELECT "
        f"subspace FROM ext JOIN (SELECT base, dim FROM ext GROUP BY 1, 2 HAVING MAX(max_impact) >= {spec.min_impact}) b USING (base, dim) UNION SELECT e.subspace FROM ext e JOIN "
        f"space s ON s.subspace = e.base WHERE s.max_impact >= {spec.min_impact}), eligible AS MATERIALIZED (SELECT DISTINCT subspace, breakdown, is_temporal, measure FROM dist JOIN live "
        f"USING (subspace)), {DOMAIN}")
    _BY_SUBSPACE = (f"{LIVE} SELECT e.dim AS ext_dim, s.breakdown, s.measure, e.base, CAST(d.hdp_size AS INT) AS hdp_size, COUNT(*) AS with_data FROM eligible s JOIN ext e USING (subspace) "
                    f"JOIN dom d ON d.ext_dim = e.dim WHERE d.hdp_size >= {spec.min_members} GROUP BY 1, 2, 3, 4, 5")
    _BY_MEASURE = (f"{LIVE} SELECT 'measure' AS ext_dim, breakdown, '(varies)' AS measure, subspace AS base, CAST({len(spec.measures)} AS INT) AS hdp_size, COUNT(*) AS with_data "
                   "FROM eligible GROUP BY 2, 4")
    _BY_GRAIN = (f"{LIVE} SELECT 'temporal_grain' AS ext_dim, '(varies)' AS breakdown, measure, subspace AS base, CAST({len(TIME)} AS INT) AS hdp_size, COUNT(*) AS with_data "
                 "FROM eligible WHERE is_temporal GROUP BY 3, 4")

    def _plogp(x: str) -> str:
        return f"CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0 END"

    _ENT = " + ".join([_plogp("alpha")] + [_plogp(f"CAST({c} AS DOUBLE) / hdp_size") for c in ("n_hc", "n_tc", "n_np")])
    _BEST, _WHICH = "0.0", f"'{spec.impact[0]}'"
    for _m in spec.impact:
        _WHICH = f"CASE WHEN COALESCE(i_{_m}, 0) > {_BEST} + 1e-9 THEN '{_m}' ELSE {_WHICH} END"
        _BEST = f"GREATEST({_BEST}, COALESCE(i_{_m}, 0))"

    def _concise(gamma: str) -> str:
        return f"GREATEST(0, 1 - ({_ENT} + CASE WHEN n_hc + n_tc + n_np = 0 THEN {gamma} ELSE 0 END) / {entropy_bound():.17g})"

    SCORED = (GROUPS + f", found AS MATERIALIZED (SELECT strategy, ext_dim, pattern_type, breakdown, measure, base, hdp_size, highlight || ':' || k AS common, n_hc AS n_highlight_change, "
              f"n_tc AS n_type_change, n_np AS n_no_pattern, {_concise('0.5')} AS conciseness, {_BEST} AS impact, {_WHICH} AS impact_measure, {_concise('0.5')} * ({_BEST}) AS score, "
              "alpha, n_hc, n_tc, n_np, concat_ws('|', pattern_type, strategy, ext_dim, breakdown, measure, regexp_replace(base, '([<>])=', '\\1\\\\=', 'g')) AS cid FROM trig LEFT JOIN imp USING (strategy, ext_dim, base) "
              f"WHERE {_concise('0.5')} * ({_BEST}) > 0)")
    _FLATKEY = "strategy, ext_dim, pattern_type, breakdown, measure, base"
    _FLAT = (f"{_FLATKEY}, hdp_size, common, n_highlight_change, n_type_change, n_no_pattern, ROUND(conciseness, 6) AS conciseness, ROUND(impact, 6) AS impact, impact_measure, "
             "ROUND(score, 6) AS score")
    _FILT = ("CASE WHEN a.base = '{*}' AND b.base = '{*}' THEN 1.0 WHEN a.base = '{*}' OR b.base = '{*}' THEN 0.0 ELSE CAST(len(list_intersect(string_split(a.base, '|'), "
             "string_split(b.base, '|'))) AS DOUBLE) / LEAST(len(string_split(a.base, '|')), len(string_split(b.base, '|'))) END")

    def _eq(c: str) -> str:
        return f"CASE WHEN a.{c} = b.{c} THEN 1.0 ELSE 0.0 END"

    _RATIO = (f"CASE WHEN a.strategy = 'subspace' THEN 0.4 * ({_FILT}) + 0.3 * {_eq('ext_dim')} + 0.15 * {_eq('measure')} + 0.15 * {_eq('breakdown')} ELSE 0.6 * ({_FILT}) + 0.4 * "
              f"{_eq('breakdown')} END")
    _PAIR = "a.strategy = b.strategy AND a.pattern_type = b.pattern_type"

    def _greedy(k: int) -> str:
        """Every step written out: the best of what is left, and the gains of the others without their overlap with it."""
        order = "ORDER BY ROUND(gain, 9) DESC, ROUND(score, 9) DESC, cid LIMIT 1"
        steps = [f", pool0 AS MATERIALIZED (SELECT {_FLATKEY}, cid, score, score AS gain FROM found), pick1 AS MATERIALIZED (SELECT *, 1 AS rank FROM pool0 {order})"]
        for i in range(1, k):
            steps.append(f", pool{i} AS MATERIALIZED (SELECT a.* EXCLUDE (gain), a.gain - CASE WHEN {_PAIR} THEN LEAST(a.score, b.score) * ({_RATIO}) ELSE 0 END AS gain "
                         f"FROM pool{i - 1} a, pick{i} b WHERE a.cid <> b.cid), pick{i + 1} AS MATERIALIZED (SELECT *, {i + 1} AS rank FROM pool{i} WHERE gain > 0 {order})")
        return "".join(steps) + " " + " UNION ALL ".join(f"SELECT {_FLATKEY}, rank, ROUND(gain, 6) AS gain FROM pick{i}" for i in range(1, k + 1))

    def _facets() -> str:
        return " UNION ALL ".join(
            f"SELECT '{c}' AS facet, {c} AS value, COUNT(*) AS candidates, COUNT(CASE WHEN n_hc + n_tc + n_np > 0 THEN 1 END) AS actionable, ROUND(MAX(score), 6) AS top_score "
            f"FROM found GROUP BY 2" for c in ("pattern_type", "strategy", "breakdown", "ext_dim"))

    SQL = {
        "M1_subspaces": f"{BASE} SELECT subspace FROM space",
        "M2_subspace_impact": f"{BASE} SELECT subspace, " + ", ".join(f"ROUND(i_{m}, 9) AS i_{m}" for m in spec.impact) + ", ROUND(max_impact, 9) AS max_impact FROM space",
        "M3_impact_pruning": f"{BASE} SELECT subspace, ROUND(max_impact, 9) AS max_impact FROM space WHERE max_impact >= {spec.min_impact}",
        "M4_data_scopes": f"{BASE} SELECT subspace, COUNT(DISTINCT breakdown || '/' || measure) AS scopes, COUNT(DISTINCT breakdown) AS breakdowns FROM dist GROUP BY 1",
        "M5_distributions": f"{BASE} SELECT subspace, breakdown, measure, label, ROUND(value, 6) AS value FROM dist",
        "M8_three_way_label": f"{BASE}, {LISTS}, {HITS} SELECT s.subspace, s.breakdown, s.measure, CASE WHEN COUNT(CASE WHEN h.type = 'EVENNESS' THEN 1 END) > 0 THEN 'EVENNESS' WHEN "
                              "COUNT(h.type) > 0 THEN 'OTHER_PATTERN' ELSE 'NO_PATTERN' END AS label FROM (SELECT DISTINCT subspace, breakdown, measure FROM dist WHERE NOT is_temporal) s "
                              "LEFT JOIN hit h ON h.subspace = s.subspace AND h.breakdown = s.breakdown AND h.measure = s.measure GROUP BY 1, 2, 3",
        "M7_type_eligibility": f"{BASE}, {LISTS}, {HITS}, {_TIMED} SELECT is_temporal, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM (SELECT FALSE AS is_temporal, type FROM hit "
                               "UNION ALL SELECT TRUE, type FROM timed) x GROUP BY 1",
        "M8_three_way_label_in_time": f"{BASE}, {_TIMED} SELECT s.subspace, s.breakdown, s.measure, CASE WHEN COUNT(CASE WHEN h.type = 'OUTLIER' THEN 1 END) > 0 THEN 'OUTLIER' WHEN COUNT(h.type) > 0 "
                                      "THEN 'OTHER_PATTERN' ELSE 'NO_PATTERN' END AS label FROM (SELECT DISTINCT subspace, breakdown, measure FROM dist WHERE is_temporal) s LEFT JOIN timed h "
                                      "ON h.subspace = s.subspace AND h.breakdown = s.breakdown AND h.measure = s.measure GROUP BY 1, 2, 3",
        "M6_10_change_point": f"SELECT * FROM ({CHANGE}) z",
        "M6_7_trend": TREND,
        "M6_8_outlier": OUTLIER,
        "M6_9_seasonality": SEASON,
        "M6_11_unimodality": UNIMODAL,
        "M9_subspace_groups": _BY_SUBSPACE,
        "M10_measure_groups": _BY_MEASURE,
        "M11_breakdown_groups": _BY_GRAIN,
        "M12_commonness_and_exceptions": f"{SCORED} SELECT {_FLATKEY}, hdp_size, common, n_highlight_change, n_type_change, n_no_pattern FROM found",
        "M13_group_dedup": f"{SCORED} SELECT MAX(n) AS most_copies FROM (SELECT COUNT(*) AS n FROM found GROUP BY {_FLATKEY}) x",
        "M14_conciseness": f"{SCORED} SELECT {_FLATKEY}, ROUND(conciseness, 6) AS conciseness FROM found",
        "M15_impact": f"{SCORED} SELECT {_FLATKEY}, ROUND(impact, 6) AS impact, impact_measure FROM found",
        "M16_scored_candidates": f"{SCORED} SELECT {_FLAT} FROM found",
        "M17_prefilter": f"{SCORED} SELECT {_FLAT} FROM (SELECT * FROM found ORDER BY ROUND(score, 9) DESC, cid LIMIT 100) x",
        "M18_overlaps": f"{SCORED}, pk AS (SELECT * FROM found ORDER BY ROUND(score, 9) DESC, cid LIMIT 5) SELECT a.cid, b.cid AS pick, ROUND({_RATIO}, 6) AS ratio, ROUND(LEAST(a.score, b.score) * "
                        f"({_RATIO}), 6) AS overlap FROM found a JOIN pk b ON {_PAIR} AND a.cid <> b.cid",
        "M20_total_use": f"{SCORED}, pk AS (SELECT * FROM found ORDER BY ROUND(score, 9) DESC, cid LIMIT 15) SELECT n, ROUND(ss, 6) AS score_sum, ROUND(o, 6) AS overlap_sum, ROUND(ss - o, 6) AS "
                         f"total_use FROM (SELECT COUNT(*) AS n, SUM(score) AS ss FROM pk) x, (SELECT COALESCE(SUM(LEAST(a.score, b.score) * ({_RATIO})), 0) AS o FROM pk a JOIN pk b ON "
                         f"{_PAIR} AND a.cid < b.cid) y",
        "M21_rescored": f"{SCORED} " + " UNION ALL ".join(
            f"SELECT strategy, ext_dim, pattern_type, breakdown, measure || '@{g}' AS measure, base, hdp_size, common, n_highlight_change, n_type_change, n_no_pattern, "
            f"ROUND({_concise(str(g))}, 6) AS conciseness, ROUND(impact, 6) AS impact, impact_measure, ROUND({_concise(str(g))} * impact, 6) AS score FROM found" for g in GAMMAS),
        "M19_greedy_ranking": f"{SCORED}{_greedy(15)}",
        "M21_gamma_changes": f"{SCORED}, sel AS (SELECT * FROM (" + " UNION ALL ".join(
            f"SELECT CAST({g} AS DOUBLE) AS gamma, cid, ROW_NUMBER() OVER (ORDER BY ROUND({_concise(str(g))} * impact, 9) DESC, cid) AS rank FROM found" for g in GAMMAS)
            + f") x WHERE rank <= 15), b AS (SELECT cid FROM sel WHERE gamma = {GAMMAS[0]}), o AS (SELECT gamma, cid FROM sel WHERE gamma <> {GAMMAS[0]}) "
            "SELECT gamma, cid, 'entered' AS change FROM o WHERE cid NOT IN (SELECT cid FROM b) UNION ALL SELECT g.gamma, b.cid, 'left' FROM b, (SELECT DISTINCT gamma FROM o) g "
            "WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.gamma = g.gamma AND o.cid = b.cid)",
        "M24_type_statistics": f"{SCORED} {_facets()}",
        "M24_score_histogram": f"{SCORED} SELECT ROUND(b / 5.0, 1) AS from_score, ROUND((b + 1) / 5.0, 1) AS to_score, COUNT(*) AS candidates FROM (SELECT LEAST(4, CAST(floor(score * 5) "
                               "AS INT)) AS b FROM found) x GROUP BY b",
        "M24_best_per_breakdown": f"{SCORED} SELECT breakdown, rank, cid, ROUND(score, 6) AS score FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY breakdown ORDER BY ROUND(score, 9) DESC, cid) AS "
                                  "rank FROM found WHERE n_hc + n_tc + n_np > 0) x WHERE rank <= 10",
        "M25_diversity": f"{SCORED} SELECT COUNT(DISTINCT pattern_type) AS n_types, string_agg(DISTINCT pattern_type, ', ' ORDER BY pattern_type) AS types, COUNT(DISTINCT ext_dim) AS "
                         "n_dims, string_agg(DISTINCT ext_dim, ', ' ORDER BY ext_dim) AS dims, COUNT(DISTINCT NULLIF(measure, '(varies)')) AS n_measures, COALESCE(string_agg(DISTINCT "
                         "NULLIF(measure, '(varies)'), ', ' ORDER BY NULLIF(measure, '(varies)')), '') AS measures, COUNT(CASE WHEN n_hc + n_tc + n_np > 0 THEN 1 END) AS actionable, "
                         "COUNT(*) AS selected FROM (SELECT * FROM found ORDER BY ROUND(score, 9) DESC, cid LIMIT 15) x",
    }
    for _i, _name in enumerate(_R, 1):
        SQL[f"M6_{_i}_{_name.lower()}"] = f"{BASE}, {LISTS}, {HITS} SELECT subspace, breakdown, measure, highlight FROM hit WHERE type = '{_name}'"
    return SQL


assert math.isclose(entropy_bound(), 1.792, abs_tol=1e-3)


def mining_sql() -> dict[str, str]:
    sites, months = texts(HOSPITAL_PERFORMANCE, VIEW3), texts(DISTRICT_MONTH_CUBE, VIEW2)
    over_time = {k: v for k, v in months.items() if k in OVER_TIME}
    said = {k: v for k, v in sites.items() if k not in OVER_TIME} | over_time
    said["M16_hospital_performance_mined"] = sites["M16_scored_candidates"]
    return {k: complete(v) for k, v in said.items()}
