"""Eleven pattern tests over the distribution of a scope.

Every test reads ``dist`` (label and value, in label order) and yields its
highlight as an array of strings, or null when the pattern is absent. Missing
values are left out first. Ties go to the smaller label, as if the first of
equal values had been taken in label order. Standard deviations are those of a
sample unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.stats import split_search_sql, t_pvalue_sql

CATEGORICAL = ("OUTSTANDING_1", "OUTSTANDING_LAST", "TOP_TWO", "LAST_TWO", "EVENNESS", "ATTRIBUTION")
TEMPORAL = ("TREND", "OUTLIER", "SEASONALITY", "CHANGE_POINT", "UNIMODALITY")
LAGS = (3, 4, 6, 12)


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (a, x) -> a + x)"


def _mean(array: str) -> str:
    return f"try_divide({_sum(array)}, size({array}))"


def _squares(array: str, mean: str) -> str:
    return f"aggregate({array}, 0D, (a, x) -> a + (x - {mean}) * (x - {mean}))"


def _std(array: str, mean: str) -> str:
    return f"sqrt(try_divide({_squares(array, mean)}, size({array}) - 1))"


def _prepared(scopes: DataFrame) -> DataFrame:
    """Values and labels without gaps, and both orders of them."""
    return (
        scopes.withColumn("pts", F.expr("filter(dist, p -> p.value is not null)"))
        .withColumns({
            "n": F.size("pts"), "xs": F.expr("transform(pts, p -> p.value)"), "labels": F.expr("transform(pts, p -> p.label)"),
            "up": F.expr("array_sort(transform(pts, p -> struct(p.value as v, p.label as label)))"),
            "dn": F.expr("array_sort(transform(pts, p -> struct(-p.value as v, p.label as label)))")})
        .withColumn("total", F.expr(_sum("xs")))
    )


def _extremes(p: DataFrame) -> DataFrame:
    """The first three values from either end, and mean and deviation of what remains without one or two of them."""
    cut = {f"{end}{k}": F.expr(f"transform(slice({end}, {k + 1}, greatest(n, 1)), q -> {sign}q.v)")
           for end, sign in (("up", ""), ("dn", "-")) for k in (1, 2)}
    p = p.withColumns(cut)
    p = p.withColumns({f"{a}_m": F.expr(_mean(a)) for a in (*cut, "xs")})
    p = p.withColumns({f"{a}_s": F.expr(_std(a, f"{a}_m")) for a in (*cut, "xs")})
    ends = {}
    for k in range(3):
        ends[f"hi{k}"] = F.expr(f"-get(dn, {k}).v")
        ends[f"lo{k}"] = F.expr(f"get(up, {k}).v")
    return p.withColumns(ends)


# Conditions as SQL over the prepared columns, with the highlight each pattern reports. Quotients are null rather than
# an error on a zero divisor: the planner may evaluate a shared quotient ahead of the test that guards it.
_CATEGORICAL_RULES = {
    "OUTSTANDING_1": (
        "n >= 3 and total <> 0 and if(dn1_s > 0, try_divide(hi0 - dn1_m, dn1_s) >= 2.0, hi0 > dn1_m)"
        " and not (hi1 > 0 and try_divide(hi0, hi1) < 1.5)",
        "array(get(dn, 0).label)"),
    "OUTSTANDING_LAST": (
        "n >= 3 and total <> 0 and if(up1_s > 0, try_divide(lo0 - up1_m, up1_s) <= -2.0, lo0 < up1_m)"
        " and not (lo1 > 0 and try_divide(lo0, lo1) > 0.67)",
        "array(get(up, 0).label)"),
    "TOP_TWO": (
        "n >= 4 and total <> 0 and if(dn2_s > 0, try_divide(hi0 - dn2_m, dn2_s) >= 1.5"
        " and try_divide(hi1 - dn2_m, dn2_s) >= 1.5, hi1 > dn2_m) and not (hi2 > 0 and try_divide(hi1, hi2) < 1.3)",
        "array_sort(array(get(dn, 0).label, get(dn, 1).label))"),
    "LAST_TWO": (
        "n >= 4 and total <> 0 and if(up2_s > 0, try_divide(lo0 - up2_m, up2_s) <= -1.5"
        " and try_divide(lo1 - up2_m, up2_s) <= -1.5, lo1 < up2_m) and not (lo2 > 0 and try_divide(lo1, lo2) > 0.77)",
        "array_sort(array(get(up, 0).label, get(up, 1).label))"),
    "EVENNESS": (
        "n >= 3 and xs_m <> 0 and try_divide(xs_s, xs_m) < 0.15 and not (try_divide(hi0, total) > try_divide(2.0D, n))",
        "array('EVEN')"),
    "ATTRIBUTION": (
        "n >= 3 and total <> 0 and try_divide(hi0, total) > 0.5 and not (hi1 > 0 and try_divide(hi0, hi1) < 2.0)",
        "array(get(dn, 0).label)"),
}


def categorical(scopes: DataFrame) -> DataFrame:
    """Add one highlight column per categorical pattern type."""
    p = _extremes(_prepared(scopes))
    out = p.withColumns({t: F.expr(f"case when {cond} then {shown} end") for t, (cond, shown) in _CATEGORICAL_RULES.items()})
    return out.select(*scopes.columns, *_CATEGORICAL_RULES)


def _lag_correlation(k: int) -> str:
    """Correlation of the series with itself ``k`` steps later; null for a constant part."""
    a, b = f"slice(xs, 1, greatest(n - {k}, 0))", f"slice(xs, {k + 1}, greatest(n - {k}, 0))"
    return (f"transform(array(struct({a} as a, {b} as b)), s -> struct(s.a as a, s.b as b, {_mean('s.a')} as ma, {_mean('s.b')} as mb))")


def _pearson(s: str) -> str:
    cross = f"aggregate(zip_with({s}.a, {s}.b, (x, y) -> (x - {s}.ma) * (y - {s}.mb)), 0D, (t, x) -> t + x)"
    return f"try_divide({cross}, sqrt({_squares(f'{s}.a', f'{s}.ma')} * {_squares(f'{s}.b', f'{s}.mb')}))"


def _steps(part: str, sign: str) -> str:
    """Share of the steps of a part of the series that go in one direction."""
    k = f"greatest(size({part}) - 1, 0)"
    diffs = f"zip_with(slice({part}, 1, {k}), slice({part}, 2, {k}), (x, y) -> y - x)"
    return f"try_divide(size(filter({diffs}, d -> d {sign} 0)), size({part}) - 1)"


def temporal(scopes: DataFrame) -> DataFrame:
    """Add one highlight column per temporal pattern type.

    A constant series has no rank correlation and counts as no trend.
    """
    p = _prepared(scopes)
    p = p.withColumns({"xs_m": F.expr(_mean("xs")), "sx": F.expr("array_sort(xs)")})
    p = p.withColumns({"xs_s": F.expr(_std("xs", "xs_m")), "rx": F.reverse("sx")})

    # Trend: Spearman correlation with time, average ranks.
    p = p.withColumn("rk", F.expr("transform(xs, x -> (array_position(sx, x) + n + 1 - array_position(rx, x)) / 2D - (n + 1) / 2D)"))
    p = p.withColumns({
        "rr": F.expr("aggregate(rk, 0D, (a, x) -> a + x * x)"), "tt": F.expr("n * (n * n - 1D) / 12D"),
        "rt": F.expr("aggregate(transform(rk, (x, i) -> x * (i + 1 - (n + 1) / 2D)), 0D, (a, x) -> a + x)")})
    p = p.withColumn("rho", F.expr("case when n >= 4 and rr > 0 then greatest(-1D, least(1D, try_divide(rt, sqrt(rr * tt)))) end"))
    p = p.withColumn("rho_t", F.expr("case when abs(rho) < 1 then rho * sqrt(try_divide(greatest(n - 2, 0), (1 - rho) * (1 + rho))) end"))
    p = p.withColumn("trend_p", F.expr(f"case when abs(rho) = 1 then 0D when abs(rho) >= 0.5 then {t_pvalue_sql('rho_t', 'cast(n - 2 as double)')} end"))

    # Outliers beyond three deviations, at most a fifth of the points.
    far = "filter(pts, q -> round(abs(try_divide(q.value - xs_m, xs_s)), 9) > 3.0)"  # three deviations to the last digit are three
    p = p.withColumn("far", F.expr(f"case when n >= 5 and xs_s <> 0 then {far} end"))

    # Seasons: the strongest lag correlation.
    p = p.withColumns({f"lag{k}": F.expr(f"case when n >= 12 and {k} <= n div 2 then {_lag_correlation(k)}[0] end") for k in LAGS})
    p = p.withColumns({f"acf{k}": F.expr(f"case when lag{k} is not null then {_pearson(f'lag{k}')} end") for k in LAGS})
    best = F.expr("array_max(filter(array(" + ", ".join(f"acf{k}" for k in LAGS) + "), x -> x > 0.4))")
    p = p.withColumn("acf", best)
    season = F.coalesce(*[F.when(F.col(f"acf{k}") == F.col("acf"), F.lit(f"PERIOD_{k}")) for k in LAGS])

    # One change of level.
    p = p.withColumn("cut", F.expr(split_search_sql("xs")))

    # One peak or valley, with at least 70 % of the steps leading to it and from it.
    p = p.withColumns({"peak": F.expr("array_position(xs, array_max(xs))"), "dip": F.expr("array_position(xs, array_min(xs))")})
    for name, left, right in (("peak", ">", "<"), ("dip", "<", ">")):
        p = p.withColumns({f"{name}_l": F.expr(f"slice(xs, 1, cast({name} as int))"),
                           f"{name}_r": F.expr(f"slice(xs, cast(greatest({name}, 1) as int), n)")})
        p = p.withColumns({f"{name}_lo": F.expr(_steps(f"{name}_l", left)), f"{name}_ro": F.expr(_steps(f"{name}_r", right))})
        fits = f"n >= 5 and {name} between 2 and n - 1 and {name}_lo >= 0.7 and {name}_ro >= 0.7"
        p = p.withColumn(f"{name}_sc", F.expr(f"case when {fits} then ({name}_lo + {name}_ro) / 2 end"))
    shape = F.expr("case when peak_sc >= coalesce(dip_sc, 0D) then array('PEAK', get(labels, cast(peak - 1 as int)))"
                   " when dip_sc is not null then array('VALLEY', get(labels, cast(dip - 1 as int))) end")

    out = p.withColumns({
        "TREND": F.expr("case when trend_p < 0.05 and abs(rho) >= 0.5 then array(if(rho > 0, 'INCREASING', 'DECREASING')) end"),
        "OUTLIER": F.expr("case when size(far) > 0 and size(far) <= 0.2D * n then array_sort(transform(far, q -> "
                          "concat(q.label, ' ', if(q.value > xs_m, 'ABOVE', 'BELOW')))) end"),
        "SEASONALITY": F.when(F.col("acf").isNotNull(), F.array(season)),
        "CHANGE_POINT": F.expr("case when cut is not null then array(get(labels, cut.at)) end"),
        "UNIMODALITY": shape,
    })
    return out.select(*scopes.columns, *TEMPORAL)


def evaluate(scopes: DataFrame) -> DataFrame:
    """Scopes with ``hits``: the patterns found, as (type, highlight). Each kind of breakdown has its own tests."""
    def hits(df, types):
        found = F.array(*[F.struct(F.lit(t).alias("type"), F.col(t).alias("highlight")) for t in types])
        return df.withColumn("hits", F.filter(found, lambda h: h["highlight"].isNotNull())).drop(*types)

    return hits(categorical(scopes.where(~F.col("is_temporal"))), CATEGORICAL).unionByName(
        hits(temporal(scopes.where("is_temporal")), TEMPORAL))


def three_way(evaluated: DataFrame, kind: str) -> DataFrame:
    """Evaluated scopes that ``kind`` can be asked of, with a label: the kind itself, OTHER_PATTERN, or NO_PATTERN."""
    if kind not in CATEGORICAL + TEMPORAL:
        raise ValueError(f"{kind} is not a pattern")
    rows = evaluated.where(F.col("is_temporal") == F.lit(kind in TEMPORAL))
    own = F.exists("hits", lambda h: h["type"] == kind)
    return rows.withColumn("label", F.when(own, kind).when(F.size("hits") > 0, "OTHER_PATTERN").otherwise("NO_PATTERN"))
