"""Exact percentiles of unbounded values, without holding a group's values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles of ``value`` per ``keys``; ``points`` maps result column to p."""
    return order_statistics(df, keys, value, {name: (p, p * (F.col("_n") - 1)) for name, p in points.items()})


def thresholds(df: DataFrame, points: dict[str, tuple[str, float]]) -> dict[str, Column]:
    """Percentiles of several columns from one pass, as scalars to compare rows with; ``points`` maps a name to (column, p).

    The columns are stacked as (column, value) rows, so there is one sketch and one bracket per column
    however many thresholds are asked for. A column without values has no threshold (null). ``df`` is read
    twice and should be a written table.
    """
    columns = list(dict.fromkeys(c for c, _ in points.values()))
    shares = {f"p{i}": p for i, p in enumerate(dict.fromkeys(p for _, p in points.values()))}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_column", "_value")
    found = cut_lineage(exact_quantiles(long, ["_column"], "_value", shares))
    at = {p: name for name, p in shares.items()}
    return {name: found.where(F.col("_column") == c).select(at[p]).scalar() for name, (c, p) in points.items()}


def order_statistics(df: DataFrame, keys: list[str], value: str, points: dict[str, tuple[float, Column]]) -> DataFrame:
    """Values at given positions of the ascending order, one column per point.

    A point is a share p and its zero-based position, an expression over the
    group size ``_n`` within two places of ``p * _n``; between two places the
    value is interpolated. A quantile sketch, whose error is at most one in
    ``ACCURACY`` of the group, brackets each position. The brackets, one small row per
    group, are joined to the rows as they are read: everything below a bracket is counted
    where it lies and everything above is dropped, so that only counts and the few
    values inside are shuffled by value and ordered, however large the group.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    margin = 4.0 / ACCURACY
    edges = [e for p, _ in points.values() for e in (max(p - margin, 0.0), min(p + margin, 1.0))]
    sketch = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
        F.percentile_approx("_v", edges, ACCURACY).alias("_e"))

    def bracket(i: int, p: float) -> tuple[Column, Column]:
        few = F.col("_n") <= ACCURACY
        low = F.col("_lo") if p <= margin else F.when(few, F.col("_lo")).otherwise(F.col("_e")[2 * i])
        high = F.col("_hi") if p >= 1 - margin else F.when(few, F.col("_hi")).otherwise(F.col("_e")[2 * i + 1])
        return low, high

    wanted = []
    for i, (name, (p, at)) in enumerate(points.items()):
        low, high = bracket(i, p)
        wanted.append(F.struct(F.lit(name).alias("name"), at.cast("double").alias("at"), low.alias("low"), high.alias("high")))
    spans = sketch.select(*keys, F.array(*wanted).alias("_w"))
    near = same_keys(known, spans, keys).select(*keys, "_v", F.explode("_w").alias("_w")).where(F.col("_v") <= F.col("_w.high"))
    steps = near.groupBy(
        *keys, F.col("_w.name").alias("_p"), F.col("_w.at").alias("_at"),
        F.when(F.col("_v") >= F.col("_w.low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    running = Window.partitionBy(*keys, "_p").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    placed = steps.withColumn("_upto", F.sum("_c").over(running))

    def at_place(name: str, place: Column) -> Column:
        here = (F.col("_p") == name) & (place < F.col("_upto")) & (place >= F.col("_upto") - F.col("_c"))
        return F.max(F.when(here, F.col("_v")))

    out = []
    for name in points:
        a, z = at_place(name, F.floor("_at")), at_place(name, F.ceil("_at"))
        part = F.max(F.when(F.col("_p") == name, F.col("_at") - F.floor("_at")))
        out.append((a + (z - a) * part).alias(name))
    return placed.groupBy(*keys).agg(*out)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null; no keys means one row on the right."""
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})
    other = right.select(*[F.col(k).alias(f"_r_{i}") for i, k in enumerate(keys)],
                         *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{i}")) for i, k in enumerate(keys)]
    return left.join(other, cond).drop(*[f"_r_{i}" for i in range(len(keys))])
