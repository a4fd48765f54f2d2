"""Data-quality checks. Each returns rows of (check, subject, value, passed); nothing is repaired or dropped."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import digest
from ..functions.numbers import rnd
from ..runtime import cut_lineage
from .quantiles import exact_quantiles

COLUMNS = ["check", "subject", "value", "passed"]


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _result(df: DataFrame, check: str, subject: str, value: Column, passed: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), F.lit(subject).alias("subject"),
                     value.cast("double").alias("value"), passed.alias("passed"))


def row_count(df: DataFrame, subject: str, expected: int, tolerance_pct: float = 20) -> DataFrame:
    """Deviation of the row count from the expectation, in percent."""
    off = rnd(F.abs(F.count(F.lit(1)) - F.lit(expected)) / F.lit(float(expected)) * 100.0, 6)
    counted = df.agg(off.alias("v"))
    return _result(counted, "row_count", subject, F.col("v"), F.col("v") < tolerance_pct)


def unique_key(df: DataFrame, subject: str, keys: list[str]) -> DataFrame:
    """Rows beyond the first per key value (rows without a key count too)."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    extra = per_key.agg(F.coalesce(F.sum(F.col("k") - F.when(known, 1).otherwise(0)), F.lit(0)).alias("v"))
    return _result(extra, "unique_key", subject, F.col("v"), F.col("v") == 0)


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, subject: str) -> DataFrame:
    """Child rows whose key is unknown to the parent, with their share.

    The child is counted per key before it meets the parent, so a key that holds
    a large part of the child moves as one row.
    """
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    known = parent.select(F.col(parent_key).alias("_k")).where(F.col("_k").isNotNull()).distinct().withColumn(
        "_known", F.lit(True))
    joined = keys.join(known, "_k", "left").agg(
        F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("_n"))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    pct = F.when(F.col("n") > 0, rnd(F.col("lost") / F.col("n") * 100.0, 6)).otherwise(0.0)
    # both rows from the one aggregated row: the child is read once
    both = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(subject).alias("subject"), v.cast("double").alias("value"), (F.col("lost") == 0).alias("passed"))
                     for c, v in (("orphans", F.col("lost")), ("orphan_pct", pct))])
    return joined.select(F.explode(both).alias("r")).select("r.*")


def null_rates(df: DataFrame, subject: str, threshold_pct: float = 20) -> DataFrame:
    """Null share of every column, from one pass; a column above the threshold does not pass."""
    shares = df.agg(*[
        F.when(F.count(F.lit(1)) > 0, rnd((F.count(F.lit(1)) - F.count(c)) / F.count(F.lit(1)) * 100.0, 6))
        .otherwise(0.0).alias(c) for c in df.columns])
    rows = shares.unpivot([], df.columns, "column", "value")
    return rows.select(F.lit("null_rate").alias("check"), F.concat(F.lit(f"{subject}."), F.col("column")).alias("subject"),
                       "value", (F.col("value") <= threshold_pct).alias("passed"))


def value_domain(df: DataFrame, column: str, allowed: list, subject: str) -> DataFrame:
    """Distinct values outside the declared domain."""
    odd = df.select(column).where(F.col(column).isNotNull()).distinct().where(~F.col(column).isin(*allowed))
    return _result(odd.agg(F.count(F.lit(1)).alias("v")), "value_domain", subject, F.col("v"), F.col("v") == 0)


def date_span(df: DataFrame, column: str, subject: str, low: float = 1, high: float = 10) -> DataFrame:
    """Years between the first and the last value."""
    span = df.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    whole = F.floor((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 86400e6)
    years = rnd(whole / 365.0, 6)
    return _result(span, "date_span", subject, years, F.coalesce(years.between(low, high), F.lit(True)))


def grain(df: DataFrame, subject: str, keys: list[str], expected: int | None = None, tolerance_pct: float = 20,
          at_least: int | None = None) -> DataFrame:
    """One row per key, and a plausible number of rows."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k")).agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("d"))
    out = [_result(counts, "grain", subject, F.col("n") - F.col("d"), F.col("n") == F.col("d"))]
    if expected is not None:
        off = rnd(F.abs(F.col("n") - expected) / float(expected) * 100.0, 6)
        out.append(_result(counts, "row_count", subject, off, off < tolerance_pct))
    if at_least is not None:
        out.append(_result(counts, "min_rows", subject, F.col("n"), F.col("n") >= at_least))
    return stack(out)


def profile(df: DataFrame) -> DataFrame:
    """Per column: nulls, distinct values, smallest and largest value as text.

    Distinct values are counted from one long (column, value) table that is
    combined before the shuffle, instead of one distinct aggregate per column.
    """
    ends = df.agg(*[f(c).cast("string").alias(f"{c}{s}") for c in df.columns for f, s in ((F.min, "__a"), (F.max, "__z"))])
    low = ends.unpivot([], [f"{c}__a" for c in df.columns], "c", "min_value").withColumn("column", F.expr("substr(c, 1, length(c) - 3)"))
    high = ends.unpivot([], [f"{c}__z" for c in df.columns], "c", "max_value").withColumn("column", F.expr("substr(c, 1, length(c) - 3)"))
    text = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "column", "value")
    seen = text.groupBy("column", "value").agg(F.count(F.lit(1)).alias("k")).groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("k"))), F.lit(0)).alias("n_null"))
    return seen.join(low.drop("c"), "column").join(high.drop("c"), "column")


def top_values(df: DataFrame, columns: list[str], limit: int = 5) -> DataFrame:
    """The most frequent values of each column, null included; the value settles ties."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    counts = text.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("column").orderBy(F.col("n").desc(), F.col("value").asc_nulls_last())
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def measure_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Min, mean, median, max, standard deviation and nulls per measure, from one long table."""
    # the columns are read three times below and may come from a long join: it runs once
    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in columns])).unpivot([], columns, "measure", "v")
    moments = rows.groupBy("measure").agg(
        rnd(F.min("v")).alias("min"), rnd(F.avg("v")).alias("mean"), rnd(F.max("v")).alias("max"),
        rnd(F.stddev("v")).alias("std"), F.count(F.when(F.col("v").isNull(), 1)).alias("nulls"))
    middle = exact_quantiles(rows, ["measure"], "v", {"q": 0.5}).withColumn("median", rnd("q")).drop("q")
    return moments.join(middle, "measure", "left")


def sample_rows(df: DataFrame, n: int = 5, seed: int = 42) -> DataFrame:
    """A few rows chosen by a seeded hash of their values, so the choice does not depend on partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(c).cast("string") for c in df.columns])).limit(n)


def expectations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Conditions over a whole table, as boolean aggregates evaluated in one pass."""
    flags = df.agg(*[c.alias(f"r{i}") for i, c in enumerate(rules.values())])
    return stack(
        _result(flags, "expectation", name, F.when(F.col(f"r{i}"), 1).otherwise(0), F.coalesce(F.col(f"r{i}"), F.lit(False)))
        for i, name in enumerate(rules))


def all_hold(cond: Column) -> Column:
    """Aggregate: the condition holds on every row where it is known."""
    return F.coalesce(F.bool_and(cond), F.lit(True))


def some_hold(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


def share_where(cond: Column) -> Column:
    """Aggregate: share of the rows with a known condition that meet it."""
    return F.avg(F.when(cond, 1.0).when(cond.isNotNull(), 0.0))


def order_violations(df: DataFrame, subject: str, bad: Column) -> DataFrame:
    """Rows whose times contradict the required order."""
    return _result(df.agg(F.count(F.when(bad, 1)).alias("v")), "time_order", subject, F.col("v"), F.col("v") == 0)


_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def parity(old: DataFrame, new: DataFrame, keys: list[str], rtol: float = 1e-9, atol: float = 1e-6, buckets: int = 65536) -> DataFrame:
    """Row counts, columns, types and values by key of two copies of a table.

    Numbers agree within ``atol + rtol * |new|``; null and NaN agree with themselves. A key missing on one side
    counts as a difference of every column. Each side is digested by bucket of keys, numbers in steps of
    half of ``atol``; only rows of buckets whose digests differ are joined and compared column by column.
    """
    spark = old.sparkSession
    a, b = dict(old.dtypes), dict(new.dtypes)
    shared = [c for c in old.columns if c in b]
    shape = [("columns", c, 1.0, False) for c in sorted(set(a) ^ set(b))]
    shape += [("type", c, 1.0, False) for c in shared if a[c] != b[c]]
    counts = old.agg(F.count(F.lit(1)).alias("n")).withColumn("m", new.agg(F.count(F.lit(1))).scalar())
    out = [_result(counts, "rows", "*", F.col("n") - F.col("m"), F.col("n") == F.col("m"))]
    if shape:
        out.append(spark.createDataFrame(shape, "check string, subject string, value double, passed boolean"))
    values = [c for c in shared if c not in keys]
    numbers = {c for c in values if isinstance(old.schema[c].dataType, _NUMERIC) and isinstance(new.schema[c].dataType, _NUMERIC)}

    def known(c: str) -> Column:
        """A value as it is compared: numbers as doubles, NaN as null, all else as text."""
        if c not in numbers:
            return F.col(c).cast("string")
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))

    def dealt(df: DataFrame, side: str) -> DataFrame:
        names = [F.col(k).cast("string") for k in keys]
        return df.select(F.pmod(F.xxhash64(*names), F.lit(buckets)).alias(f"{side}_bucket"), *[n.alias(f"{side}_key{i}") for i, n in enumerate(names)],
                         F.lit(True).alias(f"in_{side}"), *[known(c).alias(f"{side}_{c}") for c in values])

    def told(df: DataFrame, side: str) -> DataFrame:
        steps = [F.round(F.col(f"{side}_{c}") / (atol / 2)) if c in numbers else F.col(f"{side}_{c}") for c in values]
        return df.groupBy(F.col(f"{side}_bucket").alias("bucket")).agg(digest([*[F.col(f"{side}_key{i}") for i in range(len(keys))], *steps]).alias(side))

    left, right = dealt(old, "old"), dealt(new, "new")
    unequal = cut_lineage(told(left, "old").join(told(right, "new"), "bucket", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("bucket"))
    on = reduce(lambda x, y: x & y, [F.col(f"old_key{i}").eqNullSafe(F.col(f"new_key{i}")) for i in range(len(keys))])
    both = left.join(unequal, left["old_bucket"] == unequal["bucket"], "left_semi").join(
        right.join(unequal, right["new_bucket"] == unequal["bucket"], "left_semi"), on, "full_outer")
    alone = F.col("in_old").isNull() | F.col("in_new").isNull()
    diffs = []
    for c in values:
        o, m = F.col(f"old_{c}"), F.col(f"new_{c}")
        same = o.eqNullSafe(m)
        if c in numbers:
            same = same | F.coalesce(F.abs(o - m) <= F.lit(atol) + F.lit(rtol) * F.abs(m), F.lit(False))
        diffs.append(F.count(F.when(alone | ~same, 1)).cast("double").alias(c))
    rows = both.agg(*diffs).unpivot([], values, "subject", "value")
    out.append(rows.select(F.lit("value").alias("check"), "subject", "value", (F.col("value") == 0).alias("passed")))
    return stack(out)


class ChecksFailed(Exception):
    """Raised in strict mode; says how many checks failed and where they are written."""


def require_passed(checks: DataFrame, out: str) -> DataFrame:
    """Strict mode: fail the job when any check failed; all failed rows are written to ``out`` first."""
    checks.where(~F.col("passed")).write.mode("overwrite").parquet(out)
    failed = checks.sparkSession.read.schema(checks.schema).parquet(out).count()
    if failed:
        raise ChecksFailed(f"{failed} checks failed, see {out}")
    return checks
