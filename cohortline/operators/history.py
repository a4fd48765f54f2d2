"""Looking back along an entity's history without putting one entity's whole history into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], carry: dict[str, str],
                  bucket: Column | None = None) -> DataFrame:
    """Add, from the previous row of the same ``keys`` in ``order``, the columns named by ``carry`` (new -> source).

    Equal to ``lag`` over the whole key, but the long window runs per key and
    time bucket (the calendar day of the first order column unless given). The
    first row of a bucket takes its value from the last row of the bucket
    before, found on a table with one row per key and bucket; so a key that
    holds a large part of all rows is spread over as many tasks as it has days.
    The order must be total within a key (end it on a unique column).
    """
    step = F.to_date(order[0]) if bucket is None else bucket
    payload = F.struct(*[F.col(src).alias(new) for new, src in carry.items()])
    rank = F.struct(*[x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))])
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    rows = df.withColumn("_bucket", step).withColumn("_near", F.lag(payload).over(inner))
    ends = rows.groupBy(*keys, "_bucket").agg(F.max_by(payload, rank).alias("_end"))
    across = Window.partitionBy(*keys).orderBy(F.col("_bucket").asc_nulls_last())
    ends = ends.withColumn("_far", F.lag("_end").over(across)).drop("_end")
    names = [*keys, "_bucket"]
    other = ends.select("_far", *[F.col(k).alias(f"_e{i}") for i, k in enumerate(names)])
    cond = [F.col(k).eqNullSafe(F.col(f"_e{i}")) for i, k in enumerate(names)]
    joined = rows.join(other, cond, "left").withColumn("_prev", F.coalesce("_near", "_far"))
    return joined.select(*df.columns, *[F.col(f"_prev.{new}").alias(new) for new in carry])


def preceded_within(events: DataFrame, keys: list[str], case: str, start: str, end: str, first: int, last: int) -> DataFrame:
    """Cases that start between ``first`` and ``last`` days after the end of another case of the same ``keys``.

    Works on counts per key and day (at most one row per calendar day), so no
    pair of cases is ever formed. Returns the distinct ``case`` values.
    """
    rows = events.select(*keys, case, F.to_date(start).alias("_s"), F.to_date(end).alias("_e"))
    gap = F.datediff("_s", "_e")
    own = rows.groupBy(*keys, case, "_s").agg(F.count(F.when(gap.between(first, last), 1)).alias("_own"))
    ended = rows.groupBy(*keys, F.col("_e").alias("_day")).agg(F.count(F.lit(1)).alias("_k"))
    begun = rows.select(*keys, F.col("_s").alias("_day")).distinct().withColumn("_k", F.lit(0).cast("long"))
    days = ended.unionByName(begun).groupBy(*keys, "_day").agg(F.sum("_k").alias("_k"))
    window = Window.partitionBy(*keys).orderBy(F.unix_date("_day")).rangeBetween(-last, -first)
    seen = days.withColumn("_seen", F.coalesce(F.sum("_k").over(window), F.lit(0)))
    hits = own.join(seen.drop("_k").withColumnRenamed("_day", "_s"), [*keys, "_s"])
    return hits.where(F.col("_seen") > F.col("_own")).select(case).distinct()
