"""Repairs that follow a rule: dates into their legal window, missing registry pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import rnd


def into_window(value: Column, lower: Column, upper: Column, broken: Column) -> Column:
    """A broken time moves to the middle of its window, or to the lower bound where the window is empty."""
    a, b = F.unix_micros(lower), F.unix_micros(upper)
    middle = F.timestamp_micros(a + F.floor((b - a) / 2).cast("long"))
    return F.when(broken & (lower < upper), middle).when(broken, lower).otherwise(value)


def cards_before_admission(cards: DataFrame, created: str = "created_at", issued: str = "issued_at",
                           admitted: str = "first_admission") -> DataFrame:
    """Cards issued on or after the first admission get a time between enrolment and admission, a day clear of both."""
    day = F.expr("interval 1 day")
    late = F.col(admitted).isNotNull() & (F.col(issued) >= F.col(admitted))
    return cards.withColumn(issued, into_window(F.col(issued), F.col(created) + day, F.col(admitted) - day, late))


def missing_offers(treated: DataFrame, offered: DataFrame, unit: str, item: str, share: float = 0.95) -> DataFrame:
    """Items a unit treats but does not offer, among those that together cover ``share`` of its cases.

    ``treated`` has one row per case. Items are taken by falling case count (name
    settles ties) while the count before them is below the share; a unit has one
    row per item by then.
    """
    counts = treated.groupBy(unit, item).agg(F.count(F.lit(1)).alias("case_count"))
    order = Window.partitionBy(unit).orderBy(F.col("case_count").desc(), F.col(item))
    running = F.sum("case_count").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"_before": running - F.col("case_count"),
                                 "_all": F.sum("case_count").over(Window.partitionBy(unit))})
    taken = ranked.where(F.col("_before") < F.col("_all") * share).drop("_before", "_all")
    return taken.join(offered.select(unit, item).distinct(), [unit, item], "left_anti")


def offer_coverage(treated: DataFrame, offered: DataFrame, unit: str, item: str) -> DataFrame:
    """Share of cases, in percent, whose item their unit offers."""
    counts = treated.groupBy(unit, item).agg(F.count(F.lit(1)).alias("n"))
    known = offered.select(unit, item).distinct().withColumn("_in", F.lit(True))
    out = counts.join(known, [unit, item], "left").agg(
        F.sum(F.when(F.col("_in"), F.col("n")).otherwise(0)).alias("covered"), F.sum("n").alias("cases"))
    return out.withColumn("coverage_pct", rnd(F.col("covered") / F.col("cases") * 100.0, 4))
