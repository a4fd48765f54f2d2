"""Picking one row or one value per key.

All of these are aggregations with a partial step on the map side, not window
sorts, so a key that holds a large part of the rows costs one row per task in
the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _order_key(columns: list[str], largest: bool) -> Column:
    """A struct that sorts by the columns with nulls last in either direction."""
    parts = []
    for c in columns:
        null = F.col(c).isNull()
        parts += [(~null if largest else null).alias(f"{c}_n"), F.col(c).alias(c)]
    return F.struct(*parts)


def _one(df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None, largest: bool) -> DataFrame:
    keep = payload if payload is not None else [c for c in df.columns if c not in keys]
    pick = F.max_by if largest else F.min_by
    row = pick(F.struct(*keep), _order_key(order, largest)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in keep])


def first_per_key(df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None) -> DataFrame:
    """The row that comes first by ``order`` (end it on a unique column to settle ties)."""
    return _one(df, keys, order, payload, largest=False)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str], payload: list[str] | None = None) -> DataFrame:
    """The row that comes last by ``order``."""
    return _one(df, keys, order, payload, largest=True)


def latest_excluding(df: DataFrame, keys: list[str], order: list[str], column: str, excluded: list,
                     payload: list[str] | None = None) -> DataFrame:
    """The latest row whose ``column`` is none of the excluded values."""
    return latest_per_key(df.where(~F.col(column).isin(*excluded)), keys, order, payload)


def primary_rows(df: DataFrame, rank: str, value: int = 1) -> DataFrame:
    """Rows that carry the primary rank."""
    return df.where(F.col(rank) == value)


def modal_value(df: DataFrame, keys: list[str], column: str, name: str | None = None) -> DataFrame:
    """The most frequent non-null value per key; the smallest value settles ties."""
    counts = df.groupBy(*keys, column).agg(F.count(column).alias("_k"))
    best = F.min_by(column, F.struct(-F.col("_k"), F.col(column)))
    return counts.groupBy(*keys).agg(F.when(F.max("_k") > 0, best).alias(name or column))


def worst_status(df: DataFrame, keys: list[str], column: str, priority: dict[str, int], name: str) -> DataFrame:
    """The status of highest priority per key; unlisted statuses do not count."""
    return df.groupBy(*keys).agg(worst(column, priority).alias(name))


def worst(column: str, priority: dict[str, int]) -> Column:
    rank = F.lit(None).cast("int")
    for status, p in priority.items():
        rank = F.when(F.col(column) == status, p).otherwise(rank)
    return F.max_by(column, rank)


def first_non_null(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One non-null value per descriptor column and key: the smallest, so that the choice does not depend on row order."""
    return df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in columns])
