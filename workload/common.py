"""What every registered query does to its result, so that it compares across engines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.runtime import for_hot_keys, in_small_pieces
from cohortline.sources.driver_binding import BoundTables

Query = Callable[[SparkSession, str], DataFrame]


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text; everything else as it is."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DateType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            out[f.name] = F.date_format(f.name, "yyyy-MM-dd HH:mm:ss")
    return df.withColumns(out) if out else df


def bound(build: Callable[[BoundTables], DataFrame]) -> Query:
    """A query over the operational model."""
    return lambda spark, sf_dir: plain(build(BoundTables(in_small_pieces(for_hot_keys(spark)), sf_dir)))
