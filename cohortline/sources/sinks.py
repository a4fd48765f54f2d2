"""Writing: lossless CSV to Parquet, views, candidates, materialised dashboards."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digest import digest
from .readers import TYPE_KEY, read_inferred, read_raw, retype


class NotLossless(Exception):
    """The CSV cannot be converted without changing a value."""


def digests(df: DataFrame, **groups: list) -> list:
    """One digest per group of columns, all from one pass."""
    row = df.agg(*[digest(columns).alias(name) for name, columns in groups.items()]).first()
    return [row[name] for name in groups]


def csv_to_parquet(spark: SparkSession, csv: str, out: str, staging: str) -> DataFrame:
    """Convert a CSV to text Parquet that remembers the inferred types, after proving that nothing changed.

    The conversion goes to ``staging`` first; ``out`` is only written once the
    text and the re-typed values both equal the source by their digests (source and copy are
    read once each, nothing is shuffled), and no field is a quoted
    empty string (which text Parquet could not tell from a missing one).
    """
    raw, inferred = read_raw(spark, csv), read_inferred(spark, csv)
    kinds = {f.name: f.dataType.simpleString() for f in inferred.schema.fields}
    tagged = raw.select(*[F.col(c).alias(c, metadata={TYPE_KEY: kinds[c]}) for c in raw.columns])
    tagged.write.mode("overwrite").option("compression", "zstd").parquet(staging)
    stored = spark.read.parquet(staging)
    problems = []
    back = retype(stored)
    text, types = digests(stored, text=[F.col(c) for c in raw.columns], types=[F.col(c).cast(kinds[c]) for c in back.columns])
    if digests(raw, text=[F.col(c) for c in raw.columns]) != [text]:
        problems.append("text differs")
    if digests(inferred, types=[F.col(c) for c in inferred.columns]) != [types] or back.dtypes != inferred.dtypes:
        problems.append("types differ")
    quoted_empty = F.col("value").rlike('(^|,)""(,|$)')
    if not spark.read.text(csv).where(quoted_empty).isEmpty():
        problems.append("quoted empty fields")
    if problems:
        raise NotLossless(f"{csv}: {', '.join(problems)}")
    stored.write.mode("overwrite").option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def csv_dir_to_parquet(spark: SparkSession, paths: dict[str, str], out: str, staging: str) -> DataFrame:
    """Convert several CSVs by name; one status row each, the failed ones without output."""
    rows = []
    for name, path in paths.items():
        try:
            done = csv_to_parquet(spark, path, f"{out}/{name}.parquet", f"{staging}/{name}")
            rows.append((name, "ok", len(done.columns)))
        except NotLossless as e:
            rows.append((name, f"refused: {e}", 0))
    return spark.createDataFrame(rows, "name string, status string, columns int")


def write_view(df: DataFrame, path: str) -> DataFrame:
    """Write a view and hand back what was written, so that later steps read the file, not the plan."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def materialise(spark: SparkSession, queries: dict[str, Callable[[], DataFrame]], out: str, together: int = 4) -> DataFrame:
    """Write each result whole under its id, with a status row each: FRESH, or ERROR where it fails or has no rows.

    ``queries`` builds each result when its turn comes, so that one that cannot be built doesn't stop the others;
    ``together`` of them run at a time.
    """
    if not queries:
        raise ValueError("nothing to materialise")

    def one(qid: str) -> tuple[str, int, str]:
        path = f"{out}/query_id={qid}"
        try:
            df = queries[qid]()
            df.write.mode("overwrite").parquet(path)
            n = spark.read.schema(df.schema).parquet(path).count()
            return qid, n, "FRESH" if n else "ERROR: no rows"
        except (PySparkException, ValueError, KeyError) as e:
            return qid, 0, f"ERROR: {type(e).__name__}: {(str(e).splitlines() or [''])[0]}"

    with ThreadPoolExecutor(together) as pool:
        rows = list(pool.map(one, queries))
    return spark.createDataFrame(rows, "query_id string, row_count long, status string")
