"""Reading text sources and giving them their declared, stored or inferred types."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .schema import CASTS

# Logical type -> Spark type.
SPARK_TYPES = {"timestamp": "timestamp", "date": "date", "float": "double", "int": "bigint", "bool": "boolean"}
TYPE_KEY = "inferred_type"


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet or CSV source as text: every column a string, nothing inferred."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=False, enforceSchema=False)
    df = spark.read.parquet(path)
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def typed(df: DataFrame, casts: dict[str, str], strict: bool = False) -> DataFrame:
    """Apply declared casts to text columns. Values that do not fit become null, or fail the job when ``strict``."""

    def cast(name: str) -> Column:
        kind = casts.get(name)
        if kind is None:
            return F.col(name)
        target = SPARK_TYPES[kind]
        return (F.col(name).cast(target) if strict else F.col(name).try_cast(target)).alias(name)

    return df.select(*[cast(c) for c in df.columns])


def register(spark: SparkSession, paths: dict[str, str], casts: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """Typed tables by name, also as temporary views."""
    declared = CASTS if casts is None else casts
    out = {name: typed(read_raw(spark, path), declared.get(name, {})) for name, path in paths.items()}
    for name, df in out.items():
        df.createOrReplaceTempView(name)
    return out


def read_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A source with types inferred from its values (CSV) or as stored (Parquet)."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.parquet(path)


def retype(df: DataFrame) -> DataFrame:
    """Types recorded in the column metadata of a text table, put back on its columns."""
    return df.select(*[
        F.col(f.name).cast(f.metadata[TYPE_KEY]).alias(f.name) if TYPE_KEY in f.metadata else F.col(f.name)
        for f in df.schema.fields])


class Tables:
    """Typed tables of one directory, by attribute; all names are checked when it is opened."""

    def __init__(self, spark: SparkSession, base: str, names: list[str], suffix: str = ".parquet"):
        missing, self._tables = [], {}
        for name in names:
            try:
                self._tables[name] = spark.read.parquet(f"{base}/{name}{suffix}")
            except AnalysisException:
                missing.append(name)
        if missing:
            raise FileNotFoundError(f"missing under {base}: {', '.join(missing)}")

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["_tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def names(self) -> list[str]:
        return list(self._tables)


def open_model(spark: SparkSession, base: str) -> Tables:
    """All tables of the operational model from a directory of Parquet files or folders."""
    return Tables(spark, base, list(CASTS))
