"""Session-level helpers: lineage cuts and session construction for local runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FALLBACK: dict[str, str] = {}  # by application, the folder of a local session that names none


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "cohortline") -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


# What a task sorts before its first shuffle, or after one, is to fit in its memory: rows take some eight times the room they take in a file.
PIECES = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m"}


def in_small_pieces(spark: SparkSession) -> SparkSession:
    """Read large tables, and what was shuffled, in pieces that are sorted without spilling; sizes that the session was given stay."""
    for key, size in PIECES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
    return spark


def for_hot_keys(spark: SparkSession) -> SparkSession:
    """Let adaptive execution split hot join keys even where that costs a further shuffle."""
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster that
    folder would not be visible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="cohortline-checkpoint-")
    return _FALLBACK[app]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Later steps start from the table: a lost executor costs a re-read, not a
    re-run, and columns and row groups can be skipped when it is read again.
    The tables stay until ``release``, as results are built on them.
    """
    spark = df.sparkSession
    path = f"{cuts(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def cuts(spark: SparkSession) -> str:
    """Where this application's lineage cuts lie."""
    return f"{checkpoint_dir(spark)}/cohortline-cut-{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete this application's lineage cuts, once no result that was built on them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cuts(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
