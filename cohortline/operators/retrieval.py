"""Nearest entries of a vector catalogue, and how well they answer a labelled set of queries."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import order_statistics

BLOCK = 4096  # rows of a block, about; two blocks meet in one matrix product


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1.0, norm)


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(float))


def _met(queries: DataFrame, catalogue: DataFrame, block: int):
    """Queries and catalogue dealt into blocks, every block of the one grouped with every block of the other."""
    def parts(df: DataFrame) -> int:
        return max(1, math.ceil(df.count() / block))

    q, c = parts(queries), parts(catalogue)
    asked = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(q)).cast("int")).withColumn(
        "_c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    held = catalogue.withColumn("_c", F.pmod(F.xxhash64("entry_id"), F.lit(c)).cast("int")).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(q - 1))))
    return asked.groupBy("_q", "_c").cogroup(held.groupBy("_q", "_c"))


def top_k_cosine(catalogue: DataFrame, queries: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """The ``k`` catalogue entries (``entry_id``, ``vector``) most similar to each query (``query_id``, ``vector``).

    Exact, for any number of queries: a block of queries meets a block of the
    catalogue in one matrix product, which passes on its own ``k`` best per query.
    """
    kind = dict(queries.dtypes)["query_id"], dict(catalogue.dtypes)["entry_id"]

    def best(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "entry_id": [], "score": []})
        scores = _matrix(asked["vector"]) @ _matrix(held["vector"]).T
        keep = min(k, len(held))
        entries = held["entry_id"].to_numpy()
        order = np.lexsort((np.broadcast_to(entries, scores.shape), -scores))[:, :keep]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), keep), "entry_id": entries[order].reshape(-1),
                             "score": np.take_along_axis(scores, order, 1).reshape(-1)})

    found = _met(queries.select("query_id", "vector"), catalogue.select("entry_id", "vector"), block).applyInPandas(
        best, f"query_id {kind[0]}, entry_id {kind[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.round("score", 12).desc(), F.col("entry_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def gold_ranks(catalogue: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Zero-based rank of each query's gold entry: the number of entries scoring higher.

    ``queries`` carry ``gold_id``. Blocks only report counts per query.
    """
    gold = queries.join(catalogue.select(F.col("entry_id").alias("gold_id"), F.col("vector").alias("gold_vector")), "gold_id").select(
        "query_id", "vector", "gold_vector")
    kind = dict(queries.dtypes)["query_id"]

    def higher(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"query_id": [], "above": []})
        q = _matrix(asked["vector"])
        bar = (q * _matrix(asked["gold_vector"])).sum(axis=1)
        above = (q @ _matrix(held["vector"]).T > bar[:, None] + 1e-12).sum(axis=1) if len(held) else np.zeros(len(q), int)
        return pd.DataFrame({"query_id": asked["query_id"].to_numpy(), "above": above})

    counted = _met(gold, catalogue.select("entry_id", "vector"), block).applyInPandas(higher, f"query_id {kind}, above long")
    return counted.groupBy("query_id").agg(F.sum("above").alias("rank"))


def recall_report(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """Share of queries whose gold entry is within the first k, and order statistics of its rank."""
    def place(p: float):
        return p, F.least(F.col("_n") - 1, F.floor(F.col("_n") * p))

    orders = order_statistics(ranks, [], "rank", {"median_rank": place(0.5), "p90_rank": place(0.9), "p99_rank": place(0.99)})
    shares = ranks.agg(F.count(F.lit(1)).alias("queries"), *[
        F.avg(F.when(F.col("rank") < k, 1.0).otherwise(0.0)).alias(f"recall_{k}") for k in ks], F.max("rank").alias("worst_rank"))
    return shares.withColumns({c: orders.select(F.col(c).cast("long")).scalar() for c in orders.columns})


def crowding(top: DataFrame, query_family: DataFrame, entry_family: DataFrame) -> DataFrame:
    """Entries of the query's own family among its top k, averaged and at most."""
    same = top.join(query_family, "query_id").join(entry_family, "entry_id").groupBy("query_id").agg(
        F.count(F.when(F.col("query_family") == F.col("entry_family"), 1)).alias("same"))
    return same.agg(F.avg("same").alias("mean_same"), F.max("same").alias("max_same"))


def zones(top: DataFrame, lowest: float = 0.30, clear: float = 0.50, margin: float = 0.015) -> DataFrame:
    """Whether the first two scores of a query let it proceed, leave it ambiguous, or match nothing."""
    pairs = top.where(F.col("rank") <= 2).groupBy("query_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"))
    close = (F.col("first") < clear) & (F.col("first") - F.col("second") < margin)
    return pairs.withColumn("zone", F.when(F.col("first").isNull() | (F.col("first") < lowest), "no_match")
                            .when(F.coalesce(close, F.lit(False)), "ambiguous").otherwise("proceed"))
