"""Conciseness, impact and score of a candidate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import count_of
from .spec import ViewSpec

CATEGORIES = ("HIGHLIGHT_CHANGE", "TYPE_CHANGE", "NO_PATTERN")
GAMMA = 0.5


def entropy_bound(tau: float = 0.5, r: float = 1.0, k: int = 3) -> float:
    """The largest entropy a candidate can have."""
    root = tau ** (1.0 / r)
    if k < (1 - tau) * math.e / root:
        return -math.log2(tau) + r * (k * root / math.e) * math.log2(math.e / (k * root))
    return -tau * math.log2(tau) - r * (1 - tau) * math.log2((1 - tau) / k)


def _plogp(p: Column) -> Column:
    return F.when(p > 0, -p * F.log2(p)).otherwise(0.0)


def entropy(r: float = 1.0) -> Column:
    """Entropy of the shares of the common sets and of the exception categories."""
    common = F.aggregate("commonness", F.lit(0.0), lambda a, s: a + _plogp(s["proportion"]))
    odd = sum((_plogp(count_of(c) / F.col("hdp_size")) for c in CATEGORIES), F.lit(0.0))
    return common + F.lit(float(r)) * odd


def conciseness(gamma: float | Column = GAMMA, tau: float = 0.5, r: float = 1.0, k: int = 3) -> Column:
    """One minus the entropy's part of its bound; having no exceptions costs ``gamma``."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    cost = entropy(r) + F.when(F.size("exceptions") == 0, g).otherwise(0.0)
    return F.greatest(F.lit(0.0), 1.0 - cost / F.lit(entropy_bound(tau, r, k)))


def with_impact(candidates: DataFrame, spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """The largest impact over the impact measures, and the measure that gives it.

    The first of equals counts; impacts closer than 1e-9 are equal, since sums of shares differ in their last digits.

    A group that varies a filter adds up its members' impacts, at most 1; other groups have their subspace's.
    """
    names = [f"i_{m}" for m in spec.impact]
    wider = spaces.select(*names, F.posexplode("filters").alias("pos", "ext"), "filters").select(
        F.lit("subspace").alias("strategy"), F.col("ext.dim").alias("ext_dim"),
        F.filter("filters", lambda p, i: i != F.col("pos")).alias("base"), *names)
    summed = wider.groupBy("strategy", "ext_dim", "base").agg(*[F.least(F.lit(1.0), F.sum(c)).alias(c) for c in names])
    varied = candidates.where(F.col("strategy") == "subspace").join(summed, ["strategy", "ext_dim", "base"], "left")
    fixed = candidates.where(F.col("strategy") != "subspace").join(
        spaces.select(F.col("filters").alias("base"), *names), "base", "left")
    both = varied.unionByName(fixed)
    best, which = F.lit(0.0), F.lit(spec.impact[0])
    for m, c in zip(spec.impact, names):
        value = F.coalesce(F.col(c), F.lit(0.0))
        which = F.when(value > best + 1e-9, F.lit(m)).otherwise(which)
        best = F.greatest(best, value)
    return both.withColumns({"impact": best, "impact_measure": which}).drop(*names)


def scored(candidates: DataFrame, spaces: DataFrame, spec: ViewSpec, gamma: float = GAMMA) -> DataFrame:
    """Candidates with conciseness, impact and their product; those that score nothing are dropped."""
    out = with_impact(candidates, spaces, spec).withColumn("conciseness", conciseness(gamma, spec.tau))
    return out.withColumn("score", F.col("conciseness") * F.col("impact")).where(F.col("score") > 0)


def rescored(candidates: DataFrame, gammas: list[float], tau: float = 0.5) -> DataFrame:
    """Every candidate once per ``gamma``, with conciseness and score computed anew."""
    each = candidates.withColumn("gamma", F.explode(F.array(*[F.lit(float(g)) for g in gammas])))
    each = each.withColumn("conciseness", conciseness(F.col("gamma"), tau))
    return each.withColumn("score", F.col("conciseness") * F.col("impact"))
