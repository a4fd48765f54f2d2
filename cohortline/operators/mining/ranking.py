"""Choosing a small diverse set of candidates, and comparing such sets."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ...functions.numbers import rnd
from ...runtime import cuts
from .scopes import subspace_text

IDENTITY = ["strategy", "pattern_type", "ext_dim", "breakdown", "measure", "base"]


def _told(text: Column) -> Column:
    """Text with the signs of a key marked, so that two keys are equal only if all their parts are."""
    return F.regexp_replace(text, r"([\\|=])", r"\\$1")


def identified(candidates: DataFrame) -> DataFrame:
    """Candidates with a readable key that tells them apart."""
    parts = [_told(F.col(c)) for c in ("pattern_type", "strategy", "ext_dim", "breakdown", "measure")]
    base = subspace_text(F.transform("base", lambda p: F.struct(_told(p["dim"]).alias("dim"), _told(p["value"]).alias("value"))))
    return candidates.withColumn("cid", F.concat_ws("|", *parts, base))


def prefilter(candidates: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` best by score; the key settles ties."""
    return identified(candidates).orderBy(rnd("score", 9).desc(), F.col("cid")).limit(limit)


def overlap_ratio(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """How far two candidates say the same, between 0 and 1; 0 for different strategies or pattern types."""
    sa, sb = F.size(a["base"]), F.size(b["base"])
    filters = (F.when((sa == 0) & (sb == 0), 1.0).when((sa == 0) | (sb == 0), 0.0)
               .otherwise(F.size(F.array_intersect(a["base"], b["base"])) / F.least(sa, sb)))

    def same(name: str) -> Column:
        return F.when(a[name] == b[name], 1.0).otherwise(0.0)

    ratio = (F.when(a["strategy"] == "subspace",
                    0.4 * filters + 0.3 * same("ext_dim") + 0.15 * same("measure") + 0.15 * same("breakdown"))
             .when(a["strategy"] == "measure", 0.6 * filters + 0.4 * same("breakdown"))
             .otherwise(0.6 * filters + 0.4 * same("measure")))
    alike = (a["strategy"] == b["strategy"]) & (a["pattern_type"] == b["pattern_type"])
    return F.when(alike, ratio).otherwise(0.0)


def _columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(f"{prefix}{c}") for c in IDENTITY}


def overlaps(candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """Overlap of every candidate with each of a few picks: the smaller score times the overlap ratio.

    Only candidates of a pick's strategy and pattern type meet it.
    """
    left = identified(candidates)
    right = identified(picks).select(*[F.col(c).alias(f"p_{c}") for c in (*IDENTITY, "score", "cid")])
    pairs = left.join(right, (F.col("strategy") == F.col("p_strategy")) & (F.col("pattern_type") == F.col("p_pattern_type"))
                      & (F.col("cid") != F.col("p_cid")))
    ratio = overlap_ratio(_columns(), _columns("p_"))
    return pairs.select("cid", F.col("p_cid").alias("pick"), "score", ratio.alias("ratio"),
                        (F.least("score", "p_score") * ratio).alias("overlap"))


def greedy_rank(candidates: DataFrame, k: int = 15) -> DataFrame:
    """The best candidate first, then each time the one that adds most score net of its overlap with those chosen.

    Stops after ``k`` or when nothing adds anything. All candidates take part, as rows of key and score that are
    written once, by strategy and pattern type: a choice takes from the gains of its own strategy and type only, so
    there is a best candidate for each of these, and a round looks again at the one group whose best was
    taken. What comes to the driver is a row per strategy and type, and a row per round. The candidates' nested parts
    are joined to the ``k`` choices at the end.
    """
    spark = candidates.sparkSession
    named = identified(candidates)
    path = f"{cuts(spark)}/pool-{uuid.uuid4().hex}"
    named.select(*IDENTITY, "score", "cid").write.partitionBy("strategy", "pattern_type").parquet(path)
    schema = named.select(*IDENTITY, "score", "cid").schema
    pool = spark.read.schema(schema).parquet(path)
    heads = {(r.strategy, r.pattern_type): r.b for r in pool.withColumn("gain", F.col("score")).groupBy("strategy", "pattern_type").agg(_best()).collect()}
    chosen: list[Row] = []
    while heads and len(chosen) < k:
        best = min(heads.values(), key=lambda r: (-_ninth(r.gain), -_ninth(r.score), r.cid.encode()))
        if chosen and best.gain <= 0:
            break
        chosen.append(best)
        mine = [c for c in chosen if (c.strategy, c.pattern_type) == (best.strategy, best.pattern_type)]
        group = pool.where((F.col("strategy") == best.strategy) & (F.col("pattern_type") == best.pattern_type) & ~F.col("cid").isin([c.cid for c in mine]))
        gain = F.col("score")
        for c in mine:
            pick = {n: _literal(c[n], schema[n].dataType) for n in IDENTITY}
            gain = gain - F.least(F.col("score"), F.lit(c.score)) * overlap_ratio(_columns(), pick)
        head = group.withColumn("gain", gain).agg(_best()).first().b
        if head is None:
            del heads[best.strategy, best.pattern_type]
        else:
            heads[best.strategy, best.pattern_type] = head
    picks = spark.createDataFrame([(c.cid, c.gain, i) for i, c in enumerate(chosen, 1)], "cid string, gain double, rank int")
    return named.join(F.broadcast(picks), "cid")  # k rows


def _best() -> Column:
    """The candidate that comes first by gain, score and key, as a struct."""
    described = F.struct(*IDENTITY, "score", "gain", "cid")
    return F.min_by(described, F.struct(-rnd("gain", 9), -rnd("score", 9), "cid")).alias("b")


def _ninth(x: float) -> float:
    """``rnd(x, 9)`` of a number."""
    return math.copysign(math.floor(abs(x) * 1e9 + 0.5), x) / 1e9


def _literal(value, kind) -> Column:
    if isinstance(value, list):
        parts = [F.struct(*[F.lit(v).alias(n) for n, v in zip(p.__fields__, p)]) for p in value]
        return F.array(*parts).cast(kind)
    return F.lit(value)


def total_use(selected: DataFrame) -> DataFrame:
    """Sum of the scores less the overlap of every pair of the selection (a selection has a handful of rows)."""
    pairs = overlaps(selected, selected).where(F.col("cid") < F.col("pick")).agg(
        F.coalesce(F.sum("overlap"), F.lit(0.0)).alias("overlap"))
    scores = identified(selected).agg(F.sum("score").alias("score_sum"), F.count(F.lit(1)).alias("n"))
    out = scores.withColumn("overlap_sum", pairs.scalar())
    return out.withColumn("total_use", F.col("score_sum") - F.col("overlap_sum"))


def diversity(selected: DataFrame) -> DataFrame:
    """Pattern types, extending dimensions and measures a selection covers."""
    def names(column):
        return F.array_join(F.array_sort(F.collect_set(column)), ", ")

    measure = F.when(F.col("measure") != "(varies)", F.col("measure"))
    return selected.agg(
        F.countDistinct("pattern_type").alias("n_types"), names("pattern_type").alias("types"),
        F.countDistinct("ext_dim").alias("n_dims"), names("ext_dim").alias("dims"),
        F.countDistinct(measure).alias("n_measures"), names(measure).alias("measures"),
        F.count(F.when(F.size("exceptions") > 0, 1)).alias("actionable"), F.count(F.lit(1)).alias("selected"))


def top_by_gamma(rescored: DataFrame, k: int = 15) -> DataFrame:
    """The first ``k`` candidates by score for every gamma."""
    order = Window.partitionBy("gamma").orderBy(rnd("score", 9).desc(), F.col("cid"))
    return identified(rescored).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def changes(selections: DataFrame, baseline: float) -> DataFrame:
    """What entered and what left each selection, against the one of the baseline gamma."""
    base = selections.where(F.col("gamma") == baseline).select("cid")
    gammas = selections.select("gamma").distinct().where(F.col("gamma") != baseline)
    others = selections.where(F.col("gamma") != baseline).select("gamma", "cid")
    entered = others.join(base, "cid", "left_anti").select("gamma", "cid", F.lit("entered").alias("change"))
    # One row per gamma: the baseline (k rows) is repeated for each by exploding the list of gammas.
    everywhere = base.withColumn("gamma", F.explode(gammas.agg(F.collect_set("gamma")).scalar()))
    left = everywhere.join(others, ["gamma", "cid"], "left_anti").select("gamma", "cid", F.lit("left").alias("change"))
    return entered.unionByName(left)


def type_statistics(candidates: DataFrame) -> DataFrame:
    """Candidates per pattern type, strategy, breakdown and extending dimension: all, with exceptions, best score."""
    keys = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value"))
                     for c in ("pattern_type", "strategy", "breakdown", "ext_dim")])
    rows = candidates.select("score", (F.size("exceptions") > 0).alias("odd"), F.explode(keys).alias("k"))
    return rows.groupBy("k.facet", "k.value").agg(
        F.count(F.lit(1)).alias("candidates"), F.count(F.when(F.col("odd"), 1)).alias("actionable"),
        rnd(F.max("score"), 6).alias("top_score"))


def score_histogram(candidates: DataFrame) -> DataFrame:
    """Candidates per score range of one fifth."""
    band = F.least(F.lit(4), F.floor(F.col("score") * 5)).cast("int")
    return candidates.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("candidates")).select(
        rnd(F.col("band") / 5.0, 1).alias("from_score"), rnd((F.col("band") + 1) / 5.0, 1).alias("to_score"), "candidates")


def best_per(candidates: DataFrame, facet: str, n: int = 10, actionable: bool = True) -> DataFrame:
    """The ``n`` best candidates of every value of a facet, by default only those with exceptions."""
    rows = identified(candidates.where(F.size("exceptions") > 0) if actionable else candidates)
    order = Window.partitionBy(facet).orderBy(rnd("score", 9).desc(), F.col("cid"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
