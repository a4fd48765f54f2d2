"""Mining over whole views: every dimension, measure and time grain, at the real floor.

The questions about single steps are asked of hospital performance (two filters, 20 measures) and, where they are
about time, of the district-month cube; all four views are mined in full.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.functions.numbers import rnd
from cohortline.operators.mining import engine, enrich, groups, patterns, ranking, scopes, scoring, spec
from cohortline.plans import views
from cohortline.runtime import cut_lineage
from cohortline.sources import sinks

from .common import Query, bound
from .foundation import scratch

VIEWS = {"sites": (views.hospital_performance, spec.HOSPITAL_PERFORMANCE), "months": (views.district_month_cube, spec.DISTRICT_MONTH_CUBE),
         "people": (views.beneficiary_journey, spec.BENEFICIARY_JOURNEY), "claims": (views.claims_lifecycle, spec.CLAIMS_LIFECYCLE)}
#: Questions about time, asked of the district-month cube.
OVER_TIME = ("M6_7_trend", "M6_8_outlier", "M6_9_seasonality", "M6_10_change_point", "M6_11_unimodality", "M7_type_eligibility", "M8_three_way_label_in_time",
             "M11_breakdown_groups")
GAMMAS = [0.1, 0.3, 0.5, 0.8]


_MINED: dict[tuple[str, str, str], engine.Mined] = {}
_LOCK = threading.Lock()


def mined(t, which: str = "sites") -> engine.Mined:
    """A view mined once per session and directory: the tables it leaves behind answer all the questions below."""
    key = (t.spark.sparkContext.applicationId, t.directory, which)
    with _LOCK:
        if key not in _MINED:
            view, what = VIEWS[which]
            _MINED[key] = engine.mine(view(t), what)
        return _MINED[key]


def spaces(t):
    return mined(t).spaces


def spread(t):
    m = mined(t)
    return scopes.distributions(m.cells, m.spec)


def text_filters(df, column="filters"):
    return df.withColumn("subspace", scopes.subspace_text(column)).drop(column)


def long_distribution(t):
    rows = text_filters(spread(t)).select("subspace", "breakdown", "measure", F.explode("dist").alias("p"))
    return rows.select("subspace", "breakdown", "measure", "p.label", rnd("p.value", 6).alias("value"))


_EVERY: dict[tuple[str, str, str], DataFrame] = {}


def every_scope(t, which: str = "sites") -> DataFrame:
    """Every scope, of whatever impact, with the patterns it shows; evaluated once like the mining itself."""
    m = mined(t, which)
    key = (t.spark.sparkContext.applicationId, t.directory, which)
    with _LOCK:
        if key not in _EVERY:
            _EVERY[key] = cut_lineage(patterns.evaluate(scopes.distributions(m.cells, m.spec)).drop("dist"))
        return _EVERY[key]


def pattern(name, which):
    def build(t):
        found = every_scope(t, which).select("filters", "breakdown", "measure", F.explode("hits").alias("h")).where(
            F.col("h.type") == name)
        return text_filters(found).select("subspace", "breakdown", "measure", F.array_join("h.highlight", ",").alias("highlight"))

    return build


def eligibility(t):
    found = every_scope(t, "months").select("is_temporal", F.explode("hits").alias("h"))
    return found.groupBy("is_temporal").agg(F.array_join(F.array_sort(F.collect_set("h.type")), ",").alias("types"))


def three_way(kind, which="sites"):
    """Label of every scope that one requested type can be asked of."""
    return lambda t: text_filters(patterns.three_way(every_scope(t, which), kind)).select("subspace", "breakdown", "measure", "label")


def sibling_groups(strategy, which="sites"):
    def build(t):
        m = mined(t, which)
        rows = m.members.where(F.col("strategy") == strategy)
        return rows.groupBy(*groups.KEY, "hdp_size").agg(F.count(F.lit(1)).alias("with_data")).withColumn(
            "base", scopes.subspace_text("base")).drop("strategy")

    return build


def flat(df, scores=("conciseness", "impact", "score")):
    out = engine.flat(df)
    return out.withColumns({c: rnd(c, 6) for c in scores if c in out.columns})


def commonness(t):
    keep = ["strategy", "ext_dim", "pattern_type", "breakdown", "measure", "base", "hdp_size", "common", "n_highlight_change",
            "n_type_change", "n_no_pattern"]
    return flat(mined(t).candidates).select(*keep)


def dedup(t):
    """Groups are formed by key, so none occurs twice."""
    m = mined(t)
    keys = m.candidates.groupBy(*groups.KEY, "pattern_type").agg(F.count(F.lit(1)).alias("n"))
    return keys.agg(F.max("n").alias("most_copies"))


def ranked(t):
    return ranking.greedy_rank(mined(t).candidates, k=15)


def with_rank(t):
    return flat(ranked(t)).join(ranked_keys(t), ["strategy", "ext_dim", "pattern_type", "breakdown", "measure", "base"])


def ranked_keys(t):
    return ranked(t).select("strategy", "ext_dim", "pattern_type", "breakdown", "measure",
                            scopes.subspace_text("base").alias("base"), "rank", rnd("gain", 6).alias("gain"))


def gamma_changes(t):
    each = scoring.rescored(mined(t).candidates, GAMMAS)
    return ranking.changes(ranking.top_by_gamma(each), 0.1)


def figures(t):
    m = mined(t)
    best = ranking.greedy_rank(m.candidates, k=15).where(F.col("strategy") == "subspace")
    out = enrich.with_figures(best, m.scopes, m.cells, m.spec)

    def text(column):
        return F.array_join(F.transform(column, lambda p: F.concat_ws(":", p["label"], p["value"].cast("string"),
                                                                     p["share_pct"].cast("string"))), ";")

    return out.select("cid", "total", "n_values", text("top_values").alias("top"), text("bottom_values").alias("bottom"),
                      text("highlight_values").alias("highlighted"),
                      F.to_json("sample_sizes").alias("sizes"))


def summaries(t):
    return enrich.with_summary(ranked(t)).select("rank", "summary")


def json_round_trip(t):
    c = mined(t).candidates.select(*ranking.IDENTITY, "hdp_size", "commonness", "exceptions", "score")
    path = f"{scratch(t.spark)}/candidates"
    sinks.save_json(c, path)
    return flat(sinks.load_json(t.spark, path, c.schema), ("score",))


def whole(which):
    """Everything that a view has to say."""
    return lambda t: flat(mined(t, which).candidates)


def mining_queries() -> dict[str, Query]:
    b = bound
    out = {
        "M1_subspaces": b(lambda t: text_filters(spaces(t)).select("subspace")),
        "M2_subspace_impact": b(lambda t: text_filters(spaces(t)).select(
            "subspace", *[rnd(f"i_{m}", 9).alias(f"i_{m}") for m in spec.HOSPITAL_PERFORMANCE.impact], rnd("max_impact", 9).alias("max_impact"))),
        "M3_impact_pruning": b(lambda t: text_filters(spaces(t).where(F.col("max_impact") >= spec.HOSPITAL_PERFORMANCE.min_impact)).select(
            "subspace", rnd("max_impact", 9).alias("max_impact"))),
        "M4_data_scopes": b(lambda t: text_filters(spread(t)).groupBy("subspace").agg(
            F.count(F.lit(1)).alias("scopes"), F.countDistinct("breakdown").alias("breakdowns"))),
        "M5_distributions": b(long_distribution),
        "M7_type_eligibility": b(eligibility),
        "M8_three_way_label": b(three_way("EVENNESS")),
        "M8_three_way_label_in_time": b(three_way("OUTLIER", "months")),
        "M9_subspace_groups": b(sibling_groups("subspace")),
        "M10_measure_groups": b(sibling_groups("measure")),
        "M11_breakdown_groups": b(sibling_groups("breakdown", "months")),
        "M12_commonness_and_exceptions": b(commonness),
        "M13_group_dedup": b(dedup),
        "M14_conciseness": b(lambda t: flat(mined(t).candidates).select(
            "strategy", "ext_dim", "pattern_type", "breakdown", "measure", "base", "conciseness")),
        "M15_impact": b(lambda t: flat(mined(t).candidates).select(
            "strategy", "ext_dim", "pattern_type", "breakdown", "measure", "base", "impact", "impact_measure")),
        "M16_scored_candidates": b(lambda t: flat(mined(t).candidates)),
        "M16_hospital_performance_mined": b(whole("sites")),
        "M16_beneficiary_journey_mined": b(whole("people")),
        "M16_claims_lifecycle_mined": b(whole("claims")),
        "M16_district_month_mined": b(whole("months")),
        "M17_prefilter": b(lambda t: flat(ranking.prefilter(mined(t).candidates, 100))),
        "M18_overlaps": b(lambda t: ranking.overlaps(mined(t).candidates, ranking.prefilter(mined(t).candidates, 5)).select(
            "cid", "pick", rnd("ratio", 6).alias("ratio"), rnd("overlap", 6).alias("overlap"))),
        "M19_greedy_ranking": b(ranked_keys),
        "M20_total_use": b(lambda t: ranking.total_use(ranking.prefilter(mined(t).candidates, 15)).select(
            "n", rnd("score_sum", 6).alias("score_sum"), rnd("overlap_sum", 6).alias("overlap_sum"),
            rnd("total_use", 6).alias("total_use"))),
        "M21_rescored": b(lambda t: flat(scoring.rescored(mined(t).candidates, GAMMAS).withColumn(
            "measure", F.concat_ws("@", "measure", F.col("gamma").cast("string"))), ("conciseness", "impact", "score"))),
        "M21_gamma_changes": b(gamma_changes),
        "M22_figures": b(figures),
        "M23_summaries": b(summaries),
        "M24_type_statistics": b(lambda t: ranking.type_statistics(mined(t).candidates)),
        "M24_score_histogram": b(lambda t: ranking.score_histogram(mined(t).candidates)),
        "M24_best_per_breakdown": b(lambda t: ranking.best_per(mined(t).candidates, "breakdown", 10).select(
            "breakdown", "rank", "cid", rnd("score", 6).alias("score"))),
        "M25_diversity": b(lambda t: ranking.diversity(ranking.prefilter(mined(t).candidates, 15))),
        "S7_candidate_json": b(json_round_trip),
    }
    for i, name in enumerate(patterns.CATEGORICAL + patterns.TEMPORAL, 1):
        out[f"M6_{i}_{name.lower()}"] = b(pattern(name, "months" if name in patterns.TEMPORAL else "sites"))
    return out
