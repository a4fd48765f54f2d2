"""Sibling groups of scopes, their common pattern and the exceptions to it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import rnd
from .spec import ViewSpec

KEY = ["strategy", "ext_dim", "breakdown", "measure", "base"]
VARIES = "(varies)"


def domains(spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """The values of each dimension over the whole view, and how many there are."""
    one = spaces.where(F.size("filters") == 1).select(F.expr("filters[0].dim").alias("ext_dim"),
                                                      F.expr("filters[0].value").alias("value"))
    return one.groupBy("ext_dim").agg(F.sort_array(F.collect_set("value")).alias("domain")).withColumn(
        "hdp_size", F.size("domain"))


def members(evaluated: DataFrame, spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """Scopes as members of every sibling group they belong to.

    A group varies one filter dimension over all of its values, or the measure,
    or the time grain, with everything else fixed.
    """
    scored = evaluated.join(spaces.select("filters", "max_impact"), "filters")
    common = ["member", "hits", "max_impact", "hdp_size"]
    parts = []
    varied = scored.select("*", F.posexplode("filters").alias("pos", "ext")).select(
        F.lit("subspace").alias("strategy"), F.col("ext.dim").alias("ext_dim"), "breakdown", "measure",
        F.filter("filters", lambda p, i: i != F.col("pos")).alias("base"), F.col("ext.value").alias("member"), "hits",
        "max_impact")
    sizes = domains(spaces, spec).where(F.col("hdp_size") >= spec.min_members).select("ext_dim", "hdp_size")
    parts.append(varied.join(sizes, "ext_dim").select(*KEY, *common))
    if len(spec.measures) >= spec.min_members:
        parts.append(scored.select(
            F.lit("measure").alias("strategy"), F.lit("measure").alias("ext_dim"), "breakdown", F.lit(VARIES).alias("measure"),
            F.col("filters").alias("base"), F.col("measure").alias("member"), "hits", "max_impact",
            F.lit(len(spec.measures)).alias("hdp_size")).select(*KEY, *common))
    if len(spec.temporal) >= spec.min_members:
        parts.append(scored.where("is_temporal").select(
            F.lit("breakdown").alias("strategy"), F.lit("temporal_grain").alias("ext_dim"), F.lit(VARIES).alias("breakdown"),
            "measure", F.col("filters").alias("base"), F.col("breakdown").alias("member"), "hits", "max_impact",
            F.lit(len(spec.temporal)).alias("hdp_size")).select(*KEY, *common))
    return reduce(DataFrame.unionByName, parts)


def commonness(member_rows: DataFrame, spec: ViewSpec) -> DataFrame:
    """Groups and pattern types in which more than ``tau`` of the members share a highlight."""
    hit = member_rows.select(*KEY, "hdp_size", "member", "max_impact", F.explode("hits").alias("h")).select(
        *KEY, "hdp_size", "member", "max_impact", F.col("h.type").alias("pattern_type"), F.col("h.highlight").alias("highlight"))
    same = hit.groupBy(*KEY, "hdp_size", "pattern_type", "highlight").agg(
        F.sort_array(F.collect_list("member")).alias("members"), F.count(F.lit(1)).alias("count"),
        F.max("max_impact").alias("top_impact"))
    share = F.col("count") / F.col("hdp_size")
    found = F.when(share > spec.tau, F.struct("highlight", "members", "count", rnd(share, 4).alias("proportion")))
    sets = same.groupBy(*KEY, "hdp_size", "pattern_type").agg(
        F.sort_array(F.collect_list(found)).alias("commonness"), F.max("top_impact").alias("hit_impact"))
    return sets.where(F.size("commonness") > 0)


def triggered(common: DataFrame, evaluated: DataFrame, spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """Groups reached from a scope of enough impact: one of the members, or the base scope they refine."""
    strong = spaces.where(F.col("max_impact") >= spec.min_impact).select("filters")
    parents = evaluated.join(strong, "filters", "left_semi").select(
        F.col("filters").alias("base"), "breakdown", "measure", F.explode("hits").alias("h")).select(
        "base", "breakdown", "measure", F.col("h.type").alias("pattern_type"), F.lit("subspace").alias("strategy"),
        F.lit(True).alias("_from_base"))
    out = common.join(parents, ["strategy", "base", "breakdown", "measure", "pattern_type"], "left")
    return out.where((F.col("hit_impact") >= spec.min_impact) | F.col("_from_base")).drop("_from_base", "hit_impact")


def exceptions(groups: DataFrame, member_rows: DataFrame, spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """Add what the other members show: another highlight, another type, or no pattern.

    Members without any data belong to the group too and show no pattern.
    """
    in_common = F.exists("commonness", lambda s: F.array_contains(s["members"], F.col("member")))
    own = F.filter("hits", lambda h: h["type"] == F.col("pattern_type"))
    category = (F.when(F.size(own) > 0, "HIGHLIGHT_CHANGE").when(F.size("hits") > 0, "TYPE_CHANGE").otherwise("NO_PATTERN"))
    kind = (F.when(F.size(own) > 0, F.col("pattern_type")).when(F.size("hits") > 0, "OTHER_PATTERN").otherwise("NO_PATTERN"))
    rows = groups.join(member_rows.select(*KEY, "member", "hits"), KEY).withColumn(
        "one", F.struct(F.col("member").alias("member_label"), category.alias("category"),
                        F.get(F.transform(own, lambda h: h["highlight"]), F.lit(0)).alias("highlight"), kind.alias("pattern_type")))
    told = rows.groupBy(*KEY, "hdp_size", "pattern_type", "commonness").agg(
        F.collect_list(F.when(~in_common, F.col("one"))).alias("told"), F.collect_set("member").alias("present"))
    told = told.join(domains(spaces, spec).select("ext_dim", "domain"), "ext_dim", "left")
    silent = F.transform(
        F.when(F.col("strategy") == "subspace", F.array_except("domain", "present")).otherwise(F.array().cast("array<string>")),
        lambda v: F.struct(v.alias("member_label"), F.lit("NO_PATTERN").alias("category"),
                           F.lit(None).cast("array<string>").alias("highlight"), F.lit("NO_PATTERN").alias("pattern_type")))
    return told.withColumn("exceptions", F.sort_array(F.concat("told", silent))).drop("told", "present", "domain")


def count_of(category: str) -> Column:
    return F.size(F.filter("exceptions", lambda e: e["category"] == category))
