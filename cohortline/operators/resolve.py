"""Resolving free-text names against a registry: exact, alias, then similar spelling."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut_lineage
from .spelling import Bigrams, nearest

TIGHT = 0.9  # names with a match this close are settled before looser matches are looked for
HINTS = 3  # suggestions, and the rarest bigrams of a name that they come from
BLOCK = 512  # registered names of a block, about
ASKED, KNOWN, SIGNS = 1024, 1 << 16, 1 << 21  # asked names, registered ones and their signs, of two blocks that are searched in one piece, about
NAME = ["entity_type", "norm"]


def registry(columns: dict[str, tuple[DataFrame, str]], fixed: dict[str, list[str]] | None = None) -> DataFrame:
    """Distinct non-null values per entity type, from (table, column) pairs and fixed lists."""
    parts = [df.select(F.lit(kind).alias("entity_type"), F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
             for kind, (df, c) in columns.items()]
    if fixed:
        spark = parts[0].sparkSession
        parts.append(spark.createDataFrame([(k, v) for k, vs in fixed.items() for v in vs], "entity_type string, value string"))
    return reduce(DataFrame.unionByName, parts)


def similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length; 1 for equal texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


# The cut-off of the fuzzy step in percent, by type of entity; 100 means no such step.
CUTOFFS = {"district": 85, "district_2": 85, "division": 85, "division_2": 85, "block": 80, "specialty": 90, "hospital": 72,
           "claim_status": 85, "diagnosis_category": 85, "year": 100, "month": 100, "hospital_type": 100}
# Words that mean the whole state and are no place.
WHOLE_STATE = ("up", "uttar pradesh", "state", "all", "entire state")
PLACES = ("district", "district_2", "block", "division", "division_2")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring signs, with a mark before the first and one after the last."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(marked, i, F.lit(2)))


def _counted(held: DataFrame) -> DataFrame:
    """How many names of a type hold each bigram."""
    return held.select("entity_type", F.explode(F.array_distinct(bigrams(F.col("norm")))).alias("gram")).groupBy(
        "entity_type", "gram").agg(F.count(F.lit(1)).alias("held"))


def _searched(asked: DataFrame, known: DataFrame, search: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], ddl: str) -> DataFrame:
    """What ``search`` finds for blocks of asked names (entity_type, norm, ...) and of registered ones (entity_type, other, ...) of a type, each of which meet once."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / KNOWN, F.sum(F.length("other")) / SIGNS)).cast("int").alias("_blocks")
    sizes = asked.groupBy("entity_type").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("_parts")).join(
        known.groupBy("entity_type").agg(F.greatest(blocks, F.lit(1)).alias("_blocks")), "entity_type")
    every = {c: F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for c, n in (("_a", "_parts"), ("_k", "_blocks"))}
    dealt = {c: F.pmod(F.xxhash64(by), F.col(n)).cast("int") for c, by, n in (("_a", "norm", "_parts"), ("_k", "other", "_blocks"))}
    # few rows go in and many are compared: the tasks are dealt by block, however small the input is
    tasks, keys = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["entity_type", "_a", "_k"]
    a = asked.join(sizes, "entity_type").withColumn("_a", dealt["_a"]).withColumn("_k", every["_k"]).drop("_parts", "_blocks")
    k = known.join(sizes, "entity_type").withColumn("_k", dealt["_k"]).withColumn("_a", every["_a"]).drop("_parts", "_blocks")

    def both(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return search(left, right) if len(left) and len(right) else search(left[:0], right[:0])

    return a.repartition(tasks, *keys).groupBy(*keys).cogroup(k.repartition(tasks, *keys).groupBy(*keys)).applyInPandas(both, ddl)


def _near(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Of the registered names (entity_type, other, value) at least ``share`` alike the one most like each asked one (entity_type, norm, share), equals by value; none missed."""
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame({"entity_type": left["entity_type"], "norm": left["norm"], "other": None, "value": None, "share": left["share"]})
        if not len(left):
            return found
        best = nearest(left["norm"].tolist(), 1 - left["share"].to_numpy(), right["other"].tolist(), right["value"].tolist())
        found["other"], found["value"] = (right[c].to_numpy(object)[best] for c in ("other", "value"))
        return found[best >= 0]

    found = _searched(asked, known, search, "entity_type string, norm string, other string, value string, share double")
    found = found.withColumn("sim", F.round(similarity(F.col("norm"), F.col("other")), 9)).where(F.col("sim") * 100 >= F.col("share") * 100)
    return found.groupBy(*NAME).agg(F.min_by("value", F.struct(-F.col("sim"), F.col("value"))).alias("near"))


def _blockwise(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Every name of ``asked`` with every row of ``values`` (entity_type, value) of its type, a block of them at a time."""
    sizes = values.groupBy("entity_type").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("_blocks"))
    dealt = values.join(sizes, "entity_type").withColumn("_b", F.pmod(F.xxhash64("value"), F.col("_blocks")).cast("int")).drop("_blocks")
    # few rows go in and many pairs come out: the tasks are dealt by name and block, however small the input is
    tasks = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = asked.select(*NAME).distinct().join(sizes, "entity_type").withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks").repartition(tasks, *NAME, "_b")
    return spread.join(dealt, ["entity_type", "_b"])


def _closest(asked: DataFrame, values: DataFrame) -> DataFrame:
    """Of all values of a type the few most like each name, joined; every name is compared with every value."""
    known = cut_lineage(values.where(F.col("value").isNotNull()).select("entity_type", "value").distinct())
    scored = _blockwise(asked, known).withColumn("sim", F.round(similarity(F.col("norm"), F.lower("value")), 9))
    best = Window.partitionBy(*NAME).orderBy(F.desc("sim"), "value")
    top = scored.select(*NAME, "value", "sim").withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= HINTS)
    return top.groupBy(*NAME).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda r: r["value"]), ";").alias("hints"))


def _hints(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Of the values that hold one of a name's rarest known bigrams those that share most bigrams with it."""
    grams = asked.select(*NAME, F.explode(F.array_distinct(bigrams(F.col("norm")))).alias("gram"))
    counted = _counted(known.select("entity_type", F.col("other").alias("norm")))
    rare = grams.join(counted, ["entity_type", "gram"]).groupBy(*NAME).agg(
        F.transform(F.slice(F.array_sort(F.collect_list(F.struct("held", "gram"))), 1, HINTS), lambda r: r["gram"]).alias("rare"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names, values, rows = right["other"].tolist(), right["value"].tolist(), []
        held = Bigrams(names) if names else None
        for kind, norm, grams in zip(left["entity_type"], left["norm"], left["rare"]):
            rows += [(kind, norm, names[i], values[i], int(n)) for i, n in zip(*held.sharing(norm, list(grams), HINTS))]
        return pd.DataFrame(rows, columns=["entity_type", "norm", "other", "value", "shared"])

    met = _searched(rare, known, search, "entity_type string, norm string, other string, value string, shared int")
    best = Window.partitionBy(*NAME).orderBy(F.desc("shared"), "other")
    top = met.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= HINTS)
    return top.groupBy(*NAME).agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))), lambda r: r["value"]), ";").alias("hints"))


def resolve_entities(raw: DataFrame, values: DataFrame, aliases: dict[str, dict[str, str]] | None = None,
                     cutoffs: dict[str, float] | None = None, closest: bool = False) -> DataFrame:
    """``(entity_type, raw, resolved, confidence, suggestions)``, a row per distinct ``(entity_type, raw)`` of ``raw``.

    ``values`` is a registry of (entity_type, value). Exact matches (ignoring case and surrounding
    space) and the type's aliases are joins. What they leave is looked up in the registered names of its
    type by their beginnings: those at least ``TIGHT`` alike, then, for names without one, those down to the
    cut-off; the most alike is taken. ``cutoffs`` are in percent, 50 at least, and by type (85 where none
    is given). A name that matches nothing gets up to three suggestions by shared bigrams, or with
    ``closest`` the three values of its type that are spelled most like it. Words for the whole state
    are refused for places.
    """
    cutoffs = CUTOFFS if cutoffs is None else cutoffs
    if any(percent < 50 for percent in cutoffs.values()):
        raise ValueError("names less than half alike need not share a bigram: give a cut-off of 50 at least")
    asked = raw.select("entity_type", "raw").where(F.col("raw").isNotNull()).distinct().withColumn("norm", F.lower(F.trim("raw")))
    exact = values.where(F.col("value").isNotNull()).groupBy("entity_type", F.lower("value").alias("norm")).agg(F.min("value").alias("exact"))
    found = asked.join(exact, NAME, "left")
    told = [(kind, k.lower(), v) for kind, table in (aliases or {}).items() for k, v in table.items()]
    other = raw.sparkSession.createDataFrame(told, "entity_type string, norm string, alias string")
    state = F.col("entity_type").isin(*PLACES) & F.col("norm").isin(*WHOLE_STATE)
    found = cut_lineage(found.join(other, NAME, "left").withColumn("refused", F.coalesce(state, F.lit(False))))
    known = found.where(F.col("refused") | F.col("exact").isNotNull() | F.col("alias").isNotNull()).select(
        "entity_type", "raw", F.when(~F.col("refused"), F.coalesce("exact", "alias")).alias("resolved"),
        F.when(F.col("refused"), "refused").when(F.col("exact").isNotNull(), "exact").otherwise("alias").alias("confidence"),
        F.lit(None).cast("string").alias("suggestions"))

    rest = found.where(~F.col("refused") & F.col("exact").isNull() & F.col("alias").isNull()).select("entity_type", "raw", "norm")
    known_names = cut_lineage(exact.where(F.col("entity_type").isNotNull()).select("entity_type", F.col("norm").alias("other"), F.col("exact").alias("value")))
    cutoff = F.lit(85.0)
    for kind, percent in cutoffs.items():
        cutoff = F.when(F.col("entity_type") == kind, float(percent)).otherwise(cutoff)
    open_ = cut_lineage(rest.where(F.col("entity_type").isNotNull()).select(*NAME, (cutoff / 100).alias("share")).distinct())
    near = cut_lineage(_near(open_.where("share < 1").withColumn("share", F.greatest("share", F.lit(TIGHT))), known_names))
    loose = cut_lineage(_near(open_.where(F.col("share") < TIGHT).join(near, NAME, "left_anti"), known_names))
    matched = near.unionByName(loose)
    lost = open_.join(matched, NAME, "left_anti")
    hints = _closest(lost, values) if closest else _hints(lost, known_names)
    spelled = rest.join(matched, NAME, "left").join(hints, NAME, "left").select(
        "entity_type", "raw", F.col("near").alias("resolved"), F.when(F.col("near").isNotNull(), "fuzzy").otherwise("unmatched").alias("confidence"),
        F.when(F.col("near").isNull(), F.coalesce("hints", F.lit(""))).alias("suggestions"))
    return known.unionByName(spelled)


def resolve(raw: DataFrame, column: str, values: DataFrame, aliases: dict[str, str] | None = None, cutoff: float = 0.8) -> DataFrame:
    """``resolve_entities`` for a single type: one row per distinct value of ``column``, the cut-off as a share."""
    kind = F.lit("").alias("entity_type")
    return resolve_entities(raw.select(kind, F.col(column).alias("raw")), values.select(kind, "value"), {"": aliases or {}},
                            {"": cutoff * 100}, closest=True).drop("entity_type")
