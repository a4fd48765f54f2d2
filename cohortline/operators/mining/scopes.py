"""Distributions of every measure over every breakdown of every subspace, without a loop over subspaces.

A *subspace* is a set of (dimension, value) filters, held as an array of
``struct<dim, value>`` in the order of the view's columns; a *scope* is a
subspace, a breakdown and a measure.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import rnd
from ...runtime import cut_lineage
from .spec import ViewSpec

PAIR = "struct<dim:string,value:string>"


# Separators inside a cell key; where they occur in a label they are written as the third sign and a letter.
_EQUALS, _AND, _SIGN = "\u0001", "\u0002", "\u0003"


def _held(label: Column) -> Column:
    for sign, letter in ((_SIGN, "c"), (_EQUALS, "a"), (_AND, "b")):
        label = F.replace(label, F.lit(sign), F.lit(_SIGN + letter))
    return label


def _freed(text: Column) -> Column:
    for sign, letter in ((_EQUALS, "a"), (_AND, "b"), (_SIGN, "c")):
        text = F.replace(text, F.lit(_SIGN + letter), F.lit(sign))
    return text


def _cell_key(columns: list[str]) -> Column:
    """Key of the cell a row belongs to in one column set; null when the row has no value in one of the columns."""
    if not columns:
        return F.lit("")
    parts = []
    for i, c in enumerate(columns):
        parts += [F.lit(("" if i == 0 else _AND) + c + _EQUALS), F.col(c)]
    return F.concat(*parts)


def cells(view: DataFrame, spec: ViewSpec, width: int = 10, inner: int = 5) -> DataFrame:
    """Sums (and counts, for averages) of every measure for every combination of values of every needed column set.

    A lattice of rollups. The view is read once per *wide* group of ``width`` columns, reduced to the combinations of
    their values (combined before the shuffle) and written; a missing value is a value there. Every
    narrower group, of ``inner`` columns, is summed from the smallest written group that has its columns, never from the view. Only
    these few rows are repeated, once per column set, and one last aggregation by cell merges all groups. Rows
    without a value in a column of a set belong to no cell of that set.
    """
    names = [m.name for m in spec.measures]
    averaged = [m.name for m in spec.measures if m.agg == "avg"]
    summed = [*[f"s_{m}" for m in names], *[f"c_{m}" for m in averaged]]
    base = view.select(*[_held(F.col(c).cast("string")).alias(c) for c in spec.columns],
                       *[F.col(m).cast("double").alias(f"m_{m}") for m in names])
    first = [F.sum(f"m_{m}").alias(f"s_{m}") for m in names] + [F.count(f"m_{m}").alias(f"c_{m}") for m in averaged]
    again = [F.sum(c).alias(c) for c in summed]
    written, narrow = [], []
    for columns, sets in spec.blocks(width):
        wide = cut_lineage(base.groupBy(*columns).agg(*first))
        written.append((wide.count(), set(columns), wide))
        narrow += spec.blocks(min(inner, width), sets)
    written.sort(key=lambda w: w[0])
    parts = []
    for columns, sets in narrow:
        _, _, source = next(w for w in written if w[1] >= set(columns))
        small = source.groupBy(*columns).agg(*again)
        keys = F.filter(F.array(*[_cell_key(s) for s in sets]), lambda k: k.isNotNull())
        parts.append(small.select(F.explode(keys).alias("cell"), *summed))
    merged = reduce(DataFrame.unionByName, parts).groupBy("cell").agg(*again)

    def pair(text):
        return F.struct(F.split_part(text, F.lit(_EQUALS), F.lit(1)).alias("dim"),
                        _freed(F.split_part(text, F.lit(_EQUALS), F.lit(2))).alias("value"))

    pairs = F.when(F.col("cell") == "", F.array().cast(f"array<{PAIR}>")).otherwise(
        F.transform(F.split("cell", _AND), pair))
    return merged.select(pairs.alias("pairs"), *summed)


def subspaces(cell_rows: DataFrame, spec: ViewSpec) -> DataFrame:
    """Every subspace with its impact per impact measure (its part of the overall sum) and the largest of them."""
    whole = cell_rows.where(F.size("pairs") == 0)
    rows = cell_rows.where((F.size("pairs") <= spec.depth) & ~F.exists("pairs", _is_temporal(spec)))
    impacts = {}
    for m in spec.impact:
        everything = whole.agg(F.max(f"s_{m}")).scalar()
        impacts[f"i_{m}"] = F.when(everything > 0, F.coalesce(F.col(f"s_{m}"), F.lit(0.0)) / everything).otherwise(0.0)
    out = rows.select(F.col("pairs").alias("filters"), *[c.alias(k) for k, c in impacts.items()])
    return out.withColumn("max_impact", _largest([F.col(k) for k in impacts]))


def _largest(columns: list[Column]) -> Column:
    return columns[0] if len(columns) == 1 else F.greatest(*columns)


def _is_temporal(spec: ViewSpec):
    names = list(spec.temporal)
    return lambda p: p["dim"].isin(*names) if names else F.lit(False)


def live_filters(spaces: DataFrame, spec: ViewSpec) -> DataFrame:
    """Subspaces worth evaluating: of enough impact, or next to one (same base, same varied dimension), or below one."""
    strong = spaces.where(F.col("max_impact") >= spec.min_impact).select("filters")
    members = spaces.select("filters", "max_impact", F.posexplode("filters").alias("pos", "ext")).select(
        "filters", "max_impact", F.col("ext.dim").alias("dim"),
        F.filter("filters", lambda p, i: i != F.col("pos")).alias("base"))
    busy = members.groupBy("base", "dim").agg(F.max("max_impact").alias("best")).where(
        F.col("best") >= spec.min_impact).select("base", "dim")
    near = members.join(busy, ["base", "dim"], "left_semi").select("filters")
    below = members.join(strong.withColumnRenamed("filters", "base"), "base", "left_semi").select("filters")
    return strong.unionByName(near).unionByName(below).distinct()


def distributions(cell_rows: DataFrame, spec: ViewSpec, keep: DataFrame | None = None) -> DataFrame:
    """One row per scope: ``dist`` holds (label, value) sorted by label.

    Each cell serves once for every column that can be its breakdown. A sum over
    rows without values is 0, an average over none is missing. Averages are rounded to nine digits and sums
    to four, so that equal values are equal in whatever order their rows were added up.
    """
    temporal = F.exists("pairs", _is_temporal(spec))
    at = F.when(temporal, F.array(F.size("pairs") - 1)).otherwise(F.sequence(F.lit(0), F.size("pairs") - 1))
    values = []
    for m in spec.measures:
        if m.agg == "avg":
            v = rnd(F.when(F.col(f"c_{m.name}") > 0, F.col(f"s_{m.name}") / F.col(f"c_{m.name}")), 9)
        else:
            v = rnd(F.coalesce(F.col(f"s_{m.name}"), F.lit(0.0)), 4)
        values.append(v.alias(m.name))
    roles = cell_rows.where(F.size("pairs") > 0).select("pairs", *values, F.explode(at).alias("pos"))
    rows = roles.select(
        F.filter("pairs", lambda p, i: i != F.col("pos")).alias("filters"),
        F.expr("pairs[pos].dim").alias("breakdown"), F.expr("pairs[pos].value").alias("label"),
        *[m.name for m in spec.measures])
    if keep is not None:
        rows = rows.join(keep, "filters", "left_semi")
    names = [m.name for m in spec.measures]
    # The tests that follow are heavy for their bytes: fix the number of tasks instead of leaving it to the data size.
    tasks = 3 * rows.sparkSession.sparkContext.defaultParallelism
    gathered = rows.repartition(tasks, "filters", "breakdown").groupBy("filters", "breakdown").agg(
        F.sort_array(F.collect_list(F.struct("label", *names))).alias("points"))

    def series(name):
        return F.transform("points", lambda p: F.struct(p["label"].alias("label"), p[name].alias("value")))

    per_measure = F.explode(F.array(*[
        F.struct(F.lit(name).alias("measure"), series(name).alias("dist")) for name in names]))
    over_time = F.col("breakdown").isin(*spec.temporal) if spec.temporal else F.lit(False)
    return gathered.select("filters", "breakdown", over_time.alias("is_temporal"), per_measure.alias("_s")).select(
        "filters", "breakdown", "is_temporal", "_s.measure", "_s.dist")


def subspace_text(filters: str | Column) -> Column:
    """``dim=value`` pairs joined by a bar; ``{*}`` for the whole table."""
    text = F.array_join(F.transform(filters, lambda p: F.concat(p["dim"], F.lit("="), p["value"])), "|")
    return F.when(F.size(filters) == 0, "{*}").otherwise(text)
