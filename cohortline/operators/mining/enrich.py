"""Figures and a sentence for each candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ...functions.numbers import rnd
from .scopes import _is_temporal
from .spec import ViewSpec


def with_figures(ranked: DataFrame, distributions: DataFrame, cells: DataFrame, spec: ViewSpec) -> DataFrame:
    """Add the five largest and two smallest values of the base distribution, shares, highlight values, sample sizes.

    Candidates whose measure or breakdown varies have no single distribution and stay without figures.
    """
    base = distributions.select(F.col("filters").alias("base"), "breakdown", "measure", "dist")
    out = ranked.join(base, ["base", "breakdown", "measure"], "left")
    known = F.filter("dist", lambda p: p["value"].isNotNull())
    out = out.withColumn("known", known).withColumn("sum", F.aggregate("known", F.lit(0.0), lambda a, p: a + p["value"]))
    out = out.withColumn("falling", F.array_sort(F.transform("known", lambda p: F.struct((-p["value"]).alias("neg"), p["label"]))))

    def shown(points):
        value = lambda p: -p["neg"]
        return F.transform(points, lambda p: F.struct(
            p["label"].alias("label"), rnd(value(p), 2).alias("value"),
            F.when(F.col("sum") > 0, rnd(value(p) / F.col("sum") * 100.0, 1)).otherwise(0.0).alias("share_pct")))

    lead = F.get(F.transform("commonness", lambda s: s["highlight"]), F.lit(0))
    marked = F.filter("falling", lambda p: F.array_contains(F.coalesce(lead, F.array().cast("array<string>")), p["label"]))
    n = F.size("falling")
    out = out.withColumns({
        "top_values": shown(F.slice("falling", 1, 5)),
        "bottom_values": shown(F.slice("falling", F.greatest(n - 1, F.lit(1)), F.lit(2))),
        "highlight_values": shown(marked), "total": rnd("sum", 2), "n_values": F.when(F.col("dist").isNotNull(), n)})
    return out.join(sample_sizes(cells, spec), ["base", "breakdown", "measure"], "left").drop("dist", "known", "sum", "falling")


def sample_sizes(cells: DataFrame, spec: ViewSpec) -> DataFrame:
    """For averages: the number of values behind the first five labels."""
    averaged = [m.name for m in spec.measures if m.agg == "avg"]
    temporal = F.exists("pairs", _is_temporal(spec))
    at = F.when(temporal, F.array(F.size("pairs") - 1)).otherwise(F.sequence(F.lit(0), F.size("pairs") - 1))
    roles = cells.where(F.size("pairs") > 0).select("pairs", *[f"c_{m}" for m in averaged], F.explode(at).alias("pos"))
    counts = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"c_{m}").alias("n")) for m in averaged]))
    rows = roles.select(F.filter("pairs", lambda p, i: i != F.col("pos")).alias("base"),
                        F.expr("pairs[pos].dim").alias("breakdown"), F.expr("pairs[pos].value").alias("label"),
                        counts.alias("m")).select("base", "breakdown", "label", "m.measure", "m.n")
    return rows.groupBy("base", "breakdown", "measure").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("label", "n"))), 1, 5).alias("sample_sizes"))


def _sentence(kind: Column, highlight: Column, breakdown: Column, measure: Column) -> Column:
    first, second = F.get(highlight, F.lit(0)), F.get(highlight, F.lit(1))

    def text(*parts) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    place = F.transform(highlight, lambda h: F.regexp_replace(h, " (ABOVE|BELOW)$", ""))
    side = F.lower(F.regexp_extract(first, "(ABOVE|BELOW)$", 1))
    outlier = F.when(F.size(highlight) == 1, text(measure, " has an outlier at ", F.get(place, F.lit(0)), " (", side, ") in ", breakdown)
                     ).otherwise(text(measure, " has outliers at ", F.array_join(place, ", "), " in ", breakdown))
    sentences = {
        "OUTSTANDING_1": text(first, " has the highest ", measure, " among ", breakdown, " values"),
        "OUTSTANDING_LAST": text(first, " has the lowest ", measure, " among ", breakdown, " values"),
        "TOP_TWO": text(first, " and ", second, " lead in ", measure, " among ", breakdown, " values"),
        "LAST_TWO": text(first, " and ", second, " are lowest in ", measure, " among ", breakdown, " values"),
        "EVENNESS": text(measure, " is evenly distributed across ", breakdown, " values"),
        "ATTRIBUTION": text(first, " accounts for the majority of ", measure, " among ", breakdown, " values"),
        "TREND": text(measure, " is ", F.lower(first), " over ", breakdown),
        "OUTLIER": outlier,
        "SEASONALITY": text(measure, " shows seasonal pattern (", first, ") over ", breakdown),
        "CHANGE_POINT": text(measure, " has a significant shift at ", first, " in ", breakdown),
        "UNIMODALITY": text(measure, " forms a ", F.lower(first), " at ", second, " over ", breakdown),
    }
    out = text(kind, " pattern on ", measure, " across ", breakdown)
    for name, sentence in sentences.items():
        out = F.when(kind == name, sentence).otherwise(out)
    return out


def with_summary(candidates: DataFrame) -> DataFrame:
    """One sentence per candidate: what most members show, and up to three exceptions."""
    lead = F.get("commonness", F.lit(0))
    main = _sentence(F.col("pattern_type"), lead["highlight"], F.col("breakdown"), F.col("measure"))
    part = F.concat(F.lit(" ("), lead["count"].cast("string"), F.lit("/"), F.col("hdp_size").cast("string"), F.lit(")"))
    opening = (F.when(lead["proportion"] >= 1.0, F.concat(F.lit("Across all "), "ext_dim", F.lit(" values")))
               .when(lead["proportion"] >= 0.9, F.concat(F.lit("Across nearly all "), "ext_dim", F.lit(" values"), part))
               .otherwise(F.concat(F.lit("Across most "), "ext_dim", F.lit(" values"), part)))

    def told(e):
        how = (F.when(e["category"] == "HIGHLIGHT_CHANGE",
                      _sentence(e["pattern_type"], e["highlight"], F.col("breakdown"), F.col("measure")))
               .when(e["category"] == "TYPE_CHANGE", "different pattern").otherwise("no clear pattern"))
        return F.concat(e["member_label"], F.lit(" ("), how, F.lit(")"))

    k = F.size("exceptions")
    odd = F.array_join(F.transform(F.slice("exceptions", 1, 3), told), "; ")
    ending = (F.when(k == 0, "").when(k <= 3, F.concat(F.lit(". Exception: "), odd))
              .otherwise(F.concat(F.lit(". Exceptions: "), odd, F.lit(" and "), (k - 3).cast("string"), F.lit(" others"))))
    return candidates.withColumn("summary", F.concat(opening, F.lit(", "), main, ending))
