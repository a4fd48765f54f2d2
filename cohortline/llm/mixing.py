"""Sources mixed to target weights.

Method: Efraimidis-Spirakis sampling. Every document draws the exponential key
``-ln(u) / weight`` from its quality weight; within its source the documents
with the smallest keys are taken until their words fill the source's budget.
Complete epochs come first, the keys settle only the remaining fraction.

The order within a source is never sorted as a whole: the words are summed per
range of keys, the range in which the budget ends is summed again in finer
ranges, and only the last, tiny one is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
RANGES = 4096


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def letter_share(text: Column | str) -> Column:
    """Quality weight: the share of letters and spaces, at least 0.05."""
    c = F.col(text) if isinstance(text, str) else text
    junk = F.length(F.regexp_replace(c, r"[\p{L} ]+", ""))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - junk / F.greatest(F.length(c), F.lit(1))), F.lit(0.05))


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(source_key, source_size, target)`` from ``(source_key, source, source_size)``, a row per source.

    ``share`` of all words is dealt out by weight, none gets more than ``most`` times
    its own words and the excess is dealt again by weight: the level at which the
    sources are filled is found from the order in which they are full. There is one row per
    source here, whatever the number of documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    pattern = F.array(*map(F.lit, weights))
    named = sizes.withColumn("w", F.element_at(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1)).withColumn(
        "full", most * F.col("source_size"))
    order = Window.orderBy(F.col("full") / F.col("w"), "source_key")
    below, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = Window.partitionBy()
    level = (share * F.sum("source_size").over(total) - F.coalesce(F.sum("full").over(below), F.lit(0.0))) / F.sum("w").over(onward)
    # of the levels with the first k sources full, the first at which the next one is not
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("full"), F.struct("at", "level"))).over(total)["level"]
    return (named.withColumn("level", level).withColumn("at", F.row_number().over(order)).withColumn("found", found)
            .select("source_key", "source_size", F.when(F.col("found").isNull(), F.col("full")).otherwise(
                F.least(F.col("full"), F.col("found") * F.col("w"))).cast("double").alias("target")))


def _range_sums(df: DataFrame, cell: str) -> DataFrame:
    """Per source the range in which the budget ends, and the budget that is left there."""
    sums = df.groupBy("source_key", cell).agg(F.sum("size").alias("in_cell"), F.first("budget").alias("budget"))
    upto = Window.partitionBy("source_key").orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("before", F.coalesce(F.sum("in_cell").over(upto), F.lit(0)))
            .where("before < budget AND before + in_cell >= budget")
            .select("source_key", F.col(cell).alias("end_cell"), (F.col("budget") - F.col("before")).alias("left")))


def mix(docs: DataFrame, weight: Column | None = None, share: float = 1.5, most: float = 2.0, seed: int = 17,
        weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, text_key, source_size, target, epochs, extra, taken)`` for every row of ``docs(doc_id, text, source)``.

    ``size`` counts the words of the text (null: 0), ``taken`` is ``epochs * size +
    extra``: complete epochs and the words of the fractional selection. A document at
    which the budget ends is taken up to it, so that a source's words are its target,
    rounded; with ``most`` 2 no document is taken more than twice. Sources are ordered
    by code point, a null source is one of its own and comes last, a source without words
    takes nothing. Keys come from ``seed`` and doc_id: reruns agree. Rows with
    the same doc_id and text have the same key and count one after the other; a null
    doc_id has the key of a null. Other columns are not looked at; an empty table gives an empty result.
    """
    quality = letter_share("text") if weight is None else weight
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    drawn = (-F.log(u) / F.greatest(F.coalesce(quality, F.lit(0.0)), F.lit(1e-9))).alias("key")
    rows = common.cut(docs.select(
        F.col("doc_id").cast("long"), "source", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("source_key"),
        word_count("text").alias("size"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_key"), drawn)
        .withColumn("place", F.col("key") / (1 + F.col("key")))
        .withColumn("cell", F.floor(F.col("place") * RANGES)).withColumn("fine", F.floor(F.col("place") * (RANGES * RANGES))))
    per_source = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    budget = targets(per_source, share, most, weights)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = common.cut(budget.withColumn("epochs", epochs).withColumn(
        "budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))

    all_rows = rows.join(budget, "source_key")
    ends = _range_sums(all_rows, "cell")
    inside = rows.join(ends.withColumnRenamed("left", "budget"), (rows.source_key == ends.source_key) & (rows.cell == ends.end_cell), "left_semi")
    at_end = inside.join(ends.select(F.col("source_key").alias("k"), F.col("left").alias("budget")), F.col("source_key") == F.col("k")).drop("k")
    finer = _range_sums(at_end, "fine")
    last = (rows.select("source_key", "doc_id", "size", "text_key", "key", "fine").join(
        finer.select(F.col("source_key").alias("k"), "end_cell", "left"), (F.col("source_key") == F.col("k")) & (F.col("fine") == F.col("end_cell"))).drop("k"))
    # rows that repeat a document are ordered as one, and share what is taken of it one after the other
    alike = last.groupBy("source_key", "doc_id", "size", "text_key", "key").agg(F.count("*").alias("times"), F.first("left").alias("left"))
    upto = Window.partitionBy("source_key").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    shared = alike.withColumn("share", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("times")).over(upto), F.lit(0)))
    settled = (shared.withColumn("place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
               .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("share") - (F.col("place") - 1) * F.col("size"))).cast("long"))
               .select("source_key", "doc_id", "size", "text_key", "extra"))

    cells = ends.select("source_key", F.col("end_cell").alias("cell_end")).join(
        finer.select("source_key", F.col("end_cell").alias("fine_end")), "source_key", "left")
    placed = all_rows.join(cells, "source_key", "left")
    whole = placed.where("cell_end IS NULL OR fine_end IS NULL OR fine <> fine_end").withColumn(
        "extra", F.when((F.col("cell") < F.col("cell_end")) | ((F.col("cell") == F.col("cell_end")) & (F.col("fine") < F.col("fine_end"))), F.col("size")).otherwise(0).cast("long"))
    ending = settled.join(budget, "source_key").join(per_source.select("source_key", "source"), "source_key")
    columns = ["doc_id", "source", "size", "text_key", "source_size", "target", "epochs", "extra"]
    return whole.select(*columns).union(ending.select(*columns)).withColumn("taken", F.col("epochs") * F.col("size") + F.col("extra"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it is written."""
    return F.regexp_substr(text, F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them; the last document of a source is cut at the end of a word.

    Documents are met by doc_id, source and text. Rows that agree in these three are numbered, and share
    one after the other what the mix takes of them: the words that come out are those that the mix counts. ``n_chars``,
    if there is one, counts the cut text.
    """
    same = ["met_id", "met_source", "met_key"]
    plan = mix(docs, **how).groupBy(F.col("doc_id").alias("met_id"), F.col("source").alias("met_source"), F.col("text_key").alias("met_key")).agg(
        F.first("size").alias("size"), F.first("epochs").alias("epochs"), F.sum("extra").alias("extra"), F.count("*").alias("times"))
    plan = common.cut(plan.withColumnsRenamed({c: f"plan_{c}" for c in same}))
    asked = docs.select(F.col("doc_id").cast("long").alias("met_id"), F.col("source").alias("met_source"),
                        F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("met_key"), common.together(docs).alias("rest"))

    def met(rows: DataFrame) -> DataFrame:
        return asked.join(rows, F.col("met_id").eqNullSafe(F.col("plan_met_id")) & F.col("met_source").eqNullSafe(F.col("plan_met_source")) & (F.col("met_key") == F.col("plan_met_key")))

    single = met(plan.where("times = 1 AND (epochs > 0 OR extra > 0)")).select("rest", "size", "epochs", "extra")
    # few rows repeat; they are numbered within the partitions in which they are written, so a frequent one is no task of its own
    many = common.cut(met(plan.where("times > 1 AND (epochs > 0 OR extra > 0)")).withColumn("part", F.spark_partition_id()).select(*same, "part", "rest", "size", "epochs", "extra"), few=False)
    parts = many.groupBy(*same, "part").agg(F.count("*").alias("here"))
    upto = Window.partitionBy(*same).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.withColumn("before", F.coalesce(F.sum("here").over(upto), F.lit(0))).select(*[F.col(c).alias(f"plan_{c}") for c in same], F.col("part").alias("plan_part"), "before")
    inside = many.withColumn("place", F.row_number().over(Window.partitionBy(*same, "part").orderBy(F.lit(0))))
    placed = inside.join(before, F.col("met_id").eqNullSafe(F.col("plan_met_id")) & F.col("met_source").eqNullSafe(F.col("plan_met_source"))
                         & (F.col("met_key") == F.col("plan_met_key")) & (F.col("part") == F.col("plan_part")))
    shared = F.col("extra") - (F.col("before") + F.col("place") - 1) * F.col("size")
    repeated = placed.select("rest", "size", "epochs", F.greatest(F.lit(0), F.least(F.col("size"), shared)).cast("long").alias("extra"))

    takes = single.union(repeated).withColumn("take", F.explode(F.filter(F.concat(
        F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.array(F.col("extra"))), lambda x: x > 0)))
    whole, text = F.col("take") >= F.col("size"), F.col("rest").getField("text")
    left = F.when(whole, text).otherwise(first_words(text, F.col("take")))

    def given(c: str) -> Column:
        own = F.col("rest").getField(c)
        if c == "text":
            return left.alias(c)
        if c == "n_chars":
            return F.when(whole | own.isNull(), own).otherwise(F.length(left).cast(docs.schema[c].dataType)).alias(c)
        return own.alias(c)

    return takes.select(*map(given, docs.columns))
