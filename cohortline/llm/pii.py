"""Personal data found in texts.

Method: candidate gradient boosting. High-recall generators propose spans, which may overlap; boosted trees score each
candidate by its format and its context; thresholds calibrated per kind select what is redacted.

1. Three scans of a text cut out the regions in which a candidate can lie: runs of digits and the signs that stand
   between them, runs round an @, addresses spelt with "at" and "dot". Every later pattern looks at regions only. A region's
   place is the sum of what stands before it: a running sum over the rows of a text, never a list that is added to.
2. Generators propose candidates within regions. Four have a shape that is checked by rule (``KINDS``): what passes is a base
   span and stays, what fails is a known counterexample. The others propose spans that no rule decides: numbers in local
   phone form, card groups within longer runs, addresses in disguise or with letters beyond a-z.
3. Trees are boosted on the candidates that a rule has decided; they see digits, groups, signs, checksums and neighbours, not
   the leading plus sign or the name of the generator. A fifth is held out, and for each kind the least score with the wanted precision there becomes the threshold.
4. Undecided candidates from the threshold on are added where no base span is; of those that overlap the best one stays.

DataFrame functions and Spark's boosted trees only: there is no Python in any task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm import common

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 24  # code points on either side of a region that are looked at
HELD_OUT = 5  # one in so many decided candidates calibrates the thresholds
LEAST = 20  # held-out candidates of either class without which a kind is not calibrated
UNCALIBRATED = 0.95  # threshold of such a kind
PRECISION = 0.98

LOCAL = r"A-Za-z0-9._%+\-"
_WORD = r"[\p{L}\p{N}][\p{L}\p{N}\-]{0,62}"
_DOT = r" ?(?:\.|[\[({] ?(?i:dot|\.) ?[\])}]) ?"
#: Where candidates can lie. Possessive loops and what must stand before them keep a scan linear on any text.
REGIONS = {
    "number": r"\+?[0-9](?:[\x20().\-]*+[0-9]){3,}+",
    "mail": rf"(?<![\p{{L}}\p{{N}}._%+@\-])[\p{{L}}\p{{N}}._%+\-]*+@[\p{{L}}\p{{N}}._%+@\-]*+",
    "disguise": rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+(?: ?[\[({{] ?(?i:at|@) ?[\])}}] ?{_WORD}(?:{_DOT}{_WORD}){{1,8}}+| (?i:at) {_WORD}(?: (?i:dot) {_WORD}){{1,8}}+)",
}
#: (region, generator, kind, pattern). The first four are the base patterns as they match within their region.
GENERATORS = [
    ("mail", "email", "email", rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"),
    ("number", "ip", "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("number", "card", "card", r"[0-9](?:[\x20\-]?[0-9])++"),
    ("number", "phone", "phone", r"^\+.*+$"),
    ("mail", "wide", "email", r"^.*+$"),
    ("disguise", "disguise", "email", r"^.*+$"),
    ("number", "local", "phone", r"(?<![0-9.+\-])(?:1[ .\-])?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"),
    ("number", "zeros", "phone", r"(?<![0-9])00[1-9][\x20().0-9\-]{7,20}[0-9](?![0-9])"),
    ("number", "groups", "card", r"(?<![0-9])[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
]
HINTS = r"(?i)mail|contact|phone|tel|call|fax|mobil|card|visa|credit|host|server|addr"
FEATURES = ["f_kind", "f_length", "f_digits", "f_groups", "f_longest", "f_shortest", "f_spaces", "f_hyphens", "f_dots", "f_letters", "f_largest", "f_luhn",
            "f_before", "f_after", "f_hint", "f_near", "f_last", "f_distinct"]


def pieces(text: Column, pattern: str) -> Column:
    """The matches of ``pattern``, each with the length of what stands before it and the ends of that; the last row is the rest of the text."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    return F.transform(zipped, lambda x: F.struct(
        F.length(x["gap"]).alias("gap"), F.substring(x["gap"], -CONTEXT, CONTEXT).alias("tail"), F.substring(x["gap"], 1, CONTEXT).alias("head"), x["match"].alias("match")))


def _placed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``pieces`` with the place of each match and the text to its right."""
    order = Window.partitionBy(*keys).orderBy("k")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(upto), F.lit(0))
    return rows.withColumns({"at": (before + F.col("gap")).cast("long"), "after": F.lead("head").over(order)}).where("match IS NOT NULL")


def regions(docs: DataFrame) -> DataFrame:
    """Rows ``(row, doc_id, region, k, gap, tail, head, match)`` of all texts, and one with ``k`` -1 for every document; written."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    told = F.struct(F.lit("").alias("region"), F.lit(-1).alias("k"), F.lit(None).cast("int").alias("gap"), F.lit(None).cast("string").alias("tail"),
                    F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("match"))

    def own(name: str, pattern: str) -> Column:
        parts = F.transform(pieces(F.col("text"), pattern), lambda x, k: F.struct(
            F.lit(name).alias("region"), k.alias("k"), x["gap"].alias("gap"), x["tail"].alias("tail"), x["head"].alias("head"), x["match"].alias("match")))
        return F.filter(parts, lambda x: (x["k"] > 0) | x["match"].isNotNull())  # nothing of a text without matches

    parts = F.concat(F.array(told), *[own(name, pattern) for name, pattern in REGIONS.items()])
    return common.cut(rows.select("row", "doc_id", F.explode(parts).alias("x")).select("row", "doc_id", "x.*"), few=False)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the checksum of 13 to 19 digits is right; false for any other number of digits."""
    doubled = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.pmod(c.cast("int") * 2, F.lit(10)) + F.floor(c.cast("int") * 2 / 10).cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return F.when(F.length(number).between(13, 19), total % 10 == 0).otherwise(False)


def valid(generator: Column, match: Column) -> Column:
    """Whether a base candidate passes its rule."""
    n = F.length(digits(match))
    small = F.forall(F.split(match, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    return (F.when(generator == "email", True).when(generator == "ip", small).when(generator == "card", luhn(digits(match)))
            .when(generator == "phone", n.between(9, 15)).otherwise(False))


def _sign(text: Column) -> Column:
    """The class of a neighbouring sign."""
    return (F.when(text == "", 0).when(text.rlike(r"^\s$"), 1).when(text.rlike(r"^\p{L}$"), 2).when(text.rlike(r"^\p{N}$"), 3)
            .when(text.isin("\"", "'", "=", "#", "_", "/", "$"), 4).otherwise(5))


def candidates(told: DataFrame) -> DataFrame:
    """``(row, kind, generator, start, end, match, passes, decided, f_...)`` of all regions, written."""
    placed = _placed(told.where("k >= 0"), ["row", "region"]).select("row", "region", "at", "tail", "match", F.coalesce("after", F.lit("")).alias("after"))

    def proposed(region: str, generator: str, kind: str, pattern: str) -> Column:
        found = F.transform(pieces(F.col("match"), pattern), lambda x, k: F.struct(
            F.lit(generator).alias("generator"), F.lit(KINDS.index(kind)).alias("kind"), k.alias("k"), x.alias("x")))
        return F.when(F.col("region") == region, found).otherwise(F.array().cast(
            "array<struct<generator:string,kind:int,k:int,x:struct<gap:int,tail:string,head:string,match:string>>>"))

    inner = placed.select("row", "region", F.col("at").alias("begin"), F.col("tail").alias("left"), F.col("after").alias("right"), F.col("match").alias("whole"),
                          F.explode(F.concat(*[proposed(*g) for g in GENERATORS])).alias("c"))
    inner = inner.select("row", "region", "begin", "left", "right", "whole", "c.generator", "c.kind", "c.k", "c.x.*")
    own = _placed(inner, ["row", "region", "begin", "generator"])
    size = F.length("match")
    spread = own.select(
        "row", "kind", "generator", "match", "whole", (F.col("begin") + F.col("at")).alias("start"), (F.col("begin") + F.col("at") + size).cast("long").alias("end"),
        F.substring(F.concat("left", F.expr("substring(whole, 1, CAST(at AS INT))")), -CONTEXT, CONTEXT).alias("left"),
        F.substring(F.concat(F.expr("substring(whole, CAST(at AS INT) + 1 + length(match))"), "right"), 1, CONTEXT).alias("right"))
    has_base = F.regexp_like("whole", F.lit(GENERATORS[0][3]))
    spread = spread.withColumn("passes", valid(F.col("generator"), F.col("match"))).withColumn(
        "decided", F.col("generator").isin(*KINDS) | ((F.col("generator") == "wide") & ~has_base))
    runs = F.regexp_extract_all("match", F.lit("[0-9]+"), F.lit(0))
    length = F.transform(runs, lambda r: F.length(r))
    value = F.transform(runs, lambda r: F.when(F.length(r) <= 4, r.cast("int")).otherwise(10_000))
    number = digits(F.col("match"))
    near = F.concat("left", "right")
    features = {
        "f_kind": F.col("kind"), "f_length": size, "f_digits": F.length(number), "f_groups": F.size(runs),
        "f_longest": F.coalesce(F.array_max(length), F.lit(0)), "f_shortest": F.coalesce(F.array_min(length), F.lit(0)),
        "f_spaces": F.regexp_count("match", F.lit(" ")), "f_hyphens": F.regexp_count("match", F.lit("-")), "f_dots": F.regexp_count("match", F.lit(r"\.")),
        "f_letters": F.regexp_count("match", F.lit(r"\p{L}")), "f_largest": F.coalesce(F.array_max(value), F.lit(-1)), "f_luhn": luhn(number).cast("int"),
        "f_before": _sign(F.substring("left", -1, 1)), "f_after": _sign(F.substring("right", 1, 1)), "f_hint": F.col("left").rlike(HINTS).cast("int"),
        "f_near": F.regexp_count(near, F.lit("[0-9]")), "f_last": F.length(F.regexp_extract("match", r"([\p{L}]*)$", 1)),
        "f_distinct": F.size(F.array_distinct(F.split(number, ""))),
    }
    return common.cut(spread.withColumns({c: x.cast("double") for c, x in features.items()}).select(
        "row", "kind", "generator", "start", "end", "match", "passes", "decided", F.xxhash64("left", "match", "right").alias("draw"), *FEATURES), few=False)


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows)


def boosted(spans: DataFrame) -> tuple[GBTClassificationModel, dict[int, float]] | None:
    """Trees and a threshold per kind, from all candidates that a rule has decided; None where one of the classes is missing.

    Equal rows are fitted to as one, weighted by their number, so that none is left out.
    """
    decided = spans.where("decided").withColumn("label", F.col("passes").cast("double")).withColumn("fold", F.pmod("draw", F.lit(HELD_OUT)))
    kept = decided.where(F.col("fold") != 0)
    if len({r.label for r in kept.groupBy("label").count().collect()}) < 2:
        return None
    chosen = common.cut(kept.groupBy("label", *FEATURES).agg(F.count("*").cast("double").alias("weight")).sortWithinPartitions("label", *FEATURES), few=False)
    model = GBTClassifier(maxIter=12, maxDepth=4, maxBins=32, stepSize=0.3, seed=11, weightCol="weight").fit(_assembled(chosen).select("label", "features", "weight"))
    held = scored(model, decided.where(F.col("fold") == 0).groupBy("kind", "label", *FEATURES).agg(F.count("*").alias("n")))
    steps = held.groupBy("kind", F.floor(F.col("score") * 100).cast("int").alias("step")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("all")).collect()
    return model, {kind: threshold([(r.step, r.good, r["all"]) for r in steps if r.kind == kind]) for kind in range(len(KINDS))}


def threshold(steps: list[tuple[int, float, int]], precision: float = PRECISION, least: int = LEAST) -> float:
    """The least hundredth of the score from which on the precision is reached, of ``(hundredth, good, all)``; above 1 where none does."""
    good, every = sum(g for _, g, _ in steps), sum(n for _, _, n in steps)
    if good < least or every - good < least:
        return UNCALIBRATED
    found, g, n = 1.01, 0.0, 0
    for step, own, total in sorted(steps, reverse=True):
        g, n = g + own, n + total
        if g >= precision * n:
            found = step / 100
    return found


def scored(model: GBTClassificationModel, spans: DataFrame) -> DataFrame:
    """``spans`` with the trees' ``score``, 0 to 1."""
    out = model.transform(_assembled(spans)).withColumn("score", vector_to_array("probability")[1])
    return out.drop("features", "rawPrediction", "probability", "prediction")


def selected(spans: DataFrame) -> DataFrame:
    """``(row, kind, start, end, base, score)``: the base spans, and the undecided candidates that the trees select."""
    columns = ["row", "kind", "start", "end"]
    base = spans.where("passes").select(*columns, F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    learnt = boosted(spans)
    if learnt is None:
        return base
    model, least = learnt
    limit = reduce(lambda c, k: c.when(F.col("kind") == k, least[k]), range(1, len(KINDS)), F.when(F.col("kind") == 0, least[0]))
    added = scored(model, spans.where("NOT decided AND NOT passes")).where(F.col("score") >= limit).select(*columns, F.lit(False).alias("base"), "score")
    both = base.union(added)
    # spans that touch one another, directly or through others, are one stretch; in it base spans stay, or else the best one
    by_place = Window.partitionBy("row").orderBy("start", F.desc("end"))
    reach = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    stretch = both.withColumn("new", F.when(reach.isNull() | (F.col("start") >= reach), 1).otherwise(0))
    stretch = stretch.withColumn("stretch", F.sum("new").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("row", "stretch")
    best = F.row_number().over(own.orderBy(F.desc("base"), F.desc("score"), F.desc(F.col("end") - F.col("start")), "start", "kind"))
    return (stretch.withColumn("any_base", F.max("base").over(own)).withColumn("place", best)
            .where(F.col("base") | (~F.col("any_base") & (F.col("place") == 1))).select(*columns, "base", "score"))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, spans)`` for every row of ``docs(doc_id, text)``; spans are ``array<struct<kind int, start long, end long, base boolean, score double>>``.

    Places count code points from 0, ends are exclusive; spans are ordered by kind (as in ``KINDS``) and place. Base
    spans are the leftmost non-overlapping matches of their kind that pass its rule; all others are candidates that the
    trees have selected, and touch no base span. Where one of the classes is missing there are no trees, and base
    spans alone. A null or empty text has no spans; ids may be null or repeat; other columns are not
    looked at; an empty table gives an empty result.
    """
    found = regions(docs)
    spans = selected(candidates(found))
    per = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end", "base", "score"))).alias("spans"))
    told = found.where("k = -1").select("row", "doc_id")
    none = F.array().cast("array<struct<kind:int,start:bigint,end:bigint,base:boolean,score:double>>")
    return told.join(per, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with every span of the text replaced by its kind in square brackets.

    Rows are written once with a number each, by which their spans find them again. A null text stays null.
    """
    rows = common.cut(docs.select(F.monotonically_increasing_id().alias("row"), common.together(docs).alias("rest")), few=False)
    spans = find(rows.select(F.col("row").alias("doc_id"), F.col("rest").getField("text").alias("text"))).where(F.size("spans") > 0)
    # overlapping spans of several kinds become one; pieces between them are cut out by place
    met = rows.join(spans.withColumnRenamed("doc_id", "row"), "row", "left")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("rest").getField("text")
    folded = F.aggregate(ordered, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text")), lambda a, s: F.when(s["start"] >= a["at"], F.struct(
        s["end"].alias("at"), F.concat(a["text"], text.substr((a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit("]")).alias("text")))
        .otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["text"].alias("text"))),
        lambda a: F.concat(a["text"], text.substr((a["at"] + 1).cast("int"), F.lit(1 << 30))))
    cleaned = F.when(F.col("spans").isNull(), text).otherwise(folded)
    return met.select(*[cleaned.alias(c) if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns])
