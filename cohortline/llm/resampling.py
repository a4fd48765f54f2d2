"""Documents drawn so that their n-grams follow those of a target collection.

Method: hashed n-gram importance resampling with overlapped regex scanning. Separators are collapsed to single
spaces; one scan with ``regex`` ``finditer(..., overlapped=True)`` starts a match at every word, and its boundary
lookahead captures the spans of the next words, so that all runs that begin at the word come out of one match.
The spans go to CRC-32 as they are: a longer run continues the checksum of the shorter one. A run's bucket is its
checksum modulo the number of buckets.

1. The sorted buckets of every text are written once, as differences (about a quarter of the text's size).
2. Buckets are counted over all documents and over all target texts; a bucket's gain is the logarithm of the ratio
   of its two smoothed shares. There are as many counts as buckets, whatever the input.
3. A document's weight is the sum of its gains. Gumbel noise from its id turns the best scores into a draw
   without replacement.
4. Rows are dealt by ranges of their score and written; counts per range give each its first rank, and only the ranges that
   hold drawn documents are numbered row by row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm import common

LONGEST, BUCKETS = 3, 10_000
#: Bytes of words stay (A-Z as a-z; digits; all of characters from U+0080 on), all others are separators.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PORTION = 1 << 16  # matches at a time
FEATURED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])
FEATURED_DDL = "row long, doc_id long, n_words long, n_features long, buckets binary"


def scanner(longest: int):
    """Matches at every word; the groups are the word and the one, two, ... that follow it, each with the space before it."""
    return regex.compile(rb" ([^ ]++)(?=" + rb"( [^ ]++)?" * (longest - 1) + rb")")


def checksums(text: bytes, scan) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of every run of 1 to ``longest`` consecutive words."""
    spaced = b" " + b" ".join(text.translate(LOWERED).split())
    found = scan.finditer(spaced, overlapped=True)
    n, out = 0, [np.empty(0, np.uint32)]
    while part := [m.groups(b"") for m in islice(found, PORTION)]:
        n += len(part)
        checked: Iterable[int] = [0] * len(part)
        for spans in zip(*part):
            checked = list(map(zlib.crc32, spans, checked))
            whole = len(spans)
            while whole and not spans[whole - 1]:  # the last words of the text have no longer runs
                whole -= 1
            out.append(np.fromiter(checked, np.uint32, len(checked))[:whole])
    return n, np.concatenate(out)


def _number(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _featured(longest: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, number = scanner(longest), _number(buckets)
        for part, texts in common.chunks(batches, "text"):
            words, features, packed = [], [], []
            for text in texts:
                n, checked = checksums(text, scan)
                own = np.sort((checked % np.uint32(buckets)).astype(number))
                words.append(n)
                features.append(len(own))
                packed.append(common.squeezed(np.diff(own, prepend=own.dtype.type(0)).tobytes()))
            yield common.as_batch(FEATURED, row=part.column(0), doc_id=part.column(1), n_words=words, n_features=features, buckets=packed)

    return run


def _unpacked(column: pa.Array, buckets: int) -> list[np.ndarray]:
    number = _number(buckets)
    return [np.cumsum(np.frombuffer(common.unsqueezed(x), number), dtype=np.int64) for x in column.to_pylist()]


def featured(rows: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(row, doc_id, n_words, n_features, buckets)`` of ``rows(row, doc_id, text)``, written once; ``buckets`` is packed."""
    return common.cut(rows.select("row", "doc_id", "text").mapInArrow(common.tidy(_featured(longest, buckets)), FEATURED_DDL), few=False)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all rows: sums of the tasks' counts, one number per bucket."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in _unpacked(batch.column(0), buckets):
                total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in features.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over that in the raw collection."""
    m, s, t = float(len(raw)), raw.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def _weighed(gain: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])
        for batch in batches:
            weight = [int(gain[own].sum()) for own in _unpacked(batch.column(4), len(gain))]
            yield common.as_batch(schema, row=batch.column(0), doc_id=batch.column(1), n_words=batch.column(2), n_features=batch.column(3), weight=weight)

    return run


def gumbel(doc_id: Column | str, seed: int) -> Column:
    """floor(1000 * a Gumbel draw) that the id determines."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(said, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, drawn: int, order: list[Column]) -> DataFrame:
    """``scored`` with ``rank``: 1 to ``drawn`` for the first eligible rows in ``order``, null for all others.

    The whole is never ordered in one task: rows are dealt by ranges and written with their range, ranges are counted,
    and those that begin within the drawn rows are numbered each by itself.
    """
    spark = scored.sparkSession
    chosen = scored.withColumn("chosen", eligible)
    ranges = common.cut(chosen.repartitionByRange(F.col("chosen").desc(), *order).withColumn("range", F.spark_partition_id()), few=False)
    counts = sorted(ranges.groupBy("range").agg(F.count_if("chosen")).collect())
    before = np.cumsum([0, *[n for _, n in counts]]).tolist()
    first = spark.createDataFrame([(r, b) for (r, _), b in zip(counts, before) if b < drawn] or [(-1, 0)], "range int, before long")
    rank = F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(F.col("chosen").desc(), *order))
    within = ranges.join(F.broadcast(first), "range").withColumn("rank", rank.cast("long"))  # a row per range
    within = within.withColumn("rank", F.when(F.col("chosen") & (F.col("rank") <= drawn), F.col("rank"))).drop("before")
    beyond = ranges.join(F.broadcast(first.select("range")), "range", "left_anti").withColumn("rank", F.lit(None).cast("long"))
    return within.unionByName(beyond).drop("range", "chosen")


def importance(rows: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42,
               longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(row, doc_id, n_words, n_features, weight, score, rank)`` for every row of ``rows(row, doc_id, text)``, given ``target(text)``.

    Words are runs of digits, letters a-z (A-Z count as them) and all characters from U+0080 on; features are runs
    of 1 to ``longest`` words. Of the N rows with at least ``least_words`` words the floor(percent * N / 100) with the highest
    score have a rank, ties go to the smaller doc_id (a missing one last), then to fewer features and the smaller weight;
    rows that are alike in all of that are ranked one after the other. A null or empty text has no features and weight 0; a missing
    doc_id draws its noise as the empty id. An empty target has no features, an empty table gives an empty result.
    """
    features = featured(rows, longest, buckets)
    aims = featured(target.select(F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(aims, buckets))
    able = F.col("n_words") >= least_words
    drawn = percent * features.where(able).count() // 100
    scored = features.mapInArrow(common.tidy(_weighed(gain)), "row long, doc_id long, n_words long, n_features long, weight long").withColumn(
        "score", F.col("weight") + gumbel("doc_id", seed))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("row")]
    return ranked(scored, able, drawn, order)


def numbered(docs: DataFrame) -> DataFrame:
    """``(row, doc_id, text)``: rows numbered where they are read."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def importance_of(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """``importance`` of ``docs(doc_id, text)``; other columns are not looked at."""
    return importance(numbered(docs), target, **how).drop("row")


def resampled(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns, whatever their names. They are written once with a number each, by which the draw finds them again."""
    rows = common.cut(docs.select(F.monotonically_increasing_id().alias("row"), common.together(docs).alias("rest")), few=False)
    asked = rows.select("row", F.col("rest").getField("doc_id").cast("long").alias("doc_id"), F.col("rest").getField("text").alias("text"))
    drawn = importance(asked, target, **how).where("rank IS NOT NULL").select("row")
    return rows.join(drawn, "row", "left_semi").select(*common.apart("rest", docs.columns))
