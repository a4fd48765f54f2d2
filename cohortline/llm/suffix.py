"""Removal of long strings that an earlier document holds as well.

Method: column-wise construction for a collection. A Burrows-Wheeler transform
and its common prefixes are built for many strings at once by inserting one
symbol of each string per round, the columns coming from a sequential file.
The rounds number as many as the longest string has symbols, so
whole documents (up to millions of symbols, in one task) are not inserted as
they are. What is inserted is short *reads* around anchors:

1. Every window of ``match`` bytes contains the anchor that is the least by a hash
   among its strings of ``gram`` bytes. Equal windows have equal anchors at equal
   places. Anchors that a single document has are dropped.
2. Around each remaining anchor the bytes that any window with it can cover form a
   read. Reads of the same anchors are dealt to the same task. A task inserts the
   reads' columns from the last to the first. All reads have their anchor in the
   same columns, so equal windows begin in the same column and each round
   needs to order only the suffixes that begin there (the positional form of the
   transform).
3. In a round, neighbours with a common prefix of ``match`` symbols or more are
   equal windows. What begins there in a document other than the smallest
   is removed.

A read that several documents of a portion have is sent once, for the smallest of
them; the others are settled on the spot. So an anchor that a third of all
documents share costs a row per portion. Documents with the same text are one
document, the smallest, in all of this; the others lose every byte.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.llm import common, postings

BYTE_HASH = common.mixed(np.arange(1, 257, dtype=np.uint64))
LAST = (1 << 63) - 1  # stands for a missing id, which comes last
READS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("texts", pa.binary()), ("at", pa.binary()), ("ends", pa.binary()), ("reads", pa.binary())])
READS_DDL = "bucket int, docs binary, texts binary, at binary, ends binary, reads binary"
SPANS_DDL = "block int, docs binary, texts binary, starts binary, ends binary"
MARKED_DDL = "doc long, text_key long, spans binary"


def _slide(op, values: np.ndarray, width: int) -> np.ndarray:
    """``op`` over every run of ``width`` values, by doubling."""
    reach, out = 1, values
    while reach * 2 <= width:
        out = op(out[:-reach], out[reach:])
        reach *= 2
    return op(out[:len(out) - (width - reach)], out[width - reach:]) if reach < width else out


def anchors(text: bytes, match: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the strings of ``gram`` bytes that are the least in some window of ``match`` bytes; all of them where several tie."""
    if len(text) < match:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = BYTE_HASH[np.frombuffer(text, np.uint8)]
    rolled, reach, whole, done = h, 1, None, 0
    factor = 0x9E3779B97F4A7C15
    rest = gram
    while rest:  # powers of two that add up to the gram
        if rest & 1:
            part = rolled[done:]
            whole = part if whole is None else whole[:len(part)] * np.uint64(factor) + part
            done += reach
        rest >>= 1
        if rest:
            rolled = rolled[:-reach] * np.uint64(factor) + rolled[reach:]
            reach *= 2
            factor = factor * factor % (1 << 64) | 1
    h = common.mixed(whole[:len(text) - gram + 1])
    width = match - gram + 1
    least = _slide(np.minimum, h, width)
    border = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(h == _slide(np.maximum, np.concatenate([border, least, border]), width))
    return at, common.mixed(h[at] ^ np.uint64(0x5851F42D4C957F2D))  # the least hashes are no longer spread evenly


def _squeezed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts go through shuffles compressed; the other columns as they are."""
    for part, texts in common.chunks(batches, "text"):
        at = part.schema.get_field_index("text")
        packed = pa.array([common.squeezed(t) for t in texts], pa.binary())
        yield part.set_column(at, "text", packed)


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """The columns of portions of rows and their texts."""
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            columns = {f.name: part.column(i) for i, f in enumerate(part.schema)}
            yield columns, [common.unsqueezed(x) for x in columns["text"].to_pylist()]


def _owned(batches: Iterable[pa.RecordBatch], match: int, gram: int) -> Iterator[tuple[int, np.ndarray]]:
    for columns, texts in _texts(batches):
        for owner, text in zip(columns["text_key"].to_pylist(), texts):
            yield owner, np.unique(anchors(text, match, gram)[1])


def _dealt(buckets: int, match: int, gram: int):
    """Anchors of a portion: those that several of its documents have are answered at once and sent for one of them only."""
    held = 1 << 19

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion: dict[int, list[np.ndarray]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            owners = list(portion)
            own = [np.unique(np.concatenate(p)) if len(p) > 1 else p[0] for p in portion.values()]
            whose = np.repeat(np.arange(len(owners)), [len(x) for x in own])
            hashes = np.concatenate(own)
            _, first, inverse, times = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            sent = np.zeros(len(hashes), bool)
            sent[first] = True
            common_here = times[inverse] > 1
            bounds = np.r_[0, np.cumsum([len(x) for x in own])]
            yield from postings.dealt(((o, hashes[a:b][sent[a:b]]) for o, a, b in zip(owners, bounds[:-1], bounds[1:])), buckets, held=1 << 40)
            known = np.flatnonzero(common_here)
            if len(known):
                element = np.empty(len(known), postings.ELEMENT)
                element["key"] = postings.key_of(hashes[known], buckets)
                element["owners"] = 0
                at, n = np.unique(whose[known], return_counts=True)
                yield postings.known(np.asarray(owners, np.int64)[at], n, element, buckets)

        for owner, hashes in _owned(batches, match, gram):
            if len(hashes):
                portion.setdefault(owner, []).append(hashes)
                size += len(hashes)
            if size >= held:
                yield from flush()
                portion, size = {}, 0
        if size:
            yield from flush()

    return run


def _by_block(docs: np.ndarray, texts: np.ndarray, starts: np.ndarray, ends: np.ndarray, blocks: int) -> list[tuple]:
    """Spans dealt by their texts: (block, documents, texts, first bytes, end bytes)."""
    order = np.argsort(texts % blocks, kind="stable")
    columns = [x[order].astype(t) for x, t in ((docs, "<i8"), (texts, "<i8"), (starts, "<u4"), (ends, "<u4"))]
    return [(b, *(x[i:j].tobytes() for x in columns)) for b, i, j in postings.slices(texts[order] % blocks)]


def _marked(pdf):
    """The spans of a block of texts, a row per document."""
    import pandas as pd

    docs, texts, starts, ends = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in
                                 (("docs", "<i8"), ("texts", "<i8"), ("starts", "<u4"), ("ends", "<u4")))
    order = np.lexsort((texts, docs))
    docs, texts, pairs = docs[order], texts[order], np.stack([starts[order], ends[order]], 1)
    first = np.flatnonzero(np.r_[True, (docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1])])
    return pd.DataFrame({"doc": docs[first], "text_key": texts[first], "spans": [pairs[i:j].tobytes() for i, j in zip(first, np.r_[first[1:], len(docs)])]})


def _reads(buckets: int, match: int, gram: int):
    """Reads round the shared anchors of each text, and the spans that a portion can settle by itself (negative buckets)."""
    before, length = match - gram, 2 * match - gram
    held = 1 << 16

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        places: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        reads: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, text, at, n, key, read = map(np.concatenate, (docs, texts, places, sizes, keys, reads))
            # equal reads with the same room on either side are the same windows; the smallest document stands for them
            room = np.stack([np.minimum(at, before), np.minimum(n - at, length - before)], 1).astype(np.uint8)
            content = np.concatenate([read, room], 1)
            whole = np.ascontiguousarray(content).view(f"V{content.shape[1]}").reshape(-1)
            digest = np.fromiter((hash_of(x) for x in whole), np.uint64, len(whole))
            order = np.lexsort((doc, digest))
            head = np.r_[True, digest[order][1:] != digest[order][:-1]]
            smallest = doc[order][head][np.cumsum(head) - 1]
            later = order[doc[order] > smallest]
            if len(later):
                settled = _by_block(doc[later], text[later], np.maximum(at[later] - before, 0), np.minimum(at[later] - before + length, n[later]), buckets)
                rows = [(-1 - block, *blobs, b"") for block, *blobs in settled]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), READS)], schema=READS)
            stay = order[doc[order] == smallest]
            where = (key[stay] >> np.uint64(48)).astype(np.uint16)
            stay = stay[np.argsort(where, kind="stable")]
            rows = [(b, *(x[stay[i:j]].astype(t).tobytes() for x, t in ((doc, "<i8"), (text, "<i8"), (at, "<u4"), (n, "<u4"))),
                     common.squeezed(read[stay[i:j]].tobytes()))
                    for b, i, j in postings.slices(np.sort(where, kind="stable"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), READS)], schema=READS)

        for columns, whole in _texts(batches):
            for doc, text_key, shared, text in zip(*(columns[c].to_pylist() for c in ("doc", "text_key", "shared")), whole):
                at, hashes = anchors(text, match, gram)
                key = postings.key_of(hashes, buckets)
                wanted = np.isin(key, np.frombuffer(shared, postings.ELEMENT)["key"])
                at, key = at[wanted], key[wanted]
                if not len(at):
                    continue
                padded = np.zeros(len(text) + 2 * length, np.uint8)
                padded[before:before + len(text)] = np.frombuffer(text, np.uint8)
                for first in range(0, len(at), held):  # a long text may have an anchor at every byte
                    here, own = at[first:first + held], key[first:first + held]
                    docs.append(np.full(len(here), doc, np.int64))
                    texts.append(np.full(len(here), text_key, np.int64))
                    places.append(here)
                    sizes.append(np.full(len(here), len(text), np.int64))
                    keys.append(own)
                    reads.append(padded[here[:, None] + np.arange(length)])
                    size += len(here)
                    if size >= held:
                        yield from flush()
                        for x in (docs, texts, places, sizes, keys, reads):
                            x.clear()
                        size = 0
        if size:
            yield from flush()

    return run


def hash_of(x) -> int:
    return int.from_bytes(hashlib.blake2b(bytes(x), digest_size=8).digest(), "little")


def repeated_windows(reads: np.ndarray, docs: np.ndarray, first: np.ndarray, last: np.ndarray, match: int) -> np.ndarray:
    """Which windows of aligned reads also begin in a read of a smaller document.

    ``reads`` has a read per row; bytes ``first[i]`` to ``last[i]`` of a row belong to
    its text. Returns a row per read and a column per window start. Columns are
    inserted from the last to the first; each round keeps the order of the
    suffixes that begin in its column and the common prefix of each with the one
    above it. The columns lie one after the other in a temporary file, so that a
    round holds a few numbers per read, whatever the length of the reads.
    """
    n, length = reads.shape
    windows = length - match + 1
    repeated = np.zeros((n, windows), bool)
    with tempfile.TemporaryFile() as symbols:
        np.ascontiguousarray(reads.T).tofile(symbols)
        order, prefix = np.arange(n), np.zeros(n, np.uint16)
        for column in range(length - 1, -1, -1):
            symbols.seek(column * n)
            inserted = np.fromfile(symbols, np.uint8, n)[order]  # the transform's column: what precedes each suffix
            rank = np.argsort(inserted, kind="stable")
            nearest, at = np.zeros(n, np.uint16), 0
            for many in np.bincount(inserted)[np.unique(inserted)].tolist():
                places = rank[at:at + many]
                if many > 1:  # the common prefix of two neighbours: the least of those between them, and the new symbol
                    least = np.minimum.reduceat(prefix, places[:-1] + 1)
                    least[-1] = prefix[places[-2] + 1:places[-1] + 1].min()  # reduceat goes on to the end there
                    nearest[at + 1:at + many] = np.minimum(least, match) + 1
                at += many
            order, prefix = order[rank], nearest
            if column < windows:
                valid = (first[order] <= column) & (last[order] >= column + match)
                group = np.flatnonzero(prefix < match)
                smallest = np.minimum.reduceat(np.where(valid, docs[order], LAST), group)
                repeated[order, column] = valid & (docs[order] > np.repeat(smallest, np.diff(np.r_[group, n])))
    return repeated


def _settle(buckets: int, match: int, gram: int):
    before, length = match - gram, 2 * match - gram
    names = ["block", "docs", "texts", "starts", "ends"]

    def run(pdf):
        import pandas as pd

        bucket = int(pdf.bucket.iloc[0])
        if bucket < 0:
            return pd.DataFrame({"block": -1 - bucket, "docs": pdf.docs, "texts": pdf.texts, "starts": pdf["at"], "ends": pdf.ends})
        doc, text, at, n = (np.concatenate([np.frombuffer(x, t) for x in pdf[c]]) for c, t in
                            (("docs", "<i8"), ("texts", "<i8"), ("at", "<u4"), ("ends", "<u4")))
        at, n = at.astype(np.int64), n.astype(np.int64)
        reads = np.concatenate([np.frombuffer(common.unsqueezed(x), np.uint8) for x in pdf["reads"]]).reshape(-1, length)
        found = repeated_windows(reads, doc, np.maximum(before - at, 0), np.minimum(n - at + before, length), match)
        row, column = np.nonzero(found)
        if not len(row):
            return pd.DataFrame([], columns=names)
        new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (column[1:] != column[:-1] + 1)])
        end = np.r_[new[1:], len(row)] - 1
        who = row[new]
        return pd.DataFrame(_by_block(doc[who], text[who], at[who] - before + column[new], at[who] - before + column[end] + match, buckets), columns=names)

    return run


def _kept(match: int, rest: T.StructType | None):
    """The text without its repeated bytes, from the merged spans."""
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.string() if rest else pa.binary())])
    out_type = T.StructType([T.StructField("doc", T.LongType()), *(T.StructField(c, T.LongType()) for c in schema.names[1:4]), T.StructField("kept", T.StringType() if rest else T.BinaryType()),
                             *([T.StructField("rest", rest)] if rest else [])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns, texts in _texts(batches):
            out: list[tuple] = []
            for copy, spans, text in zip(columns["copy"].to_pylist(), columns["spans"].to_pylist(), texts):
                if copy and len(text) >= match:
                    out.append((len(text), len(text), 1, b""))
                elif copy or not spans:
                    out.append((len(text), 0, 0, text))
                else:
                    pairs = np.frombuffer(spans, np.uint32).reshape(-1, 2).astype(np.int64)
                    depth = np.zeros(len(text) + 1, np.int64)
                    np.add.at(depth, pairs[:, 0], 1)
                    np.add.at(depth, pairs[:, 1], -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    out.append((len(text), int(gone.sum()), int(np.count_nonzero(gone & ~np.r_[False, gone[:-1]])),
                                np.frombuffer(text, np.uint8)[~gone].tobytes()))
            if rest:  # as text, without the bytes of characters that were cut through
                out = [(*numbers, left.decode("utf-8", "ignore")) for *numbers, left in out]
            arrays = [columns["doc"], *(pa.array(x, f.type) for x, f in zip(zip(*out), list(schema)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays + ([columns["rest"]] if rest else []), names=schema.names + (["rest"] if rest else []))

    return run, out_type


def remove_repeats(docs: DataFrame, match: int = 50, gram: int = 24) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` for every row of ``docs(doc_id, text)``.

    A byte is removed if a string of ``match`` bytes that covers it also begins in a
    document with a smaller doc_id; strings are those of the UTF-8 text, overlap
    counts, and nothing is judged by what is left. ``n_spans`` counts the maximal
    removed runs, ``kept`` has the remaining bytes. A null text is empty, and
    nothing is removed from texts shorter than ``match``. A null doc_id comes
    after all others (and is kept as 2**63 - 1 meanwhile). Rows with the same doc_id do not repeat one another.
    Other columns are not looked at; an empty table gives an empty result.
    """
    return _removed(docs.select("doc_id", "text"), match, gram, []).select(
        F.nullif("doc", F.lit(LAST)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def without_repeats(docs: DataFrame, match: int = 50, gram: int = 24) -> DataFrame:
    """The rows of ``docs``, all columns, with the text that ``remove_repeats`` leaves; ``n_chars``, if there is one, counts it.

    Bytes of a character that was cut through go as well. A row of which nothing is left stays, with an empty text, as does one with a null text.
    """
    others = [c for c in docs.columns if c != "text"]
    out = _removed(docs, match, gram, others)
    return out.select(*[F.col("kept").alias(c) if c == "text" else F.length("kept").cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
                        else F.col("rest").getField(c).alias(c) for c in docs.columns])


def _removed(docs: DataFrame, match: int, gram: int, others: list[str]) -> DataFrame:
    """``remove_repeats`` with the columns ``others`` as a struct ``rest``. The compressed texts are shuffled once and read three times."""
    buckets = min(common.partitions(docs), 1 << 15)
    rest = [common.together(docs, others).alias("rest")] if others else []
    kept_with = ["rest"] if others else []
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *rest).withColumn(
        "text_key", F.xxhash64(F.lit(7), "text"))
    first = rows.groupBy("text_key").agg(F.min("doc").alias("doc"))
    plain = rows.select("doc", "text_key", *kept_with, "text")
    packed = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in plain.schema])
    keyed = plain.mapInArrow(common.tidy(_squeezed), packed).where("doc IS NOT NULL AND text_key IS NOT NULL")  # so that all joins read the same shuffle
    text = ["doc", "text_key"]
    single = keyed.join(first, text, "left_semi")

    dealt = single.select("text_key", *kept_with, "text").mapInArrow(common.tidy(_dealt(buckets, match, gram)), postings.DEALT_DDL)
    shared = postings.shared_keys(dealt, buckets).select(F.col("owner").alias("text_key"), F.col("keys").alias("shared")).join(first, "text_key")
    reads = keyed.join(shared, text).select("doc", "text_key", "shared", *kept_with, "text").mapInArrow(common.tidy(_reads(buckets, match, gram)), READS_DDL)
    spans = (reads.groupBy("bucket").applyInPandas(common.tidy_group(_settle(buckets, match, gram)), SPANS_DDL)
             .groupBy("block").applyInPandas(common.tidy_group(_marked), MARKED_DDL))
    marked = first.select("doc", "text_key", F.lit(False).alias("copy")).join(spans, text, "left")
    kept, out_type = _kept(match, rows.schema["rest"].dataType if others else None)
    return (keyed.join(marked, text, "left").select("doc", F.coalesce("copy", F.lit(True)).alias("copy"), "spans", *kept_with, "text")
            .mapInArrow(common.tidy(kept), out_type))
