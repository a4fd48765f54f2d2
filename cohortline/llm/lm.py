"""Scoring of texts by a language model.

Method: log-frequency Bloom filter. The counts of words and word pairs of the
training texts are quantised on a log scale; an n-gram of level q is put into the filter
once with each of the levels 1 to q. Asking for levels 1, 2, ... until one
is missing gives a count back. All counts of the model come from such probes:

    P(w | v) = (c(v w) + d(v) P(w)) / (c(v) + d(v)),    d(v) = DEPTH * c(v) ** BEND
    P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1))

Counts above the line are a level's least, those below the line its greatest value, so that the
probabilities after a word add up to one at most, but for the filter's chance
errors (below 1 % a probe).

All n-grams of all training texts are counted, and all are in the filter. Each of its slices holds the n-grams
of one hash bucket, is built where these are counted and has BITS_EACH bits for an entry (together FILTER_BITS at
least), so that the filter grows with the corpus. It is broadcast in passes of PASS_BYTES; a portion of texts meets
them one after the other, and a worker holds one at a time.

The base score needs exact counts of words: those of the HEAD most frequent ones are
broadcast, occurrences of all others are dealt by hash to the tasks that hold their counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common, postings

FILTER_BITS = 1 << 28  # at least
BITS_EACH = 12
PASS_BYTES = 1 << 25
PORTION = 1 << 19  # tokens that meet the passes together, if there are several
HASHES = 5
HEAD = 1 << 18
SCALE = 1.5  # of the levels
DEPTH, BEND = 4.0, 0.8
MASKS = (128 >> np.arange(8)).astype(np.uint8)
END = common.mixed(np.asarray([0xE0D], np.uint64))[0]
BEGIN = common.mixed(np.asarray([0xB0], np.uint64))[0]
HELD = 1 << 21  # words of a portion that is counted together
COUNTED = pa.schema([("bucket", pa.int32()), ("words", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
COUNTED_DDL = "bucket int, words int, keys binary, counts binary"
SLICE_DDL = "bucket int, tokens long, words long, bits binary, head_keys binary, head_counts binary, tail_keys binary, tail_counts binary"
PART = pa.schema([("bucket", pa.int32()), ("rows", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
PART_DDL = "bucket int, rows binary, counts binary, keys binary"
SUM_DDL = "block int, documents binary, sums binary"
DOCUMENT = np.dtype([("row", "<i8"), ("doc_id", "<i8"), ("missing", "u1"), ("score", "<f8"), ("base", "<f8"), ("n_tokens", "<i8"), ("n_known", "<i8")])
SUM = np.dtype([("row", "<i8"), ("base", "<f8"), ("n_known", "<i8")])


def level_bounds() -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest count of each level from 1 on."""
    least = np.unique(np.ceil(SCALE ** np.arange(0, 108) - 1e-9))
    return least, np.r_[least[1:] - 1, np.inf]


def likely() -> tuple[np.ndarray, np.ndarray]:
    """Counts that stand for each level above and below the line."""
    least, most = level_bounds()
    return least, np.where(np.isfinite(most), most, least * SCALE)


def levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(level_bounds()[0], counts, side="right")


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return common.mixed(before * np.uint64(0x9FB21C651E98DF25) + word * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _entry(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and step of the positions of (key, level)."""
    entry = common.mixed(keys + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    return entry, common.mixed(entry) | np.uint64(1)


def _place(entry: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    return ((entry >> np.uint64(32)) * np.asarray(bits, np.uint64) >> np.uint64(32)).astype(np.int64)


def enough(counts: np.ndarray, least: int) -> int:
    """Bits, in whole bytes, that a slice needs for all n-grams with these counts."""
    return max(least // 8 * 8, 8, -(-int(levels(counts).sum()) * BITS_EACH // 8) * 8)


def built(keys: np.ndarray, counts: np.ndarray, bits: int) -> np.ndarray:
    """A slice of the filter with all keys; ``enough`` says how many bits they need."""
    q = levels(counts)
    field = np.zeros(bits, np.uint8)
    for level in range(1, int(q.max(initial=0)) + 1):
        entry, step = _entry(keys[q >= level], level)
        for _ in range(HASHES):
            field[_place(entry, bits)] = 1
            entry = entry + step
    return np.packbits(field)


class Filter:
    """The slices side by side; bit ``at`` of a slice counts from the left.

    ``where`` and ``sizes`` are the buckets and bytes of slices that are not one for every bucket or not of one size.
    """

    def __init__(self, slices: np.ndarray, where: np.ndarray | None = None, sizes: np.ndarray | None = None, buckets: int = 0):
        if where is None:
            where, sizes, buckets = np.arange(len(slices)), np.full(len(slices), slices.shape[1]), len(slices)
        self.flat, self.buckets = slices.reshape(-1), buckets
        self.begin, self.bits = np.zeros(buckets, np.int64), np.zeros(buckets, np.uint64)
        self.begin[where], self.bits[where] = (np.cumsum(sizes) - sizes) * 8, sizes * 8
        self.least, self.most = likely()

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each n-gram: membership is probed from level 1 on until it fails; 0 if it is in none."""
        out = np.zeros(len(hashes), np.int64)
        bucket = postings.bucket_of(hashes, self.buckets)
        alive = np.flatnonzero(self.bits[bucket])
        keys, begin, bits = postings.key_of(hashes[alive], self.buckets), self.begin[bucket[alive]], self.bits[bucket[alive]]
        for level in range(1, len(self.least) + 1):
            entry, step = _entry(keys, level)
            for _ in range(HASHES):
                at = begin + _place(entry, bits)
                there = np.flatnonzero(MASKS[at & 7] & self.flat[at >> 3])
                if len(there) < len(alive):
                    alive, keys, begin, bits, entry, step = (x[there] for x in (alive, keys, begin, bits, entry, step))
                entry = entry + step
            if not len(alive):
                break
            out[alive] = level
        return out


class Passes:
    """The whole filter, as broadcast slices: (bytes, buckets, sizes) each."""

    def __init__(self, passes: list, of_bucket: np.ndarray):
        self.passes, self.of_bucket, self.whole = passes, of_bucket, None

    def _filter(self, k: int) -> Filter:
        if self.whole is not None:
            return self.whole
        found = Filter(*self.passes[k].value, len(self.of_bucket))
        if len(self.passes) == 1:
            self.whole = found
        elif getattr(self.passes[k], "_path", None):
            del self.passes[k]._value  # it is read again from its file
        return found

    def level(self, hashes: np.ndarray) -> np.ndarray:
        """As of a filter, from the pass that has the n-gram's slice."""
        if len(self.passes) == 1:
            return self._filter(0).level(hashes)
        out = np.zeros(len(hashes), np.int64)
        which = self.of_bucket[postings.bucket_of(hashes, len(self.of_bucket))]
        order = np.argsort(which, kind="stable")
        for k, a, b in postings.slices(which[order]):
            if k >= 0:
                out[order[a:b]] = self._filter(k).level(hashes[order[a:b]])
        return out


def _broadcast(spark, slices: Iterable[tuple[int, bytes]], buckets: int) -> tuple[list, np.ndarray]:
    """Slices (bucket, bytes) as broadcast passes, and the pass of each bucket (-1: it has no n-grams). The driver holds one pass."""
    passes, of_bucket = [], np.full(buckets, -1, np.int64)
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def send() -> None:
        where, parts = np.asarray([b for b, _ in held]), [x for _, x in held]
        of_bucket[where] = len(passes)
        passes.append(spark.sparkContext.broadcast((np.concatenate(parts), where, np.asarray([len(x) for x in parts]))))
        held.clear()

    for bucket, data in slices:
        if held and size + len(data) > PASS_BYTES:
            send()
            size = 0
        held.append((bucket, np.frombuffer(data, np.uint8)))
        size += len(data)
    if held:
        send()
    return passes, of_bucket


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token, an end after each text; of the token before it; and the text it is in."""
    hashes, bounds = common.words(texts)
    token = np.insert(hashes, bounds[1:], END)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds) + 1)
    before = np.r_[BEGIN, token[:-1]].astype(np.uint64)
    before[bounds[:-1] + np.arange(len(texts))] = BEGIN
    return token, before, text


def _portions(batches: Iterable[pa.RecordBatch], least: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Ids and _tokens of so many chunks of texts that there are ``least`` tokens."""
    held: list[tuple] = []
    texts_held = size = 0

    def joined() -> tuple:
        ids, *found = zip(*held)
        return pa.concat_arrays(ids), *map(np.concatenate, found)

    for part, texts in common.chunks(batches, "text"):
        token, before, text = _tokens(texts)
        held.append((part.column(0), token, before, text + texts_held))
        texts_held, size = texts_held + len(texts), size + len(token)
        if size >= least:
            yield joined()
            held, texts_held, size = [], 0, 0
    if held:
        yield joined()


def _count(buckets: int):
    """Counts of words (words 1) and pairs (words 2), put together per portion."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            rows: list[tuple] = []
            for n, hashes in enumerate((np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), 1):
                key, count = np.unique(hashes, return_counts=True)  # in the order of their buckets
                rows += [(b, n, postings.to_six(key[i:j] & postings.LOW).tobytes(), count[i:j].astype("<u4").tobytes())
                         for b, i, j in postings.slices(postings.bucket_of(key, buckets))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), COUNTED)], schema=COUNTED)

        for _, texts in common.chunks(batches, "text"):
            token, before, _ = _tokens(texts)
            held.append((token, pair_hash(before, token)))
            size += len(token)
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _added(keys: list[bytes], counts: list[bytes], bucket: int) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.concatenate([postings.from_six(x) for x in keys])
    count = np.concatenate([np.frombuffer(x, "<u4") for x in counts]).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first] | (np.uint64(bucket) << np.uint64(48)), np.add.reduceat(count, first)


def _slice(buckets: int):
    """A bucket's slice of the filter and its exact counts of words, the most frequent ones apart."""
    def run(pdf):
        import pandas as pd

        bucket = int(pdf.bucket.iloc[0])
        (word, count), (pair, times) = (_added(list(pdf["keys"][pdf.words == n]), list(pdf["counts"][pdf.words == n]), bucket) for n in (1, 2))
        every = np.concatenate([count, times])
        bits = built(np.concatenate([word, pair]), every, enough(every, FILTER_BITS // buckets))
        head = np.zeros(len(word), bool)
        head[np.lexsort((word, -count))[:max(1, HEAD // buckets)]] = True
        return pd.DataFrame([{"bucket": bucket, "tokens": int(count.sum()), "words": len(word), "bits": bits.tobytes(),
                              "head_keys": word[head].tobytes(), "head_counts": count[head].tobytes(),
                              "tail_keys": word[~head].tobytes(), "tail_counts": count[~head].tobytes()}])

    return run


def _score(model, passes: list, buckets: int):
    """Scores of documents (buckets from ``buckets`` on, by block), and the words whose counts are elsewhere (by bucket)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        of_bucket, head_keys, head_counts, n, v = model.value
        bloom, total = Passes(passes, of_bucket), n + 0.5 * (v + 1)
        least, most = likely()
        task = TaskContext.get()
        next_row = (task.partitionId() if task else 0) << 33
        documents: list[np.ndarray] = []
        tail: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            document = np.concatenate(documents)
            rows = [(buckets + b, document[i:j].tobytes(), b"", b"") for b, i, j in _blocks(document, buckets)]
            row, key, count = map(np.concatenate, zip(*tail))
            order = np.argsort(_bucket(key), kind="stable")
            row, key, count = row[order], key[order], count[order]
            rows += [(b, row[i:j].tobytes(), count[i:j].astype("<u4").tobytes(), postings.to_six(key[i:j] & postings.LOW).tobytes())
                     for b, i, j in postings.slices(_bucket(key))]
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PART)], schema=PART)

        for ids, token, before, text in _portions(batches, PORTION if len(passes) > 1 else 1):
            word, which = np.unique(token, return_inverse=True)
            pair, of_pair = np.unique(pair_hash(before, token), return_inverse=True)
            level = bloom.level(np.concatenate([word, pair]))
            pair_level, level = level[len(word):][of_pair], level[:len(word)]
            end_level = level[np.searchsorted(word, END)]  # every text has an end
            count = np.where(level > 0, least[level - 1], 0.0)[which]
            at_start = before == BEGIN
            context = np.where(at_start, end_level, np.r_[0, level[which][:-1]])
            context = np.where(context > 0, most[context - 1], 0.0)
            single = (count + 0.5) / total
            depth = DEPTH * context ** BEND
            both = np.where(pair_level > 0, least[pair_level - 1], 0.0)
            probability = np.where(context > 0, (np.minimum(both, context) + depth * single) / np.maximum(context + depth, 1e-300), single)

            keys = postings.key_of(word, buckets)
            at = np.minimum(np.searchsorted(head_keys, keys), max(0, len(head_keys) - 1))
            known = head_keys[at] == keys if len(head_keys) else np.zeros(len(keys), bool)
            base = np.where(known, np.log10(((head_counts[at] if len(head_keys) else np.zeros(len(keys))) + 0.5) / total), 0.0)[which]
            document = np.zeros(len(ids), DOCUMENT)
            document["row"] = next_row + np.arange(len(ids))
            document["missing"] = ids.is_null().to_numpy(zero_copy_only=False)
            document["doc_id"] = ids.fill_null(0).to_numpy()
            document["score"] = np.bincount(text, np.log10(probability), len(ids))
            document["base"] = np.bincount(text, base, len(ids))
            document["n_tokens"] = np.bincount(text, minlength=len(ids))
            document["n_known"] = np.bincount(text, known[which], len(ids))
            documents.append(document)
            elsewhere = ~known[which]
            code, times = np.unique(text[elsewhere] * len(word) + which[elsewhere], return_counts=True)
            tail.append((next_row + code // len(word), keys[code % len(word)], times))
            next_row += len(ids)
            size += len(token)
            if size >= HELD:
                yield flush()
                documents, tail, size = [], [], 0
        if documents:
            yield flush()

    return run


def _bucket(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(48)).astype(np.uint16)


def _blocks(records: np.ndarray, blocks: int) -> list[tuple[int, int, int]]:
    """Sorts records by the block of their row, in place."""
    records[:] = records[np.argsort(records["row"] % blocks, kind="stable")]
    return postings.slices(records["row"] % blocks)


def _looked_up(buckets: int, total: float):
    """The base score of the words of a bucket, summed per document and packed by block; documents pass through."""
    def run(parts, counts):
        import pandas as pd

        if not len(parts):
            return pd.DataFrame([], columns=["block", "documents", "sums"])
        bucket = int(parts.bucket.iloc[0])
        if bucket >= buckets:
            return pd.DataFrame({"block": bucket - buckets, "documents": parts.rows, "sums": [b""] * len(parts)})
        row = np.concatenate([np.frombuffer(x, "<i8") for x in parts.rows])
        times = np.concatenate([np.frombuffer(x, "<u4") for x in parts["counts"]]).astype(np.int64)
        key = np.concatenate([postings.from_six(x) for x in parts["keys"]]) | (np.uint64(bucket) << np.uint64(48))
        count = np.zeros(len(key))
        if len(counts) and len(counts.tail_keys.iloc[0]):
            known, of = np.frombuffer(counts.tail_keys.iloc[0], np.uint64), np.frombuffer(counts.tail_counts.iloc[0], np.int64)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            count = np.where(known[at] == key, of[at], 0)
        rows, which = np.unique(row, return_inverse=True)
        sums = np.zeros(len(rows), SUM)
        sums["row"] = rows
        sums["base"] = np.bincount(which, times * np.log10((count + 0.5) / total), len(rows))
        sums["n_known"] = np.bincount(which, times * (count > 0), len(rows))
        return pd.DataFrame([(b, b"", sums[i:j].tobytes()) for b, i, j in _blocks(sums, buckets)], columns=["block", "documents", "sums"])

    return run


def _summed(pdf):
    """The documents of a block with all of their base score."""
    import pandas as pd

    document = np.concatenate([np.frombuffer(x, DOCUMENT) for x in pdf.documents])
    document = document[np.argsort(document["row"])].copy()
    sums = np.concatenate([np.frombuffer(x, SUM) for x in pdf.sums])
    at = np.searchsorted(document["row"], sums["row"])
    np.add.at(document["base"], at, sums["base"])
    np.add.at(document["n_known"], at, sums["n_known"])
    out = pd.DataFrame({c: document[c] for c in ("n_tokens", "n_known", "base", "score")})
    out.insert(0, "doc_id", pd.array(document["doc_id"], "Int64"))
    out.loc[document["missing"] == 1, "doc_id"] = pd.NA
    return out


def score(docs: DataFrame, learn_from: Column | None = None) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` for every row of ``docs(doc_id, text)``.

    Learns from the rows at which ``learn_from`` holds (all, if none is given) and
    scores all. A text is its words and one end. ``score`` is the model's log10
    probability of it, ``base_score`` the sum over its tokens of log10((c + 0.5) / (N +
    0.5 (V + 1))) with exact counts, ``n_known`` the tokens with c > 0. A null text is
    empty: its only token is the end. Rows without id are scored, repeated rows
    each for themselves. Without training rows both scores are 0. Other columns
    are not looked at; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    buckets = min(common.partitions(docs), 1 << 15)
    chosen = docs if learn_from is None else docs.where(learn_from)
    slices = common.cut(chosen.select("text").mapInArrow(common.tidy(_count(buckets)), COUNTED_DDL).groupBy("bucket").applyInPandas(common.tidy_group(_slice(buckets)), SLICE_DDL), few=False)
    head: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    n = v = 0

    def read() -> Iterator[tuple[int, bytes]]:
        nonlocal n, v
        for r in slices.select("bucket", "tokens", "words", "bits", "head_keys", "head_counts").toLocalIterator():
            head.append((np.frombuffer(r.head_keys, np.uint64), np.frombuffer(r.head_counts, np.int64)))
            n, v = n + r.tokens, v + r.words
            yield r.bucket, r.bits

    passes, of_bucket = _broadcast(spark, read(), buckets)
    keys, counts = map(np.concatenate, zip(*head))
    order = np.argsort(keys)
    model = spark.sparkContext.broadcast((of_bucket, keys[order], counts[order], n, v))
    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.tidy(_score(model, passes, buckets)), PART_DDL)
    sums = parts.groupBy("bucket").cogroup(slices.select("bucket", "tail_keys", "tail_counts").groupBy("bucket")).applyInPandas(
        common.tidy_groups(_looked_up(buckets, n + 0.5 * (v + 1))), SUM_DDL)
    out = sums.groupBy("block").applyInPandas(common.tidy_group(_summed), "doc_id long, n_tokens long, n_known long, base double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
