"""Two tokenizers' tokens of the same text, aligned.

Method: diagonal run skipping. Both token sequences spell the same bytes, so each is known by the byte offsets at
which its tokens end. At the current shift between the two indices, stretches of 8, 16, 32, ... ends are compared as a whole;
as long as they agree, each A token is exactly one B token, and the stretch is jumped. Where they stop agreeing, the
stretch is halved down to the few ends that hold the first difference, the irregular group there is resolved token by token until both end at
the same byte, and the shift is what this group leaves. Groups, and all pairs of tokens whose bytes overlap, come out of this one walk.

How many documents hold a pair linked is counted over the corpus: tasks count the pairs of all their documents, the
sums are combined by Spark. The counts go back to the documents in two ways: the HEAD most frequent pairs are broadcast
(a fixed size), all others are joined by pair and added up per document.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common
from cohortline.llm.packing import Encoder

SHORT = 8  # ends of the first stretch
HEAD = 1 << 17  # pairs that are broadcast: 2.2 MB
HELD = 1 << 20  # distinct pairs that a task counts before it passes them on
ALIGNED = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")],
                     ("groups", pa.string()), ("pairs", pa.binary()), ("times", pa.binary())])
ALIGNED_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs binary, times binary"


class ByteLevel:
    """A byte-level vocabulary of the `tokenizers` library; strings of special tokens are plain text."""

    def __init__(self, path: str):
        import json

        self.encode_one = Encoder(path, plain=True)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        special = {t["content"] for t in said.get("added_tokens", [])}
        self.spelt = [b""] * (1 + max(said["model"]["vocab"].values()))
        for token, i in said["model"]["vocab"].items():
            self.spelt[i] = token.encode() if token in special else bytes(letters[c] for c in token)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encode_one(" " + t) for t in texts]


class Pieces:
    """A `sentencepiece` model that puts a space before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelt = [self._bytes(i) for i in range(self.model.vocab_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def stretches(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, list[int], list[int]]]:
    """The walk over two lists of ends: ``(i, j, k, [], [])`` where the ``k`` tokens from ``i`` and ``j`` on are one to one,
    ``(i, j, 0, links in a, links in b)`` for an irregular group. Ends grow strictly and the last ones are equal."""
    i = j = 0
    n = len(a)
    while i < n:
        first, width = i, SHORT
        while a[i:i + width] == b[j:j + width]:
            step = min(width, n - i)
            i += step
            j += step
            if i == n:
                break
            width *= 2
        else:
            while width > SHORT:
                width //= 2
                if a[i:i + width] == b[j:j + width]:
                    i += width
                    j += width
            x, y = a[i], b[j]
            while x == y:  # the first difference lies within the next few
                i += 1
                j += 1
                x, y = a[i], b[j]
        if i > first:
            yield first, j - (i - first), i - first, [], []
        if i < n:
            at_a, at_b = [i], [j]
            p, q = i, j
            while x != y:
                if x < y:
                    p += 1
                    x = a[p]
                else:
                    q += 1
                    y = b[q]
                at_a.append(p)
                at_b.append(q)
            yield i, j, 0, at_a, at_b
            i, j = p + 1, q + 1


class Vocabulary:
    """What the alignment needs of each id, looked up rather than made: its bytes, their number and the id as text, with what follows it
    within a group and at the end of one."""

    def __init__(self, spelt: list[bytes], end: str):
        self.spelt = spelt
        self.size = np.fromiter(map(len, spelt), np.int64, len(spelt))
        self.name = np.array([f"{i}{after}" for after in ("," + end) for i in range(len(spelt))], bytes)


def aligned(ids_a: list[int], ids_b: list[int], one: Vocabulary, other: Vocabulary, names: np.ndarray, whole: bytes) -> tuple[int, str, np.ndarray] | None:
    """How many groups there are, these as ``a1,a2|b1;a3|b2``, and links as ``a << 32 | b``, one for each overlapping pair; None where
    the tokens do not spell ``whole``. ``names`` are those of both vocabularies, one after the other."""
    if not ids_a or not ids_b or b"".join(map(one.spelt.__getitem__, ids_a)) != whole or b"".join(map(other.spelt.__getitem__, ids_b)) != whole:
        return None
    own_a, own_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    a, b = np.cumsum(one.size[own_a]).tolist(), np.cumsum(other.size[own_b]).tolist()
    runs: list[int] = []
    at_a: list[int] = []
    at_b: list[int] = []
    ends: list[int] = []
    for i, j, k, links_a, links_b in stretches(a, b):
        if k:
            runs += (i, j, k)
        else:
            at_a += links_a
            at_b += links_b
            ends.append(len(at_a))
    first_a, first_b, many = np.array(runs, np.int64).reshape(-1, 3).T
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    run_a, run_b = np.repeat(first_a, many) + step, np.repeat(first_b, many) + step
    odd_a, odd_b, last = np.array(at_a, np.int64), np.array(at_b, np.int64), np.array(ends, np.int64) - 1
    place_a, place_b = np.concatenate([run_a, odd_a]), np.concatenate([run_b, odd_b])
    # the last tokens of every group, in order; a group's A tokens stand before its B tokens
    end_a, end_b = np.sort(np.concatenate([run_a, odd_a[last]])), np.sort(np.concatenate([run_b, odd_b[last]]))
    code_a, code_b = own_a.copy(), own_b + len(one.name)
    code_a[end_a] += len(one.spelt)
    code_b[end_b] += len(other.spelt)
    many_a, many_b = np.diff(end_a, prepend=-1), np.diff(end_b, prepend=-1)
    codes = np.empty(len(own_a) + len(own_b), np.int64)
    codes[np.arange(len(own_a)) + np.repeat(end_b + 1 - many_b, many_a)] = code_a
    codes[np.arange(len(own_b)) + np.repeat(end_a + 1, many_b)] = code_b
    groups = names[codes].tobytes().translate(None, b"\0")[:-1].decode()
    return len(end_a), groups, own_a[place_a].astype(np.uint64) << np.uint64(32) | own_b[place_b].astype(np.uint64)


def _alignments(first: str, second: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = ByteLevel(first), Pieces(second)
        first_words, second_words = Vocabulary(one.spelt, "|"), Vocabulary(other.spelt, ";")
        names = np.concatenate([first_words.name, second_words.name])
        gc.freeze()  # the vocabularies stay as they are: no need to look through them again and again
        for part, raw in common.chunks(batches, "text", 1 << 18):
            texts = [t.decode() for t in raw]
            columns: dict[str, list] = {f.name: [] for f in list(ALIGNED)[2:]}
            for text, ids_a, ids_b in zip(raw, one.encode(texts), other.encode(texts)):
                found = aligned(ids_a, ids_b, first_words, second_words, names, b" " + text) if text else None
                n_groups, groups, links = found or (0, "", np.empty(0, np.uint64))
                pairs, times = np.unique(links, return_counts=True)
                values = (len(ids_a) if found else 0, len(ids_b) if found else 0, n_groups, len(links), groups,
                          common.squeezed(np.diff(pairs, prepend=np.uint64(0)).tobytes()), common.squeezed(times.astype("<u4").tobytes()))
                for column, value in zip(columns.values(), values):
                    column.append(value)
            yield common.as_batch(ALIGNED, row=part.column(0), doc_id=part.column(1), **columns)

    return run


def alignments(docs: DataFrame, first: str, second: str) -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times)`` for every row of ``docs(doc_id, text)``.

    ``first`` is a byte-level file of the `tokenizers` library (A, which reads a space and the text), ``second`` a
    `sentencepiece` model (B, which adds that space); every executor must be able to open both. ``groups`` reads
    ``a1,a2|b1;a3|b2,b3``: the ids between two byte offsets at which tokens of both end. ``pairs`` and ``times`` are the packed
    distinct links and how often each occurs. A text that is null, empty or not spelt by one of the two has no
    tokens and zeros. Ids may be null and rows may repeat: ``row`` numbers them. Other columns are
    not looked at; an empty table gives an empty result.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(common.tidy(_alignments(first, second)), ALIGNED_DDL)


def _links(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for pairs, times in zip(batch.column("pairs").to_pylist(), batch.column("times").to_pylist()):
        yield np.cumsum(np.frombuffer(common.unsqueezed(pairs), np.uint64), dtype=np.uint64), np.frombuffer(common.unsqueezed(times), "<u4").astype(np.int64)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per pair, over as many documents as the held pairs allow."""
    schema = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
    pairs, n = np.empty(0, np.uint64), np.empty(0, np.int64)
    waiting: list[np.ndarray] = []
    size = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate([pairs, *waiting])
        many = np.concatenate([n, np.ones(size, np.int64)])
        order = np.argsort(every, kind="stable")
        every, many = every[order], many[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]]) if len(every) else np.empty(0, np.int64)
        return every[first], np.add.reduceat(many, first) if len(first) else many

    for batch in batches:
        for own, _ in _links(batch):
            waiting.append(own)
            size += len(own)
            if size >= HELD:
                pairs, n = merged()
                waiting, size = [], 0
                if len(pairs) >= HELD:
                    yield common.as_batch(schema, pair=pairs.view(np.int64), n=n)
                    pairs, n = pairs[:0], n[:0]
    pairs, n = merged()
    if len(pairs):
        yield common.as_batch(schema, pair=pairs.view(np.int64), n=n)


def pair_counts(links: DataFrame) -> DataFrame:
    """``(pair, n, best)``, written: in how many rows of ``links(pairs, times)`` a pair is linked, and whether no pair of its A token is in more."""
    counts = links.select("pairs", "times").mapInArrow(common.tidy(_counted), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = common.cut(counts.withColumn("a", F.shiftrightunsigned("pair", 32)))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return common.cut(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _summed(head):
    """Sums over the links of each row that are in the head."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("head_best", pa.int64()), ("head_sum", pa.int64())])
        pair, n, best = head.value
        for batch in batches:
            sums = []
            for own, times in _links(batch):
                at, there = found(own, pair)
                sums.append((int(times[there][best[at]].sum()), int((times[there] * n[at]).sum())))
            yield common.as_batch(schema, row=batch.column("row"), head_best=[s[0] for s in sums], head_sum=[s[1] for s in sums])

    return run


def _rare(head):
    """Links that are not in the head, a row each."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("row", pa.int64()), ("pair", pa.int64()), ("times", pa.int64())])
        pair = head.value[0]
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            for row, (own, times) in zip(batch.column("row").to_pylist(), _links(batch)):
                rare = ~found(own, pair)[1]
                held.append((np.full(int(rare.sum()), row, np.int64), own[rare].view(np.int64), times[rare]))
                if len(held) == 1024:
                    yield common.as_batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*held)))))
                    held.clear()
        if held:
            yield common.as_batch(schema, **dict(zip(schema.names, map(np.concatenate, zip(*held)))))

    return run


def found(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``ordered`` of those values that are in it, and which these are."""
    if not len(ordered):
        return np.empty(0, np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    there = ordered[at] == values
    return at[there], there


def with_counts(links: DataFrame) -> DataFrame:
    """``links`` with ``n_best`` and ``count_sum``: the links whose count is the highest of their A token, and the sum of all links' counts.

    ``links`` is a written table of ``alignments`` (with or without ``groups``); ``pairs`` and ``times`` are taken off.
    """
    counts = pair_counts(links)
    top = counts.orderBy(F.desc("n"), "pair").limit(HEAD).collect()
    pair = np.asarray([r.pair for r in top], np.int64).view(np.uint64)
    order = np.argsort(pair)
    head = links.sparkSession.sparkContext.broadcast((
        pair[order], np.asarray([r.n for r in top], np.int64)[order], np.asarray([r.best for r in top], bool)[order]))
    own = links.select("row", "pairs", "times")
    summed = own.mapInArrow(common.tidy(_summed(head)), "row long, head_best long, head_sum long")
    rare = own.mapInArrow(common.tidy(_rare(head)), "row long, pair long, times long").join(counts, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best"), F.sum(F.col("times") * F.col("n")).alias("rare_sum"))
    sums = summed.join(rare, "row", "left").select(
        "row", (F.col("head_best") + F.coalesce("rare_best", F.lit(0))).alias("n_best"), (F.col("head_sum") + F.coalesce("rare_sum", F.lit(0))).alias("count_sum"))
    return links.drop("pairs", "times").join(sums, "row")
