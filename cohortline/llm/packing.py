"""Documents packed into sequences of bounded length.

Method: cost-balanced packing. The attention cost of a sequence is estimated as
``linear * tokens`` plus ``quadratic`` times the squared length of each document
in it. Documents go in descending length to the sequence with the lowest cost
that has room. What fits nowhere any more is cut into the rooms left, lowest
cost first, so that a block of sequences lacks less than one sequence's tokens.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("tokens", pa.binary()),
                   ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECE_DDL = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
BEYOND = re.compile("[^\x00-\u024f]")
LONG_SPACE = 1 << 14  # white space from which on the quick path is not tried
BLOCK = 2048  # rests of documents that are balanced against each other


class Encoder:
    """Ids of texts by a file of the `tokenizers` library.

    The quick path is the same vocabulary read as ranks. It is taken only for files that say no more than
    byte-level BPE does (no normaliser, no prefix space, the byte-level pattern, merges in the order of their
    ids), and for texts of Latin letters below U+0250 that hold no special token and no run of ``LONG_SPACE``
    white-space characters; it gives the same ids there (a test compares them). All others go
    through the library itself, as does a text at which the quick path fails. With ``plain`` the
    strings of special tokens inside texts are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        import json

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.path, self.plain = path, plain
        self.special = [t["content"] for t in said.get("added_tokens", [])]
        self.quick = self._ranks(said) if self.byte_level(said) else None

    @staticmethod
    def byte_level(said: dict) -> bool:
        """Whether ranks say all that the file says about a text without special tokens."""
        model, before = said["model"], said.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or said.get("normalizer") or before.get("type") != "ByteLevel":
            return False
        if before.get("add_prefix_space", True) or not before.get("use_regex", True):
            return False
        if any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        return all(x < y for x, y in zip(ids, ids[1:]))

    def _ranks(self, said: dict):
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {bytes(letters[c] for c in token): i for token, i in said["model"]["vocab"].items() if token not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: that of byte-level BPE
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def whole(self):
        """The library's own tokenizer, read when a text needs it."""
        from tokenizers import Tokenizer

        out = Tokenizer.from_file(self.path)
        out.encode_special_tokens = self.plain
        return out

    def quickly(self, text: str) -> bool:
        return (self.quick is not None and not BEYOND.search(text) and (self.plain or not any(s in text for s in self.special))
                and (len(text) < LONG_SPACE or all(m.end() - m.start() < LONG_SPACE for m in re.finditer(r"\s{2,}", text))))

    def __call__(self, text: str) -> list[int]:
        if self.quickly(text):
            try:
                return self.quick.encode_ordinary(text)
            except (KeyboardInterrupt, SystemExit, GeneratorExit):
                raise
            except BaseException:  # a panic of the library is no Exception
                self.quick = None
        return self.whole.encode(text, add_special_tokens=False).ids


def balanced(lengths: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of ``(document, first token, tokens)``; together they hold every token once.

    Lengths are positive and at most ``capacity``; as many sequences are opened as the tokens need.
    """
    n = -(-int(lengths.sum()) // capacity)
    placed: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    price = linear * lengths + quadratic * lengths.astype(np.float64) ** 2
    left: list[tuple[int, int]] = []
    for d in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[d])
        fits = np.flatnonzero(room >= size)
        if len(fits):
            s = int(fits[np.argmin(cost[fits])])
            placed[s].append((d, 0, size))
            cost[s] += price[d]
            room[s] -= size
        else:
            left.append((d, size))
    rooms = [(cost[s], s) for s in range(n) if room[s]]
    heapq.heapify(rooms)
    for d, size in left:
        begin = 0
        while begin < size:
            _, s = heapq.heappop(rooms)
            part = min(size - begin, int(room[s]))
            placed[s].append((d, begin, part))
            room[s] -= part
            cost[s] += linear * part + quadratic * part * part
            begin += part
            if room[s]:
                heapq.heappush(rooms, (cost[s], s))
    return placed


def _pack(path: str, capacity: int, end: int, linear: float, quadratic: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path)
        task = TaskContext.get()
        next_id = (task.partitionId() if task else 0) << 40
        rests: list[tuple[int | None, int, np.ndarray, int]] = []
        rows: list[tuple] = []

        def block() -> None:
            nonlocal next_id
            for sequence in balanced(np.fromiter((len(r[2]) for r in rests), np.int64, len(rests)), capacity, linear, quadratic):
                offset = 0
                for d, first, n in sequence:
                    doc, start, ids, total = rests[d]
                    rows.append((doc, start + first, n, ids[first:first + n].tobytes(), total, next_id, offset))
                    offset += n
                next_id += 1
            rests.clear()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), PIECE)], schema=PIECE)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.asarray([*encode(text or ""), end], "<u4")
                whole = len(ids) // capacity * capacity
                for a in range(0, whole, capacity):
                    rows.append((doc, a, capacity, ids[a:a + capacity].tobytes(), len(ids), next_id, 0))
                    next_id += 1
                if whole < len(ids):
                    rests.append((doc, whole, ids[whole:], len(ids)))
                if len(rests) == BLOCK:
                    block()
                if len(rows) >= 2 * BLOCK:
                    yield flushed()
        if rests:
            block()
        if rows:
            yield flushed()

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 1024, end: int = 0, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``: ``(doc_id, start, length, tokens, doc_tokens, sequence_id, offset)``.

    A document is the ids of its text and then ``end``; ``tokens`` are the
    piece's ids as little-endian 32-bit numbers. Full sequences of a long document
    stand alone, and the rests of ``BLOCK`` documents at a time are balanced against
    each other where they are read: nothing is shuffled, and a task holds one
    block. Ids are numbered from the task's number on, so that a task that is run
    again on the same rows gives the same sequences.

    ``vocabulary`` is a file of the `tokenizers` library that every executor can open.
    A null text is empty: one piece with ``end`` alone. A null doc_id stays null and
    repeated rows are documents of their own. Other columns are not looked at; an
    empty table gives no pieces.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(common.tidy(_pack(vocabulary, capacity, end, linear, quadratic)), PIECE_DDL)
