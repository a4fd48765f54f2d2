"""Words, fingerprints and batches, as the operators on texts share them.

Words are runs of bytes other than space and the five control characters 09-0D;
A-Z count as a-z. A word is known by a 64-bit hash of its bytes, a run of words
by a 64-bit hash of theirs. Two different ones among n collide with a chance of
about n**2 / 2**65.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.runtime import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
LOWERED = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint64)
CHUNK_BYTES = 1 << 20


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def column_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts take ``limit`` bytes, or that hold one row."""
    for batch in batches:
        texts = column_bytes(batch.column(batch.schema.get_field_index(text)))
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t) + 1
        if texts:
            yield batch.slice(start), texts[start:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and where each text's words begin (with the end of the last)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    spaces = SPACES[joined]
    at = np.flatnonzero(~spaces)
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(at) > 1])  # joined texts are divided by a space
    sizes = np.diff(np.r_[first, len(at)])
    offset = np.arange(len(at)) - np.repeat(first, sizes)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(sizes.max()) - 1, 0x9E3779B97F4A7C15, np.uint64)])
    hashes = np.add.reduceat((LOWERED[joined[at]] + np.uint64(1)) * powers[offset], first)
    bounds = np.searchsorted(at[first], np.r_[0, np.cumsum(lengths)])
    return mixed(hashes + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), bounds


def sequence_hash(hashes: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of word hashes; its length counts."""
    h = np.uint64(len(hashes)) * np.uint64(0xA24BAED4963EE407)
    for x in hashes:
        h = mixed(np.asarray([h * np.uint64(3) + x], np.uint64))[0]
    return np.asarray([h], np.uint64)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct runs of ``size`` words of each text; a shorter text is one run of all its words, an empty one none."""
    rolled = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    multiplier = 1
    for k in range(size if len(rolled) else 0):
        multiplier = (multiplier * 0xC2B2AE3D27D4EB4F + 2) % (1 << 64)
        rolled += hashes[k:len(hashes) - size + 1 + k] * np.uint64(multiplier)
    rolled = mixed(rolled)
    out = []
    with np.errstate(over="ignore"):
        for a, b in zip(bounds[:-1], bounds[1:]):
            n = b - a
            out.append(np.unique(rolled[a:b - size + 1]) if n >= size else sequence_hash(hashes[a:b]) if n else np.empty(0, np.uint64))
    return out


def binary_array(data: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data``, of ``counts`` items each, as an array of binary values."""
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * data.dtype.itemsize, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def as_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for f in schema for x in [columns[f.name]]], schema=schema)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The stretches of equal integer keys in batches sorted by them; a long group comes in several stretches."""
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.r_[starts[1:], batch.num_rows]):
            yield tuple(int(v[a]) for v in values), batch.slice(a, b - a)


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Whole groups of sorted batches; for groups of bounded size."""
    held: list[pa.RecordBatch] = []
    current = None
    for key, part in runs(batches, keys):
        if key != current and held:
            yield current, pa.Table.from_batches(held)
            held = []
        current = key
        held.append(part)
    if held:
        yield current, pa.Table.from_batches(held)


def give_back() -> None:
    """Return memory that is free to the system: Python workers stay for later tasks, and would keep what one task needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A function over batches that gives its memory back at its end."""
    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def tidy_group(run: Callable):
    """The same for a function over the rows of a group."""
    def tidied(rows):
        out = run(rows)
        del rows
        give_back()
        return out

    return tidied


def tidy_groups(run: Callable):
    """The same for a function over the rows of two groups that belong together."""
    def tidied(left, right):
        out = run(left, right)
        del left, right
        give_back()
        return out

    return tidied


def crc_of(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; 0 for a missing id."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def exact(name: str) -> Column:
    """The column of this very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def together(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns (or those named) as one struct, so that names of further columns cannot clash with it."""
    return F.struct(*[exact(c).alias(c) for c in (df.columns if columns is None else columns)])


def apart(struct: str, columns: list[str]) -> list[Column]:
    """The columns that ``together`` put into ``struct``."""
    return [F.col(struct).getField(c).alias(c) for c in columns]


def slim(df: DataFrame) -> DataFrame:
    """Rows of a few numbers each, in a sixteenth of the usual number of partitions: they are written as few files."""
    return df.hint("rebalance").coalesce(max(1, partitions(df) // 16))


def fewer(df: DataFrame) -> DataFrame:
    """Rows with texts, in an eighth of the usual number of partitions but enough for all cores: no shuffle, and fewer files."""
    enough = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(min(partitions(df), enough), partitions(df) // 8))


def cut(df: DataFrame, few: bool = True) -> DataFrame:
    """``df`` written to the checkpoint folder and read back; as few files unless its rows are large."""
    return cut_lineage(slim(df) if few else df)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
