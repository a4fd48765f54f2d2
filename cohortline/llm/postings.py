"""Which keys of a document also belong to another one.

Keys are 64-bit hashes. A task gathers the keys of many owners, sorts them into
buckets and sends one row per bucket, so that a key costs six bytes rather than
a row. A bucket then holds all owners of its keys, and answers with a row per block
of owners; a block puts the answers of all buckets together for each owner.
Neither the rows of a step nor its bytes grow faster than the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cohortline.llm.common import tidy_group

DEALT = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("keys", pa.binary())])
DEALT_DDL = "bucket int, owners binary, counts binary, keys binary"
REPLY_DDL = "block int, owners binary, counts binary, keys binary"
OWNED = pa.schema([("owner", pa.int64()), ("n", pa.int32()), ("keys", pa.binary())])
OWNED_DDL = "owner long, n int, keys binary"
ELEMENT = np.dtype([("key", "<u8"), ("owners", "<u4")])
LOW = np.uint64((1 << 48) - 1)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(48)) * np.uint64(buckets) >> np.uint64(16)).astype(np.uint16)


def key_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and the 48 low bits: what is left of a hash once it has been dealt."""
    return (bucket_of(hashes, buckets).astype(np.uint64) << np.uint64(48)) | (hashes & LOW)


def to_six(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).view("V6").reshape(-1)


def from_six(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def slices(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of each bucket in a sorted array."""
    starts = np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]) if len(sorted_buckets) else np.empty(0, int)
    return [(int(sorted_buckets[a]), int(a), int(b)) for a, b in zip(starts, np.r_[starts[1:], len(sorted_buckets)])]


def dealt(owned: Iterable[tuple[int, np.ndarray]], buckets: int, held: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows of DEALT from owners with their distinct keys, about ``held`` keys at a time; within a portion an owner is sent once."""
    portion: dict[int, np.ndarray] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        owners = np.fromiter(portion, np.int64, len(portion))
        counts = np.fromiter(map(len, portion.values()), np.int64, len(portion))
        hashes = np.concatenate(list(portion.values()))
        whose = np.repeat(np.arange(len(owners), dtype=np.uint32), counts)
        where = bucket_of(hashes, buckets)
        order = np.argsort(where, kind="stable")
        hashes, whose, where = hashes[order], whose[order], where[order]
        rows: list[tuple] = []
        for bucket, a, b in slices(where):
            first = np.flatnonzero(np.r_[True, whose[a + 1:b] != whose[a:b - 1]])
            rows.append((bucket, owners[whose[a:b][first]].tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(),
                         to_six(hashes[a:b] & LOW).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), DEALT)], schema=DEALT)

    for owner, keys in owned:
        if len(keys) and owner not in portion:
            portion[owner] = keys
            size += len(keys)
        if size >= held:
            yield flush()
            portion, size = {}, 0
    if size:
        yield flush()


def shared_in_bucket(bucket: int, owners: list[bytes], counts: list[bytes], keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners in order, how many shared keys each has in the bucket, and these with their number of owners.

    An owner sent by several portions had the same keys in each and counts once.
    """
    who = np.concatenate([np.frombuffer(x, np.int64) for x in owners])
    many = np.concatenate([np.frombuffer(x, np.uint32) for x in counts]).astype(np.int64)
    low = np.concatenate([from_six(x) for x in keys])
    _, once = np.unique(who, return_index=True)
    if len(once) < len(who):
        kept = np.zeros(len(who), bool)
        kept[once] = True
        low, who, many = low[np.repeat(kept, many)], who[kept], many[kept]
    whose = np.repeat(np.arange(len(who), dtype=np.uint32), many)
    order = np.argsort(low, kind="stable")
    ranked = low[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    size = np.diff(np.r_[first, len(ranked)])
    degree = np.repeat(size, size)
    common = degree > 1
    order, degree = order[common], degree[common]
    element = np.empty(len(order), ELEMENT)
    element["key"] = low[order] | (np.uint64(bucket) << np.uint64(48))
    element["owners"] = np.minimum(degree, 0xFFFFFFFF)
    whose = whose[order]
    back = np.argsort(whose, kind="stable")
    owner, n = np.unique(whose[back], return_counts=True)
    return who[owner], n, element[back]


def known(owners: np.ndarray, counts: np.ndarray, elements: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of DEALT for elements that need no bucket: they pass on to the blocks of their owners."""
    rows = [(buckets + block, *blobs) for block, *blobs in _by_block(owners, counts, elements, buckets)]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), DEALT)], schema=DEALT)


def _by_block(owners: np.ndarray, counts: np.ndarray, elements: np.ndarray, blocks: int) -> list[tuple]:
    order = np.argsort(owners % blocks, kind="stable")
    begin = np.r_[0, np.cumsum(counts)]
    moved = np.repeat(begin[:-1][order] - np.r_[0, np.cumsum(counts[order])[:-1]], counts[order]) + np.arange(begin[-1])
    owners, counts, elements = owners[order], counts[order].astype(np.uint32), elements[moved]
    begin = np.r_[0, np.cumsum(counts.astype(np.int64))]
    return [(b, owners[i:j].tobytes(), counts[i:j].tobytes(), elements[begin[i]:begin[j]].tobytes()) for b, i, j in slices(owners % blocks)]


def answers(buckets: int):
    """For the rows of one bucket: which of its keys have several owners, a row per block of owners."""
    def run(pdf):
        import pandas as pd

        bucket = int(pdf.bucket.iloc[0])
        if bucket >= buckets:
            return pd.DataFrame({"block": bucket - buckets, "owners": pdf.owners, "counts": pdf["counts"], "keys": pdf["keys"]})
        owner, n, element = shared_in_bucket(bucket, list(pdf.owners), list(pdf["counts"]), list(pdf["keys"]))
        return pd.DataFrame(_by_block(owner, n, element, buckets), columns=["block", "owners", "counts", "keys"])

    return run


def gathered(pdf):
    """For the rows of one block: every owner with its elements. An element that came more than once for an owner is left once."""
    import pandas as pd

    owners = np.concatenate([np.frombuffer(x, np.int64) for x in pdf.owners])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["counts"]]).astype(np.int64)
    elements = np.concatenate([np.frombuffer(x, ELEMENT) for x in pdf["keys"]])
    whose = np.repeat(owners, counts)
    order = np.lexsort((elements["key"], whose))
    whose, elements = whose[order], elements[order]
    new = np.r_[True, (whose[1:] != whose[:-1]) | (elements["key"][1:] != elements["key"][:-1])] if len(whose) else np.empty(0, bool)
    whose, elements = whose[new], elements[new]
    owner, n = np.unique(whose, return_counts=True)
    ends = np.cumsum(n) * ELEMENT.itemsize
    raw = elements.tobytes()
    return pd.DataFrame({"owner": owner, "n": n.astype(np.int32), "keys": [raw[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)] if len(n) else []})


def shared_keys(dealt_rows: DataFrame, buckets: int) -> DataFrame:
    """``(owner, n, keys)``: for every owner its keys that others have too, with their number of owners where a bucket has counted them."""
    return (dealt_rows.groupBy("bucket").applyInPandas(tidy_group(answers(buckets)), REPLY_DDL)
            .groupBy("block").applyInPandas(tidy_group(gathered), OWNED_DDL))
