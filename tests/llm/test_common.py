"""The helpers that several operators rest on."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from cohortline.llm import common, postings


def test_words_are_those_of_the_contract():
    rng = random.Random(1)
    signs = ["a", "B", "é", "É", "\x00", " ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1f", " ", " ", "Z"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))).encode() for _ in range(300)] + [b"", b" ", b"word" * 1000]
    hashes, bounds = common.words(texts)
    known: dict[bytes, int] = {}
    back: dict[int, bytes] = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        want = text.lower().split()
        got = hashes[a:b].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert known.setdefault(w, h) == h and back.setdefault(h, w) == w


def test_shingles_are_sets_of_runs():
    texts = [b"a b c d e f", b"A  b\tc d e", b"a b c d e a b c d e", b"a b", b"b a", b"", b"a b c d"]
    sets = [set(s.tolist()) for s in common.shingles(*common.words(texts), 5)]
    assert [len(s) for s in sets] == [2, 1, 5, 1, 1, 0, 1]
    assert sets[1] < sets[0] and sets[1] < sets[2] and sets[3] != sets[4] and not sets[6] & sets[0]


def test_chunks_hold_all_rows_in_order():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "x" * rng.randrange(50) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(common.chunks([batch.slice(0, 120), batch.slice(120)], "text", limit=100))
    assert [i for part, _ in parts for i in part.column(0).to_pylist()] == list(range(200))
    assert [t for _, some in parts for t in some] == [(t or "").encode() for t in texts]
    assert all(len(some) == 1 or sum(map(len, some)) <= 100 for _, some in parts)


def test_shared_keys_of_a_bucket():
    rng = np.random.default_rng(3)
    buckets = 7
    keys = common.mixed(np.arange(1, 400, dtype=np.uint64))
    owned = {int(o): np.unique(rng.choice(keys, rng.integers(1, 40))) for o in rng.integers(-10 ** 12, 10 ** 12, 60)}
    rows = [r for part in (list(owned.items())[:35], list(owned.items())[25:]) for b in postings.dealt(iter(part), buckets, held=200)
            for r in b.to_pylist()]  # ten owners are sent twice
    degree: dict[int, int] = {}
    for own in owned.values():
        for k in own.tolist():
            degree[k] = degree.get(k, 0) + 1
    name = dict(zip(postings.key_of(keys, buckets).tolist(), keys.tolist()))
    got: dict[int, dict[int, int]] = {}
    for bucket in range(buckets):
        own = [r for r in rows if r["bucket"] == bucket]
        owners, counts, elements = postings.shared_in_bucket(bucket, *([r[c] for r in own] for c in ("owners", "counts", "keys")))
        at = 0
        for o, n in zip(owners.tolist(), counts.tolist()):
            got.setdefault(o, {}).update({name[int(e["key"])]: int(e["owners"]) for e in elements[at:at + n]})
            at += n
    assert got == {o: w for o, own in owned.items() if (w := {k: degree[k] for k in own.tolist() if degree[k] > 1})}


def test_squeezed_bytes_come_back():
    for data in (b"", b"x", bytes(range(256)) * 50):
        assert common.unsqueezed(common.squeezed(data)) == data
