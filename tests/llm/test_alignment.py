"""Aligned tokens against all pairs of byte ranges."""

from __future__ import annotations

import hashlib
import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import alignment, queries


@pytest.fixture(scope="module")
def spellings():
    return alignment.ByteLevel(queries.vocabulary()), alignment.Pieces(queries.vocabulary("piece_bpe_32k.model"))


def ranges(ids, spelt):
    at, out = 0, []
    for i in ids:
        out.append((at, at + len(spelt[i])))
        at += len(spelt[i])
    return out


def brute(text, one, other):
    """Groups and links of one text, by comparing every A token with every B token that could meet it."""
    if not text:
        return None
    a, b = one.encode_one.whole.encode(" " + text, add_special_tokens=False).ids, other.model.encode(text)
    whole = b" " + text.encode()
    if b"".join(one.spelt[i] for i in a) != whole or b"".join(other.spelt[i] for i in b) != whole:
        return None
    ra, rb = ranges(a, one.spelt), ranges(b, other.spelt)
    cuts = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, start = [], 0
    for cut in cuts:
        groups.append(",".join(str(i) for i, r in zip(a, ra) if start < r[1] <= cut) + "|" + ",".join(str(i) for i, r in zip(b, rb) if start < r[1] <= cut))
        start = cut
    links = [(x, y) for x, p in zip(a, ra) for y, q in zip(b, rb) if p[0] < q[1] and q[0] < p[1]]
    return a, b, groups, links


def expected(rows, one, other):
    found = [(d, brute(t or "", one, other)) for d, t in rows]
    counts = Counter(pair for _, f in found if f for pair in set(f[3]))
    most = Counter()
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = []
    for d, f in found:
        if not f:
            out.append((d, 0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[0]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return Counter(out)


def result(docs):
    links = alignment.alignments(docs, queries.vocabulary(), queries.vocabulary("piece_bpe_32k.model"))
    links = links.withColumn("sha", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    from cohortline.llm import common

    counted = alignment.with_counts(common.cut(links, few=False))
    return Counter(tuple(r) for r in counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha").collect())


ODD = [(1, "Hello world, it is <|endoftext|> here"), (2, None), (3, ""), (3, ""), (4, " \t\n"), (5, "naïve façade – ½ ﬁ"), (6, "你好 " * 30), (7, "a" * 3000),
       (8, " " * 500 + "x"), (9, "<s> <unk> </s> <0x41> ▁"), (10, "Hello world, it is <|endoftext|> here"), (None, "no id at all"), (10, "repeated id"),
       (11, "🙂" * 20 + "\x00\x01"), (12, "end "), (13, "unhappiness internationalisation 1234567 ") ]


@pytest.mark.parametrize("head", [1 << 17, 3, 0])
def test_every_odd_text(spark, spellings, monkeypatch, head):
    monkeypatch.setattr(alignment, "HEAD", head)
    rng = random.Random(4)
    more = [(100 + k, " ".join("".join(rng.choice("abeinrstßé") for _ in range(rng.randint(1, 9))) for _ in range(40))) for k in range(40)]
    rows = ODD + more
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, row string, `a.b` long").repartition(4)
    assert result(docs) == expected(rows, *spellings)


def test_empty_table(spark):
    assert not result(spark.createDataFrame([], "doc_id long, text string"))


def test_walk_over_random_ends():
    rng = random.Random(1)
    for _ in range(300):
        end = rng.randint(1, 120)
        p = rng.choice([0.02, 0.3, 0.9])
        shared = {x for x in range(1, end) if rng.random() < p}
        a = sorted(shared | {x for x in range(1, end) if rng.random() < 0.1} | {end})
        b = sorted(shared | {x for x in range(1, end) if rng.random() < 0.1} | {end})
        groups, links = [], []
        for i, j, k, la, lb in alignment.stretches(a, b):
            groups += [a[x] for x in range(i, i + k)] if k else [a[la[-1]]]
            links += [(i + x, j + x) for x in range(k)] if k else list(zip(la, lb))
        assert groups == sorted(set(a) & set(b))
        starts_a, starts_b = [0, *a], [0, *b]
        assert links == [(i, j) for i in range(len(a)) for j in range(len(b)) if starts_a[i] < b[j] and starts_b[j] < a[i]]


def test_counts_of_tasks_that_hold_little(spark, spellings, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 4)
    rows = [(k, f"word{k % 3} and the other") for k in range(30)]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows, *spellings)


def test_groups_are_written_from_ids_and_ends_of_groups():
    """Tokens of random texts cut at random: the text of all groups, their number and the links, against the walk's definition."""
    rng = random.Random(7)
    spelt = [bytes(s) for n in (1, 2, 3) for s in itertools.product(b"xy", repeat=n)]
    one, other = alignment.Vocabulary(spelt, "|"), alignment.Vocabulary(spelt[::-1], ";")
    names = np.concatenate([one.name, other.name])
    for _ in range(300):
        whole = bytes(rng.choice(b"xy") for _ in range(rng.randint(1, 40)))

        def cut(words, whole=whole):
            at, ids = 0, []
            while at < len(whole):
                step = rng.randint(1, min(3, len(whole) - at))
                ids.append(words.index(whole[at:at + step]))
                at += step
            return ids

        a, b = cut(one.spelt), cut(other.spelt)
        ra, rb = ranges(a, one.spelt), ranges(b, other.spelt)
        groups, start = [], 0
        for end in sorted({e for _, e in ra} & {e for _, e in rb}):
            groups.append("|".join(",".join(str(i) for i, r in zip(ids, rs) if start < r[1] <= end) for ids, rs in ((a, ra), (b, rb))))
            start = end
        links = Counter((x << 32) | y for x, p in zip(a, ra) for y, q in zip(b, rb) if p[0] < q[1] and q[0] < p[1])
        n, text, found = alignment.aligned(a, b, one, other, names, whole)
        assert (n, text, Counter(found.tolist())) == (len(groups), ";".join(groups), links)
    assert alignment.aligned([0], [0], one, other, names, b"y") is None
