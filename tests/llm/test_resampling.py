"""Importance resampling against a plain calculation."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from cohortline.llm import resampling


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, longest=3):
    w = words_of(text)
    return [zlib.crc32(" ".join(w[i:i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, buckets=10_000, percent=5, least=20, seed=42):
    raw, aim = Counter(), Counter()
    for _, t in docs:
        raw.update(f % buckets for f in features_of(t))
    for t in target:
        aim.update(f % buckets for f in features_of(t))
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((raw[b] + 1) * (t_all + buckets)))) for b in raw}
    rows = []
    for d, t in docs:
        own = [f % buckets for f in features_of(t)]
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append([d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t)) >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


def collected(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_spans_are_all_runs():
    scan = resampling.scanner(3)
    for text in ("", " ", "One", "one two", "A b-c  d_9 é ÉCOLE\x00zz", "x " * 500, "--a--"):
        n, found = resampling.checksums(text.encode(), scan)
        assert n == len(words_of(text)) and sorted(found.tolist()) == sorted(features_of(text))
    n, found = resampling.checksums(b"a b c d e", resampling.scanner(1))
    assert n == 5 and len(found) == 5


def test_long_text_in_portions(monkeypatch):
    monkeypatch.setattr(resampling, "PORTION", 7)
    text = " ".join(f"w{i % 13}" for i in range(200))
    for longest in (1, 2, 3, 4):
        assert sorted(resampling.checksums(text.encode(), resampling.scanner(longest))[1].tolist()) == sorted(features_of(text, longest))


def test_odd_rows(spark, corpus, nothing):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    target = [" ".join(f"w{i * 7919 % 1013}" for i in range(50)), None, "", "one two"]
    aims = spark.createDataFrame([(t, 1) for t in target], "text string, row int")
    for percent in (5, 50, 100, 0):
        assert collected(resampling.importance_of(corpus, aims, percent=percent)) == plain(docs, target, percent=percent)
    assert collected(resampling.importance_of(corpus, aims.where("false"))) == plain(docs, [])
    assert resampling.importance_of(nothing, aims).count() == 0


def test_many_rows_and_ties(spark):
    rng = random.Random(5)
    vocabulary = [f"v{k}" for k in range(60)]
    docs = [(k % 700, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 40)))) for k in range(1000)] + [(5000, "same text " * 30)] * 400
    target = [" ".join(vocabulary[:30])] * 3
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    assert collected(resampling.importance_of(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=20, buckets=512)) == plain(docs, target, 512, 20)


def test_drawn_rows_keep_all_columns(spark):
    docs = [(k // 2, f"alpha beta {k} " * 10, k, "r", k) for k in range(100)]
    df = spark.createDataFrame(docs, "doc_id int, text string, `a.b` long, row string, rest long")
    aims = spark.createDataFrame([("alpha beta",)], "text string")
    ranks = resampling.importance_of(df, aims, percent=10).where("rank IS NOT NULL").collect()
    kept = resampling.resampled(df, aims, percent=10)
    assert kept.schema == df.schema and len(ranks) == 10
    got = kept.collect()
    assert {tuple(r) for r in got} <= set(docs) and Counter(r.doc_id for r in got) == Counter(r.doc_id for r in ranks)


def test_gains_follow_the_formula():
    raw, target = np.array([3, 0, 7, 0]), np.array([0, 2, 7, 0])
    want = [math.floor(1000 * math.log((t + 1) * (10 + 4) / ((s + 1) * (9 + 4)))) for s, t in zip(raw, target)]
    assert resampling.gains(raw, target).tolist() == want
