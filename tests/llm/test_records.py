"""Operators on vectors, conversations and pages against brute force and round trips."""

from __future__ import annotations

import glob
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortline.llm import chat, components, neighbours, queries, rangejoin, warc
from cohortline.runtime import cuts
from tests.check_sql import compare, duck
from tests.llm.conftest import SMALL

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")
VECTORS = "vec_id long, embedding array<float>, label int, score double, rank int"


def vectors(spark, n=400, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.standard_normal((n, dim))
    x[50:60] = x[50]
    x[70] *= 30
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 0, 0.0, 1) for i in range(n)]
    nan, inf = float("nan"), float("inf")
    odd = [(1000, None), (1020, [0.0] * dim), (1040, [nan] * dim), (1060, [inf] + [0.0] * (dim - 1)), (1080, []), (1100, [1.0, None] * (dim // 2)),
           (1120, [1.0, 2.0]), (None, rows[0][1]), (60, rows[3][1])]
    return rows, spark.createDataFrame(rows + [(i, v, 1, 1.0, 2) for i, v in odd], VECTORS)


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LIST", 64)
    monkeypatch.setattr(neighbours, "SPLIT", 16)
    rows, df = vectors(spark)
    got = neighbours.nearest(df, aim=1.0).collect()
    x = np.array([r[1] for r in rows] + [rows[3][1]], dtype=np.float32).astype(float)
    ids = np.array([r[0] for r in rows] + [60])
    hits = total = 0
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_id, []).append(r)
    assert set(by_query) == {i for i in range(400) if i % 20 == 0}
    for q, own in by_query.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21)) and len({r.vec_id for r in own}) == 20 and q not in {r.vec_id for r in own}
        assert all((a.score, -a.vec_id) > (b.score, -b.vec_id) for a, b in zip(own, own[1:]))
        score = {}
        for a in np.flatnonzero(ids == q):
            for b in np.flatnonzero(ids != q):
                score[ids[b]] = max(score.get(ids[b], -np.inf), float(x[a] @ x[b]))
        best = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert all(r.score == pytest.approx(score[r.vec_id], rel=1e-12) or r.score <= score[r.vec_id] for r in own)
        hits += len({r.vec_id for r in own} & set(best))
        total += 20
    assert hits / total >= 0.95
    assert neighbours.nearest(df.where("false")).count() == 0
    few = neighbours.nearest(df.where("vec_id IN (0, 1, 2, 1000)")).collect()
    assert [(r.query_id, r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (0, 2)]


def test_neighbours_of_every_length(spark):
    rng = np.random.default_rng(2)
    x = {i: rng.standard_normal(6 if i < 20 else 4) for i in range(50)}
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in x.items()], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, k=3, every=10, aim=1.0).collect()
    for q in range(0, 50, 10):
        best = sorted((i for i in x if i != q and len(x[i]) == len(x[q])), key=lambda i: -(x[q] @ x[i]))[:3]
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == best


@needs_tables
def test_recall_on_the_table(spark):
    got = queries.op5_adaptive_scan_neighbours(spark, SMALL).toPandas()
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), np.array([r.vec_id for r in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        score = x @ x[ids == q][0]
        best = [i for i in ids[np.lexsort((ids, -score))] if i != q][:20]
        hits += len(set(best) & set(got[got.query_id == q].vec_id))
        total += 20
    assert hits / total >= 0.9


def brute_links(rows, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    close = x @ x.T >= least
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in zip(*np.nonzero(close)):
        u, v = top(ids[a]), top(ids[b])
        up[max(u, v)] = min(u, v)
    return sorted((ids[k], int(close[k].sum()) - 1, top(ids[k]), top(ids[k]) == ids[k]) for k in range(len(ids)))


def test_range_join_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL", 40)
    monkeypatch.setattr(rangejoin, "SPLIT", 16)
    rows, df = vectors(spark, dim=6)
    got = rangejoin.near_duplicates(df).collect()
    assert len(got) == df.count()
    usable = [(r[0], r[1]) for r in rows] + [(60, rows[3][1])]
    odd = {1000, 1020, 1040, 1060, 1080, 1100, 1120, None}
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got if r.vec_id not in odd) == brute_links(usable)
    assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id in odd)
    assert rangejoin.near_duplicates(df.where("false")).count() == 0


def test_range_join_of_vectors_that_differ_in_the_last_bit(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL", 8)
    rng = np.random.default_rng(4)
    base = rng.normal(size=6)
    near = base * (1 + rng.integers(-3, 4, (120, 6)) * 2.0 ** -52) * rng.uniform(0.5, 2, (120, 1))
    turned = [base / np.linalg.norm(base) + rng.normal(size=6) * 0.18 for _ in range(80)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate([*near, *turned])]
    got = rangejoin.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute_links(rows)


def test_range_join_copies_no_vector_to_the_cells_it_meets(spark, monkeypatch):
    monkeypatch.setattr(rangejoin, "CELL", 20)
    monkeypatch.setattr(rangejoin, "PASS_BYTES", 8 * 6 * 130, raising=False)
    before = set(glob.glob(f"{cuts(spark)}/*"))
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x[100:140] = x[100] + rng.normal(size=(40, 6)) * 0.01  # many close ones, in several passes
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(600 + i, [float(v) for v in x[7 * i]]) for i in range(9)]
    short = [(700 + i, [1.0, 0.1 * (i % 3)]) for i in range(6)]
    got = rangejoin.near_duplicates(spark.createDataFrame(rows + short, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == sorted(brute_links(rows) + brute_links(short))
    written = [spark.read.parquet(p) for p in set(glob.glob(f"{cuts(spark)}/*")) - before]
    assert sum(df.count() for df in written if "vec" in df.columns) == 500 + 3


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(50)] + [(7, 7), (None, 3)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up}
    assert components.connected(spark.createDataFrame([], "u long, v long")).count() == 0


# chat

HARD = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\n", "a\nb", "<\\|", "\\<|", "<|", "|>", "", None, "\n", "<|im_start|>user\nx<|im_end|>\n", "é😀<|x|>", "\\n\\|"]


def test_conversations_come_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv if conv else None, turn if rng.random() < 0.9 else None, rng.choice(["user", "assistant", "assistant", "system", None, "a\nb", "\\n<|"]),
                         rng.choice(HARD) if rng.random() < 0.7 else "plain", 5, "x"))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss_start int, formatted string")
    examples = chat.expand(df)
    by_conv = {}
    for c, t, r, x, _, _ in rows:
        by_conv.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    back = {r.conv_id: r for r in chat.read_back(examples).collect()}
    assert set(back) == set(by_conv)
    for c, turns in by_conv.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, _, r, x in turns]
        assert back[c].loss == "".join(x for _, _, r, x in turns if r == "assistant")
    for e in examples.collect():
        turns = by_conv[e.conv_id]
        replies = [k for k, t in enumerate(turns) if t[2] == "assistant"]
        assert e.formatted.count("<|im_start|>") == (replies[e.example] + 1 if e.example < len(replies) else len(turns))
        assert (e.loss_start is None) == (e.example >= len(replies))
        if e.loss_start is not None:
            assert e.formatted[:e.loss_start].endswith("assistant\n") and e.formatted[e.loss_start + e.loss_length:] == "<|im_end|>\n"
    assert chat.expand(df.where("false")).count() == 0 and chat.read_back(examples.where("false")).count() == 0


def test_chat_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.read_back(chat.expand(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# archives

def pages(spark):
    big, other = "<p>" + "x" * 1200, "ä" * 600
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (3, "http://again", big), (4, "http://b\r\nWARC-Type: evil", other), (5, "http://c d/é", other),
            (6, "u", "small"), (7, "u", "small"), (8, "u", None), (9, "u", ""), (None, "u", big), (None, None, None), (10, "u", "WARC/1.1\r\n\r\n" * 100)]
    return rows, spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, digest string, offset int")


def test_archive_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    index = warc.write_archive(df, str(tmp_path / "w"), file_bytes=600)
    entries = index.collect()
    assert len(entries) == len(rows) and len({e.file for e in entries}) > 1
    for e in entries:  # each range is one gzip member that holds one record
        with open(tmp_path / "w" / e.file, "rb") as f:
            f.seek(e.offset)
            fields, _ = warc.parsed(gzip.decompress(f.read(e.length)))
        assert fields["WARC-Payload-Digest"] == f"sha1:{e.payload_digest}" and fields["WARC-Type"] == e.record_type
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.digest, None if r.payload is None else bytes(r.payload)) for r in warc.read_records(index, str(tmp_path / "w")).collect()), key=str)
    want = []
    for i, _, html in rows:
        payload = (html or "").encode()
        last = max((j for j, _, h in rows if h == html and j is not None), default=None)
        revisit = len(payload) >= 1000 and i is not None and i < last
        want.append((i, "revisit" if revisit else "response", last if revisit else None, hashlib.sha1(payload).hexdigest(), None if revisit else payload))
    assert got == sorted(want, key=str)
    some = warc.read_records(index.where("page_id IN (4, 10)"), str(tmp_path / "w")).collect()
    assert {r.page_id for r in some} == {4, 10}
    nothing = warc.write_archive(df.where("false"), str(tmp_path / "e"))
    assert nothing.count() == 0 and warc.read_records(nothing, str(tmp_path / "e")).count() == 0


def test_ranges_cover_the_records():
    rng = np.random.default_rng(3)
    for _ in range(100):
        lengths = rng.integers(1, 50, 40)
        offsets = np.cumsum(lengths + rng.integers(0, 30, 40))
        seen = []
        for a, b, at, n in warc.coalesced(offsets, lengths, 200, 10):
            assert offsets[a] == at and offsets[b - 1] + lengths[b - 1] == at + n and (n <= 200 or b == a + 1)
            seen += range(a, b)
        assert seen == list(range(40))
    assert warc.coalesced(np.empty(0, int), np.empty(0, int)) == []


# registered queries

@needs_tables
def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.common.cut(stage(spark, docs, SMALL))
        assert out.columns == docs.columns and out.count() > 0, name
        docs = out
    assert stage is corpus_pipeline.source_mixing
    pieces = corpus_pipeline.cost_balanced_packing(spark, docs, SMALL)
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@needs_tables
@pytest.mark.parametrize("name", list(queries.llm_queries()))
def test_every_query_returns_its_rows(spark, name):
    df = queries.llm_queries()[name](spark, SMALL)
    assert len(set(df.columns)) == len(df.columns)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name in queries.llm_sql():
        said = duck(SMALL).execute(queries.llm_sql()[name])
        assert compare(df.columns, rows, [d[0] for d in said.description], said.fetchall()) == ""
