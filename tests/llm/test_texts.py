"""Operators on texts against brute force."""

from __future__ import annotations

import contextlib
import hashlib
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortline.llm import common, jaccard, lm, mixing, packing, quality, queries, suffix
from tests.llm.conftest import SMALL

needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="driver tables not present")


def rows_of(df):
    return [(r.doc_id, r.text or "", r.source) for r in df.collect()]


def words_of(text):
    return (text or "").encode().lower().split()


# packing

def check_pieces(rows, pieces, encode, capacity=1024):
    expected = Counter((d, np.asarray([*encode(t), 0], "<u4").tobytes()) for d, t, _ in rows)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
        assert len(p.tokens) == 4 * p.length and p.length > 0
    for key, own in by_doc.items():  # repeated rows: each start as often as there are rows
        starts = Counter((p.start, p.length) for p in own)
        copies = sum(n for (d, ids), n in expected.items() if (d, len(ids) // 4) == key)
        assert sum(p.length for p in own) == copies * key[1] and starts
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]]
        assert sum(p.length for p in own) <= capacity
    assert sum(len(ids) // 4 * n for (_, ids), n in expected.items()) == sum(p.length for p in pieces)
    return by_doc


def test_packing_of_odd_rows(corpus, nothing):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(queries.vocabulary())
    pieces = packing.pack(corpus, queries.vocabulary(), capacity=64).collect()
    by_doc = check_pieces(rows_of(corpus), pieces, lambda t: whole.encode(t, add_special_tokens=False).ids, 64)
    for d, t, _ in rows_of(corpus):
        if d in (1, 13, 15, 17, 20):  # ids that occur once
            ids = np.asarray([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()
            own = sorted(by_doc[d, len(ids) // 4], key=lambda p: p.start)
            assert b"".join(p.tokens for p in own) == ids
    padding = 64 * len({p.sequence_id for p in pieces}) - sum(p.length for p in pieces)
    assert padding < 64 * 8  # less than a sequence for each task's block
    assert packing.pack(nothing, queries.vocabulary()).count() == 0


def test_quick_ids_are_those_of_the_library():
    encode = packing.Encoder(queries.vocabulary())
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250)]
    for _ in range(400):
        text = "".join(rng.choice(letters) * rng.choice([1, 1, 1, 2, 5]) + rng.choice(["", " ", "a", "'s", "9"]) for _ in range(60))
        assert encode(text) == encode.whole.encode(text, add_special_tokens=False).ids


def test_long_white_space_goes_to_the_library():
    encode = packing.Encoder(queries.vocabulary())
    for gap in (" " * 1_200_000, "\n" * packing.LONG_SPACE, " \t" * packing.LONG_SPACE):
        text = "before" + gap + "after"
        assert not encode.quickly(text)
        assert encode(text) == encode.whole.encode(text, add_special_tokens=False).ids
    assert encode.quickly("a b" * packing.LONG_SPACE)


def test_other_vocabularies_go_to_the_library():
    encode = packing.Encoder(queries.vocabulary("word_bpe_49k.json"))
    assert encode.quick is None and encode("Hello  World") == encode.whole.encode("Hello  World", add_special_tokens=False).ids


def test_balanced_sequences():
    rng = np.random.default_rng(0)
    for _ in range(50):
        lengths = rng.integers(1, 101, rng.integers(1, 60))
        sequences = packing.balanced(lengths, 100)
        assert len(sequences) == -(-int(lengths.sum()) // 100)
        held = sorted((d, a, n) for s in sequences for d, a, n in s)
        for d, n in enumerate(lengths):
            own = [(a, m) for e, a, m in held if e == d]
            assert own[0][0] == 0 and sum(m for _, m in own) == n and all(a + m == b for (a, m), (b, _) in zip(own, own[1:]))
        assert all(sum(n for _, _, n in s) <= 100 for s in sequences)
    # the documents of like length go to the cheapest sequence
    assert sorted(len(s) for s in packing.balanced(np.full(8, 50), 100)) == [2, 2, 2, 2]


# language model

def brute_scores(rows, learn):
    tokens = [(d, [*words_of(t), None]) for d, t, _ in rows]
    counts = Counter(w for d, t in tokens if learn(d) for w in t)
    n, v = sum(counts.values()), len(counts)
    return [(d, len(t), sum(w in counts for w in t), n, sum(math.log10((counts.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for d, t in tokens]


def test_base_scores_of_odd_rows(corpus, nothing, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 8)  # so that most counts come from the tail
    got = lm.score(corpus, common.crc_of("doc_id", 5) != 1).collect()
    want = brute_scores(rows_of(corpus), lambda d: d is None or zlib.crc32(str(d).encode()) % 5 != 1)
    key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert lm.score(nothing).count() == 0
    untaught = lm.score(corpus, F.lit(False)).collect()
    assert len(untaught) == corpus.count() and all(r.base_score == 0 and r.score == 0 and r.train_tokens == 0 for r in untaught)


def test_filter_gives_levels_back():
    rng = np.random.default_rng(1)
    keys = np.unique(common.mixed(rng.integers(0, 1 << 62, 4000).astype(np.uint64)))
    counts = rng.zipf(1.6, len(keys)).clip(1, 10 ** 6)
    bits = 1 << 19
    bloom = lm.Filter(np.stack([lm.built(keys, counts, bits)] * 1))
    of = lm.Filter(np.stack([lm.built(lm.postings.key_of(keys, 1), counts, bits)])).level(keys)
    want = lm.levels(counts)
    assert (of >= want).all() and (of != want).mean() < 0.02  # chance errors only ever add
    other = common.mixed(rng.integers(0, 1 << 62, 20000).astype(np.uint64))
    assert (lm.Filter(np.stack([lm.built(lm.postings.key_of(keys, 1), counts, bits)])).level(other) > 0).mean() < 0.02
    assert bloom.bits == bits


def test_no_ngram_is_left_out_of_a_full_filter(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * 100 + j}" for j in range(100)) + " the end of it") for i in range(40)], "doc_id long, text string")
    score = lambda: {r.doc_id: (r.score, r.n_known) for r in lm.score(docs).collect()}
    want = score()
    monkeypatch.setattr(lm, "FILTER_BITS", 1 << 12)  # less than the n-grams need
    got = score()
    assert all(got[i][0] == pytest.approx(want[i][0], rel=0.02) and got[i][1] == want[i][1] == 105 for i in want)
    for size in (1, 1 << 12):
        monkeypatch.setattr(lm, "PASS_BYTES", size)
        assert score() == got


@needs_tables
def test_model_beats_the_base_on_held_out_texts(spark):
    got = queries.op2_log_frequency_bloom(spark, SMALL).toPandas()
    assert (got.held_out.sum() > 10) and got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_probabilities_after_a_word_add_up_to_one_at_most(spark):
    text = "a b a c a b d a b . " * 40
    docs = spark.createDataFrame([(0, text)] + [(i, w) for i, w in enumerate("a b c d .".split(), 1)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, F.col("doc_id") == 0).collect()}
    assert 0 < sum(10 ** got[i] for i in range(1, 6)) <= 1.0


# mixing

def test_mixing_of_odd_rows(corpus, nothing):
    got = mixing.mix(corpus).collect()
    rows = rows_of(corpus)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got) == sorted((d is not None, d or 0, len(words_of(t))) for d, t, _ in rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words_of(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * size[s] + 1e-9]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    taken = Counter()
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in order)
    again = sorted(map(tuple, mixing.mix(corpus).select("doc_id", "size", "taken").collect()), key=str)
    assert again == sorted(((r.doc_id, r.size, r.taken) for r in got), key=str)
    assert mixing.mix(nothing).count() == 0


def test_keys_prefer_good_documents_and_fill_the_budget_in_order(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"))
    good = F.when(F.col("doc_id") % 2 == 0, 9.0).otherwise(1.0)
    got = mixing.mix(docs, weight=good, share=0.3).toPandas()
    assert got.taken.sum() == 6000 and ((got.taken > 0) & (got.taken < 5)).sum() <= 1
    share = got[got.taken > 0].doc_id.mod(2).eq(0).mean()
    assert share > 0.8


def test_mixed_rows_that_repeat(spark):
    text = "one two\nthree four  five\tsix seven eight nine ten"
    rows = [(7, text, "a", 1.0, k) for k in range(90)] + [(k, f"{text} {k}", "b", 1.0, k) for k in range(100, 160)] + [(None, text, None, 0.0, 0), (7, text + " x", "a", 1.0, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` double, mix_words long").repartition(5)
    got, plan = mixing.mixed_documents(docs), mixing.mix(docs)
    assert got.schema == docs.schema
    taken = {r.source: r.n for r in plan.groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.word_count("text")).alias("n")).collect()} == taken
    assert all(text.startswith(r.text) or r.text.startswith(text) for r in got.collect())  # cut where a word ends, white space as it is
    assert got.groupBy("source", "mix_words").agg(F.sum(mixing.word_count("text")).alias("n")).where("n > 42").count() == 0  # no row more than twice


def test_mixed_rows(corpus):
    got = mixing.mixed_documents(corpus)
    plan = mixing.mix(corpus)
    assert got.columns == corpus.columns
    assert got.agg(F.sum(mixing.word_count("text"))).first()[0] == plan.agg(F.sum("taken")).first()[0]
    assert got.where("text IS NOT NULL AND n_chars <> length(text)").count() == 0


# near duplicates

def brute_classes(rows, size=5, threshold=75):
    sets = []
    for d, t, _ in rows:
        w = words_of(t)
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    sets = list(map(frozenset, sets))
    distinct = list(dict.fromkeys(s for s in sets if s))
    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct[:i]):
            common_ = len(a & b)
            if 100 * common_ >= threshold * (len(a) + len(b) - common_):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    number = {s: top(i) for i, s in enumerate(distinct)}
    least = {}
    for (d, _, _), s in zip(rows, sets):
        if s and d is not None:
            least[number[s]] = min(d, least.get(number[s], d))
    return sorted(((d, len(s), least.get(number[s]) if s else d) for (d, _, _), s in zip(rows, sets)), key=str)


def classes_of(docs):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()), key=str)


def test_repeated_and_missing_ids(spark):
    near = lambda name, k=0: " ".join(f"{name}{i}" for i in range(60 - k))
    cases = [
        [(1, near("a")), (5, near("a")), (5, near("b"))],  # the clean text with the id of a copy stays
        [(3, near("p")), (3, near("q")), (8, near("p", 2)), (9, near("q", 2))],  # one id, two classes
        [(None, near("a", 1)), (4, near("a")), (7, near("a", 3)), (None, near("z")), (None, near("z"))],  # links without ids
        [(2, near("a")), (2, near("a")), (2, near("a", 1)), (None, ""), (None, ""), (6, None)],
    ]
    left = [[(1, "a"), (5, "b")], [(3, "p"), (3, "q")], [(4, "a"), (None, "z")], [(2, "a"), (None, ""), (None, ""), (6, "")]]
    for rows, want in zip(cases, left):
        docs = spark.createDataFrame([(d, t, "s", 1, "c") for d, t in rows], "doc_id long, text string, source string, `a.b` int, class string")
        assert classes_of(docs) == brute_classes([(d, t, "s") for d, t in rows])
        kept = jaccard.without_duplicates(docs)
        assert kept.schema == docs.schema
        assert sorted(((r.doc_id, (r.text or "")[:1]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_jaccard_classes_of_odd_rows(corpus, nothing):
    assert classes_of(corpus) == brute_classes(rows_of(corpus))
    assert jaccard.jaccard_components(nothing).count() == 0
    kept = jaccard.without_duplicates(corpus)
    assert kept.columns == corpus.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and -3 in ids and 5 in ids and ids.count(None) == 1  # the copy without id goes, the empty text stays


def test_jaccard_classes_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3000)  # so that a cluster is cut into several row blocks
    monkeypatch.setattr(jaccard, "SEEN", 8)
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            w[rng.randrange(80)] = f"n{rng.randrange(10 ** 6)}"
        rows.append((rng.randrange(10 ** 9), " ".join(w), "s"))
    rows += [(10 ** 9 + i, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(50)) + " " + " ".join(base[:20]), "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    assert classes_of(docs) == brute_classes(rows)


def test_jaccard_moves_grams_seldom(spark, corpus, monkeypatch):
    """The n-grams of rows are shuffled to buckets, to their owners, by row and to products; neither for sizes nor for numbers of blocks."""
    moved = []

    def seen(f):
        def run(df, *rest, **named):
            with contextlib.redirect_stdout(io.StringIO()) as said:
                df.explain("formatted")
            moved.append(len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*\bkeys#", said.getvalue())))
            return f(df, *rest, **named)

        return run

    monkeypatch.setattr(jaccard, "connected", seen(jaccard.connected))
    monkeypatch.setattr(common, "cut", seen(common.cut))
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert classes_of(corpus) == brute_classes(rows_of(corpus))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sum(moved) == 4 and max(moved) == 2


# repeated strings

def brute_removal(rows, match=50):
    out = []
    data = [((1 << 63) - 1 if d is None else d, t.encode()) for d, t, _ in rows]
    first = {}
    for d, b in data:
        for i in range(len(b) - match + 1):
            w = b[i:i + match]
            first[w] = min(d, first.get(w, d))
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if first[b[i:i + match]] < d:
                gone[i:i + match] = b"\1" * match
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        out.append((None if d == (1 << 63) - 1 else d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def removal(docs, **how):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix.remove_repeats(docs, **how).collect()), key=str)


def test_removal_from_odd_rows(corpus, nothing):
    some = corpus.where("doc_id IS NULL OR doc_id <> 14")
    assert removal(some) == brute_removal(rows_of(some))
    assert suffix.remove_repeats(nothing).count() == 0
    left = suffix.without_repeats(corpus)
    assert left.columns == corpus.columns and left.count() == corpus.count()
    assert left.where("n_chars <> length(text)").count() == 0


def test_removal_from_a_long_run_of_equal_bytes(spark, monkeypatch):
    rows = [(1, "b" * 60, "s"), (2, "a" * 200_000, "s"), (3, "x" * 10 + "a" * 300 + "y", "s")]
    docs = spark.createDataFrame([(d, t, s, 1) for d, t, s in rows], "doc_id long, text string, source string, `a.b` int")
    got = {r[0]: r[1:4] for r in removal(docs)}
    assert got == {1: (60, 0, 0), 2: (200_000, 0, 0), 3: (311, 300, 1)}
    assert suffix.without_repeats(docs).schema == docs.schema


def test_removal_with_short_windows(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(10 ** 6), "".join(rng.choice("ab\0") for _ in range(rng.randrange(40))), "s") for _ in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert removal(docs, match=9, gram=4) == brute_removal(rows, 9)


def test_columnwise_windows():
    rng = np.random.default_rng(2)
    for _ in range(30):
        reads = rng.integers(0, 2, (40, 12)).astype(np.uint8)
        docs = rng.integers(0, 20, 40)
        first, last = rng.integers(0, 3, 40), rng.integers(9, 13, 40)
        got = suffix.repeated_windows(reads, docs, first, last, 5)
        for i in range(40):
            for c in range(8):
                valid = lambda k: first[k] <= c and c + 5 <= last[k]  # noqa: B023, E731
                want = valid(i) and any(valid(j) and docs[j] < docs[i] and (reads[j, c:c + 5] == reads[i, c:c + 5]).all() for j in range(40))
                assert got[i, c] == want


# quality

def test_statistics_are_defined_for_odd_texts():
    for text in (b"", b" ", b"\0", "é".encode(), b"a" * 100_000, b"\n\n", b"...!!!", b"x" * 3 + b" y\n" * 5):
        assert np.isfinite(quality.statistics(text)).all() and len(quality.statistics(text)) == len(quality.NAMES)


def test_discriminant_is_the_density_ratio():
    rng = np.random.default_rng(4)
    x = [rng.multivariate_normal([0, 0, 0], np.diag([1, 2, 3]), 4000), rng.multivariate_normal([1, 1, 0], [[1, .5, 0], [.5, 1, 0], [0, 0, .5]], 6000)]
    moments = [(len(a), a.sum(0), a.T @ a) for a in x]
    model = quality.fit(*(np.array(m, float) for m in zip(*moments)), pooled=0.0, diagonal=0.0)

    def log_density(z, a):
        cov, d = np.cov(a.T), z - a.mean(0)
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log(len(a))

    z = np.concatenate(x)
    want = 1 / (1 + np.exp(log_density(z, x[0]) - log_density(z, x[1])))
    assert np.abs(model.score(z) - want).max() < 0.02


def test_quality_of_odd_rows(corpus, nothing):
    labels = corpus.sparkSession.createDataFrame([(1, 1), (1, 1), (13, 1), (14, 1), (18, 0), (19, 0), (7, None), (None, 0), (99, 1), (6, 5)], "doc_id long, quality int")
    got = quality.quality_scores(corpus, labels).collect()
    assert len(got) == corpus.count() and all(0 <= r.score <= 1 for r in got)
    kept = quality.kept_by_quality(corpus, labels)
    assert kept.columns == corpus.columns and 0 < kept.count() < corpus.count()
    assert quality.quality_scores(nothing, labels).count() == 0
    assert {r.score for r in quality.quality_scores(corpus, labels.where("false")).collect()} == {0.5}


@needs_tables
def test_held_out_accuracy(spark):
    big = SMALL.replace("0.001", "0.01")
    got = queries.op9_quadratic_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(got) > 80 and (got.predicted == got.quality).mean() > 0.95
