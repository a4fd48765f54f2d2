from __future__ import annotations

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every odd case: nulls, empty and long texts, ties, repeated rows, clashing further columns."""
    words = [f"w{i * 7919 % 1013}" for i in range(3000)]
    passage = " ".join(f"p{i}" for i in range(60))
    base = " ".join(words[:400])
    rows = [
        (1, base, "a"), (2, base, "a"), (3, base.upper(), "a"), (4, " ".join(words[:380] + ["x"] * 20), "b"),
        (5, None, None), (6, "", "b"), (7, " \t\n", "b"), (8, "one two", "a"), (9, "One  TWO", "c"), (10, "one", None),
        (11, passage + " " + " ".join(words[500:800]), "b"), (12, " ".join(words[900:1200]) + " " + passage, "c"),
        (13, " ".join(words), "a"), (14, " ".join(words[::-1] * 20), "c"), (15, "é" * 300, "d"), (16, "ß" + "é" * 299, "d"),
        (17, "<|endoftext|> and <|im_end|>", "d"), (18, "a " * 2000, "d"), (19, "a " * 2000, "d"), (19, "a " * 2000, "d"), (19, "other " * 30, "d"),
        (None, base, "a"), (None, None, None), (20, "你好 " * 40, "ä"), (-3, base + " end", "a"),
    ]
    data = [(d, t, s, len(t or ""), 1.0, d or 0, "k") for d, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long, score double, size long, text_key string")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.where("false")
