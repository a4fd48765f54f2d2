"""A classifier of text quality.

Method: regularised quadratic discriminant. Statistics of a text are transformed
towards bell shapes; each class has its own mean and a covariance shrunk towards
the pooled one and its diagonal; the score compares the log densities of
the two classes, whose Mahalanobis distances come from Cholesky factors that are
computed once. Means and covariances are sums over all labelled rows: each task
adds up its own, and only these sums leave it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common

NAMES = ("bytes", "words", "word_length", "word_spread", "lines", "line_repeats", "letters", "capitals", "digits", "signs", "odd_signs", "spaces",
         "wide", "vowels", "distinct_words", "repeats_next", "top_word", "entropy", "ends", "squeezed", "longest_word", "run_length")
KINDS = np.zeros((256, 8), np.float64)
for _b in range(256):
    _c = chr(_b)
    KINDS[_b] = (_b < 128 and _c.isalpha(), 65 <= _b <= 90, _b < 128 and _c.isdigit(), _b < 128 and not _c.isalnum() and not _c.isspace(),
                 _c in "#$%&*|<>{}[]\\^~=_@+/", _c in " \t\n\r\x0b\x0c", _b >= 128, _c in "aeiouAEIOU")


def statistics(text: bytes) -> np.ndarray:
    """The transformed statistics of one text; all defined for an empty one."""
    n = len(text)
    if not n:
        return np.zeros(len(NAMES))
    b = np.frombuffer(text, np.uint8)
    counts = np.bincount(b, minlength=256)
    letters, capitals, digits, signs, odd, spaces, wide, vowels = counts @ KINDS / n
    word = text.lower().split()
    sizes = np.fromiter(map(len, word), np.float64, len(word)) if word else np.zeros(1)
    seen: dict[bytes, int] = {}
    for w in word:
        seen[w] = seen.get(w, 0) + 1
    m = max(1, len(word))
    again = sum(x == y for x, y in zip(word, word[1:])) / m
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = counts[counts > 0] / n
    starts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])

    def logit(p: float) -> float:
        p = min(max(p, 0.0), 1.0)
        return float(np.log((p + 0.002) / (1.002 - p)))

    return np.array([
        np.log1p(n), np.log1p(len(word)), np.log1p(sizes.mean()), np.log1p(sizes.std()), np.log1p(len(lines)),
        logit(1 - len(set(lines)) / max(1, len(lines))), logit(letters), logit(capitals), logit(digits), logit(signs), logit(odd), logit(spaces), logit(wide),
        logit(vowels), logit(len(seen) / m), logit(again), logit(max(seen.values(), default=0) / m), -(share * np.log(share)).sum(),
        logit(sum(text.count(x) for x in (b".", b"!", b"?")) / m if word else 0.0) if word else 0.0,
        np.log(len(zlib.compress(text, 1)) / n), np.log1p(sizes.max()), np.log1p(np.diff(np.r_[starts, n]).max())])


@dataclass
class Discriminant:
    """Two classes, 0 and 1; ``factor`` are the inverses of the Cholesky factors, ``offset`` log prior less half the log determinant."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of statistics."""
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        log_density = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets)]
        return 1 / (1 + np.exp(np.clip(log_density[0] - log_density[1], -700, 700)))


def fit(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, pooled: float = 0.2, diagonal: float = 0.05) -> Discriminant:
    """From each class's count, sums and sums of products. A class without rows has the pooled moments and a prior of half a row."""
    d = sums.shape[1]
    total = max(float(n.sum()), 1.0)
    centre = sums.sum(0) / total
    whole = squares.sum(0) / total - np.outer(centre, centre)
    scale = np.sqrt(np.maximum(np.diag(whole), 1e-6))
    whole = whole / np.outer(scale, scale) + 1e-6 * np.eye(d)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        mean = sums[k] / n[k] if n[k] else centre
        own = (squares[k] / n[k] - np.outer(mean, mean)) / np.outer(scale, scale) if n[k] > 1 else whole
        trust = n[k] / (n[k] + d)  # few rows lean on the pooled covariance
        keep = (1 - pooled) * trust
        mixture = keep * own + (1 - keep) * whole
        mixture = (1 - diagonal) * mixture + diagonal * np.diag(np.diag(mixture)) + 1e-3 * np.eye(d)
        chol = np.linalg.cholesky(mixture)
        means.append((mean - centre) / scale)
        factors.append(np.linalg.inv(chol))
        offsets.append(np.log((n[k] + 0.5) / (total + 1)) - np.log(np.diag(chol)).sum())
    return Discriminant(centre, scale, np.array(means), np.array(factors), np.array(offsets))


def _statistics(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("stats", pa.binary())])
    for part, texts in common.chunks(batches, "text"):
        yield common.as_batch(schema, doc_id=part.column(0), stats=[statistics(t).tobytes() for t in texts])


def _moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES)
    n, sums, squares = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, d)
        y = batch.column(1).to_numpy()
        for k in (0, 1):
            own = x[y == k]
            n[k] += len(own)
            sums[k] += own.sum(0)
            squares[k] += own.T @ own
    flat = np.concatenate([n, sums.ravel(), squares.ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "total"])


def train(stats: DataFrame, labels: DataFrame, pooled: float = 0.2, diagonal: float = 0.05) -> Discriminant:
    """The classifier of ``stats(doc_id, stats)`` and ``labels(doc_id, label)``; labels other than 0 and 1 and null ids are not used, a repeated label counts again."""
    said = labels.where("label IN (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    rows = stats.join(said, "doc_id").select("stats", "label").mapInArrow(_moments, "at int, total double").groupBy("at").agg(F.sum("total")).collect()
    d = len(NAMES)
    flat = np.zeros(2 + 2 * d + 2 * d * d)
    for at, total in rows:
        flat[at] = total
    return fit(flat[:2], flat[2:2 + 2 * d].reshape(2, d), flat[2 + 2 * d:].reshape(2, d, d), pooled, diagonal)


def _score(model: Discriminant):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, len(NAMES))
            yield common.as_batch(schema, doc_id=batch.column(0), score=model.score(x))

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", learn_from: Column | None = None) -> DataFrame:
    """``(doc_id, score)`` for every row of ``docs(doc_id, text)``: the probability of label 1.

    Learns from the rows of ``labels(doc_id, <label>)`` at which ``learn_from``, an
    expression over doc_id, holds (all, if none is given). The score looks at the text only; a null text is
    empty and has a score. Rows without id are scored and never learnt from; repeated rows
    are scored alike. Without any labels all scores are 0.5. An empty table gives an empty result.
    """
    stats = common.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.tidy(_statistics), "doc_id long, stats binary"))
    known = labels.select(F.col("doc_id").cast("long"), F.col(label).alias("label"))
    model = train(stats, known if learn_from is None else known.where(learn_from))
    return stats.mapInArrow(_score(model), "doc_id long, score double")


def kept_by_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", reject_below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``reject_below``, all columns; every label is learnt from.

    The model is small and goes to the rows: texts are never shuffled, only the statistics of labelled ones.
    Texts and ids are met as in ``quality_scores``.
    """
    stats = common.cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(common.tidy(_statistics), "doc_id long, stats binary"))
    model = train(stats, labels.select(F.col("doc_id").cast("long"), F.col(label).alias("label")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in common.chunks(batches, "text"):
            score = model.score(np.stack([statistics(t) for t in texts]))
            yield part.filter(pa.array(score >= reject_below))

    return docs.mapInArrow(common.tidy(run), docs.schema)
