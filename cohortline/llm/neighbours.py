"""Approximate nearest neighbours by inner product.

Method: adaptive dimension scan. Inner products become distances by one more
component that gives all vectors the same length. Vectors are rotated at random
and held in blocks of columns. Centroids divide them into lists; in the lists that
a query probes, distances are added up block by block, and after each block a test
abandons the candidates whose partial distance, scaled to all columns, lies
above the query's bound by more than the rotation's chance error allows.

The index is fitted on a bounded sample (``SAMPLE`` vectors): the centroids, and how
many lists hold the neighbours that a sampled query looks for. Every vector is indexed.
A query's first bound is its k-th distance within the sample, which no true neighbour exceeds;
the k found there are candidates like those of the lists.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortline.llm import common, vectors

SAMPLE = 8192
LIST = 2048  # vectors of a list, on average, until there are LISTS lists
LISTS = 1024
SPLIT = 8192  # vectors of a list that one task holds
COLUMNS = 16
TOGETHER = 256  # queries of one portion
ERROR = 2.1  # of the test, in deviations


class Index:
    """What the sample fixes: the lengthening, rotation, centroids and the number of lists to probe."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, longest: float, n: int, k: int, aim: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.k, self.longest, self.ids, self.points = k, longest, ids, sample
        dim = sample.shape[1] + 1
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.sample = self.lengthened(sample)
        lists = int(np.clip(n // LIST, 1, min(LISTS, max(1, len(sample) // 2))))
        self.centroids = self._centroids(rng, lists)
        self.probes = self._probes(sample, aim)

    @classmethod
    def received(cls, parts: dict) -> Index:
        """The index from its arrays; these are what is broadcast."""
        index = cls.__new__(cls)
        vars(index).update(parts)
        return index

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest ** 2 - np.einsum("ij,ij->i", x, x), 0))
        return np.concatenate([x, rest[:, None]], 1) @ self.rotation

    def query(self, x: np.ndarray) -> np.ndarray:
        return x @ self.rotation[:-1]

    def _centroids(self, rng: np.random.Generator, lists: int) -> np.ndarray:
        centroids = self.sample[rng.choice(len(self.sample), lists, replace=False)]
        for _ in range(8):
            nearest = squared(self.sample, centroids).argmin(1)
            for c in range(lists):
                own = self.sample[nearest == c]
                if len(own):
                    centroids[c] = own.mean(0)
        return centroids

    def _probes(self, sample: np.ndarray, aim: float) -> int:
        """Lists, nearest first, that hold the share ``aim`` of the k nearest in the sample of up to 512 of its members."""
        some = np.arange(min(512, len(sample)))
        where = squared(self.sample, self.centroids).argmin(1)
        q = self.query(sample[some])
        near = squared(q, self.sample)
        near[some, some] = np.inf
        nearest = np.argsort(near, 1)[:, :self.k]
        rank = np.argsort(np.argsort(squared(q, self.centroids), 1), 1)
        needed = np.sort(np.take_along_axis(rank, where[nearest], 1).ravel())
        return int(needed[min(len(needed) - 1, int(aim * len(needed)))]) + 1 if len(needed) else len(self.centroids)

    def within_sample(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Each query's k-th squared distance within the sample, itself left out, and (query, vec_id, score) of those k."""
        near = squared(self.query(x), self.sample)
        near[own[:, None] == self.ids[None]] = np.inf
        k = min(self.k, near.shape[1])
        first = np.argpartition(near, k - 1, 1)[:, :k]
        distance = np.take_along_axis(near, first, 1)
        bound = distance.max(1) if k == self.k else np.full(len(x), np.inf)
        row, column = np.nonzero(np.isfinite(distance))
        found = first[row, column]
        return bound, (own[row], self.ids[found], np.einsum("ij,ij->i", x[row], self.points[found]))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)[None], 0)


ASSIGNED = pa.schema([("list", pa.int32()), ("role", pa.int32()), ("vec_id", pa.int64()), ("bound", pa.float64()), ("vec", pa.binary()), ("other", pa.int64())])
ASSIGNED_DDL = "list int, role int, vec_id long, bound double, vec binary, other long"


def _assign(index, kind: np.dtype, every: int):
    """Every vector to its list (role 0) and every query, with its bound, to the lists it probes (role 1), and its k nearest in the sample with their scores (role 2)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Index.received(index.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                ids, raw = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64), np.asarray(part.column(2).to_pylist(), object)
                x = vectors.matrix(part.column(2), kind)
                nearest = squared(fitted.lengthened(x), fitted.centroids).argmin(1)
                yield common.as_batch(ASSIGNED, list=nearest.astype(np.int32), role=np.zeros(len(ids), np.int32), vec_id=ids, bound=np.zeros(len(ids)), vec=raw.tolist(), other=ids)
                asking = np.flatnonzero(ids % every == 0)
                if len(asking):
                    q = fitted.query(x[asking])
                    probed = np.argsort(squared(q, fitted.centroids), 1, kind="stable")[:, :fitted.probes]
                    bound, (query, found, score) = fitted.within_sample(x[asking], ids[asking])
                    n = probed.shape[1]
                    yield common.as_batch(ASSIGNED, list=probed.ravel().astype(np.int32), role=np.ones(probed.size, np.int32), vec_id=np.repeat(ids[asking], n),
                                          bound=np.repeat(bound, n), vec=np.repeat(raw[asking], n).tolist(), other=np.repeat(ids[asking], n))
                    yield common.as_batch(ASSIGNED, list=np.zeros(len(query), np.int32), role=np.full(len(query), 2, np.int32), vec_id=query,
                                          bound=score, vec=[b""] * len(query), other=found)

    return run


def scan(index: Index, held: list[np.ndarray], originals: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray,
         bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vec_id, score) of the k best that the scan leaves of one list, for portions of queries; ``held`` are its rotated column blocks."""
    dim = sum(b.shape[1] for b in held)
    for a in range(0, len(queries), TOGETHER):
        x, own, bound = queries[a:a + TOGETHER], query_ids[a:a + TOGETHER], bounds[a:a + TOGETHER]
        q = index.query(x)
        partial = squared(q[:, :held[0].shape[1]], held[0])
        done = held[0].shape[1]

        def limit(done: int) -> np.ndarray:
            error = 0.0 if done == dim else ERROR / np.sqrt(done)
            return bound * (done / dim) * (1 + error) ** 2 * (1 + 1e-9) + 1e-12

        row, column = np.nonzero(partial <= limit(done)[:, None])
        total = partial[row, column]
        for block in held[1:]:
            begin, done = done, done + block.shape[1]
            difference = q[row, begin:done] - block[column]
            total = total + np.einsum("ij,ij->i", difference, difference)
            stay = total <= limit(done)[row]
            row, column, total = row[stay], column[stay], total[stay]
        other = ids[column] != own[row]
        row, column = row[other], column[other]
        score = np.empty(len(row))
        for i in range(0, len(row), 1 << 16):
            score[i:i + (1 << 16)] = np.einsum("ij,ij->i", x[row[i:i + (1 << 16)]], originals[column[i:i + (1 << 16)]])
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        first = np.searchsorted(row, np.arange(len(x)))
        best = np.arange(len(row)) - first[row] < index.k if len(row) else np.empty(0, bool)
        yield own[row[best]], ids[column[best]], score[best]


def _search(index, kind: np.dtype):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Index.received(index.value)
        current, pending, held, originals, ids = None, [], [], None, None
        for (list_, split, role), part in common.runs(batches, ["list", "split", "role"]):
            if (list_, split) != current:
                current, pending, held = (list_, split), [], []
            if role == 0:
                pending.append(part)
                continue
            if not pending and not held:
                continue
            if not held:
                table = pa.Table.from_batches(pending)
                originals, ids = vectors.matrix(table.column("vec"), kind), table.column("vec_id").to_numpy()
                turned = fitted.lengthened(originals)
                held = [np.ascontiguousarray(turned[:, c:c + COLUMNS]) for c in range(0, turned.shape[1], COLUMNS)]
                pending = []
            names = {f.name: i for i, f in enumerate(part.schema)}
            queries = vectors.matrix(part.column(names["vec"]), kind)
            for query, found, score in scan(fitted, held, originals, ids, queries, part.column(names["vec_id"]).to_numpy(),
                                            part.column(names["bound"]).to_numpy()):
                if len(query):
                    yield common.as_batch(schema, query_id=query, vec_id=found, score=score)

    return run


def nearest(rows: DataFrame, k: int = 20, every: int = 20, aim: float = 0.97) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each vector whose id is divisible by ``every``, the ``k`` found nearest by inner product.

    ``rows`` has vec_id and embedding. Vectors that are null, empty or zero or hold
    null or non-finite components take no part, nor do rows without id. A vector finds those of its own length;
    each length has an index of its own. Scores are inner products of the original vectors in double precision; ties go to the smaller
    vec_id. A query never finds rows of its own id; a repeated id is found
    once, by the best of its rows, and asks with all of them.
    ``aim`` is the share of neighbours in a sample that the probed lists hold. Other
    columns are not looked at; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    clean, kind = vectors.read(rows.where("vec_id IS NOT NULL"))
    clean = common.cut(clean, few=False)
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    for dim, n in [tuple(r) for r in clean.groupBy("dim").agg(F.count("*")).where("count(1) > 1").orderBy("dim").collect()]:
        found = found.union(_of_length(clean.where(F.col("dim") == dim), n, k, every, aim, kind))
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _of_length(clean: DataFrame, n: int, k: int, every: int, aim: float, kind: np.dtype) -> DataFrame:
    """``(query_id, vec_id, score)`` of what is found among the vectors of one length, in any order and more than once."""
    spark = clean.sparkSession
    drawn = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(1 << 20)) < min(1 << 20, -(-2 * SAMPLE * (1 << 20) // n))
    sample = clean.where(drawn).orderBy(F.xxhash64(F.lit(4), "vec_id"), "vec").limit(SAMPLE).select("vec_id", "vec").collect()
    if not sample:
        sample = clean.select("vec_id", "vec").limit(1).collect()
    points = np.frombuffer(b"".join(r.vec for r in sample), kind).reshape(len(sample), -1).astype(np.float64)

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.matrix(batch.column(0), kind)
                yield pa.RecordBatch.from_arrays([pa.array([float(np.sqrt(np.einsum("ij,ij->i", x, x).max()))])], names=["longest"])

    longest = clean.select("vec").mapInArrow(lengths, "longest double").agg(F.max("longest")).first()[0]
    index = spark.sparkContext.broadcast(vars(Index(np.asarray([r.vec_id for r in sample]), points, longest, n, k, aim)))
    assigned = common.cut(clean.mapInArrow(_assign(index, kind, every), ASSIGNED_DDL), few=False)
    splits = assigned.where("role = 0").groupBy("list").agg(F.ceil(F.count("*") / SPLIT).cast("int").alias("splits"))
    placed = assigned.join(splits, "list")
    held = placed.where("role = 0").withColumn("split", F.pmod(F.xxhash64(F.lit(6), "vec_id", "vec"), F.col("splits")).cast("int"))
    asked = placed.where("role = 1").withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
    columns = ["list", "split", "role", "vec_id", "bound", "vec"]
    found = (held.select(*columns).union(asked.select(*columns)).repartition(common.partitions(clean), "list", "split")
             .sortWithinPartitions("list", "split", "role").mapInArrow(_search(index, kind), "query_id long, vec_id long, score double"))
    sampled = assigned.where("role = 2").select(F.col("vec_id").alias("query_id"), F.col("other").alias("vec_id"), F.col("bound").alias("score"))
    return found.union(sampled)
