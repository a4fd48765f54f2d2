"""Documents joined by the Jaccard similarity of their word n-grams.

Method: blocked sparse matrix product of the incidence of documents and n-grams.
Overlap counts are accumulated and pairs below the bounds given by the sizes of
the two sets are discarded.

1. Documents with the same set of n-grams become one row of the matrix. A row is known by 64 bits of its set's hash, never by a
   document: ids may repeat or be missing. The smallest doc_id of a class is looked up at the end.
2. Columns with a single row cannot contribute to a product and are left out. A
   row that keeps less than the threshold's share of its n-grams cannot reach
   the threshold with any other and is left out as well.
3. Rows are dealt into clusters that cannot share a link: rows that meet in the
   prefix of their rarest n-grams which the sizes demand (any two rows that
   link meet there), and what these are connected by. Frequent n-grams come
   last in that order; the most frequent are known by a table of bounded size.
4. A cluster is cut into row blocks of bounded size; every pair of blocks is a
   product of its own. Only the links that connect new rows leave a block, never
   its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortline.llm import common, postings
from cohortline.llm.components import connected

MEMBER = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("text_key", pa.binary()), ("gram", pa.int64()), ("documents", pa.int64())])
MEMBER_DDL = "doc_id long, n_shingles long, set_key binary, text_key binary, gram long, documents long"
ROW = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("prefix", pa.int32()), ("keys", pa.binary())])
ROW_DDL = "rep long, n long, prefix int, keys binary"
FREQUENT = 1 << 17  # rows of the table of frequent n-grams: 2 MB, broadcast
SEEN = 64  # documents of one portion that make an n-gram a candidate for it
PORTION = 1 << 22  # n-grams of a portion
BLOCK = 1 << 20  # n-grams of a row block


def set_number(set_key: bytes) -> int:
    return int.from_bytes(set_key[:8], "big", signed=True)


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[bytes]]]:
    for part, texts in common.chunks(batches, "text"):
        sets = common.shingles(*common.words(texts), size)
        yield part, sets, [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]


def _members(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        portion: dict[bytes, np.ndarray] = {}
        held = 0

        def frequent() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(list(portion.values())), return_counts=True)
            grams, n = grams[n >= SEEN], n[n >= SEEN]
            none = pa.nulls(len(grams), pa.int64())
            return common.as_batch(MEMBER, doc_id=none, n_shingles=none, set_key=pa.nulls(len(grams), pa.binary()),
                                   text_key=pa.nulls(len(grams), pa.binary()), gram=pa.array(grams.view(np.int64)), documents=n)

        for part, sets, keys in _sets(batches, size):
            none = pa.nulls(len(sets), pa.int64())
            yield common.as_batch(MEMBER, doc_id=part.column(0), n_shingles=[len(s) for s in sets], set_key=keys, text_key=part.column(1),
                                   gram=none, documents=none)
            for s, k in zip(sets, keys):
                if len(s) and k not in portion:
                    portion[k] = s
                    held += len(s)
            if held >= PORTION:
                yield frequent()
                portion, held = {}, 0
        if held:
            yield frequent()

    return run


def _dealt(size: int, buckets: int, known):
    """Keys of the distinct sets, dealt by bucket. Frequent n-grams are known to be shared: with their counts they go to a bucket of their owner.

    So does the size of each set, as an element without owners: rows need then not be joined for it.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, degree = known.value
        passed: dict[int, np.ndarray] = {}

        def owned():
            for _, sets, keys in _sets(batches, size):
                for s, k in zip(sets, keys):
                    if not len(s):
                        continue
                    often = _within(s, grams)
                    element = np.zeros(1 + int(often.sum()), postings.ELEMENT)
                    element["key"][0] = len(s)
                    element["key"][1:] = s[often]
                    # above every count of a bucket: these come last in the order, by their own counts
                    element["owners"][1:] = (1 << 31) + degree[np.searchsorted(grams, s[often])] if often.any() else 0
                    passed[set_number(k)] = element
                    yield set_number(k), s[~often]

        def frequent() -> pa.RecordBatch:
            counts = np.fromiter(map(len, passed.values()), np.int64, len(passed))
            return postings.known(np.fromiter(passed, np.int64, len(passed)), counts, np.concatenate(list(passed.values())), buckets)

        for batch in postings.dealt(owned(), buckets):
            yield batch
            if passed:
                yield frequent()
                passed.clear()
        if passed:
            yield frequent()

    return run


def _within(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _rows(threshold: int):
    """Rows of the matrix that can reach the threshold: the shared n-grams of a set, rarest first, and how many of them its size puts into the prefix."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n, prefix, keys = [], [], [], []
            for owner, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                element = np.frombuffer(own, postings.ELEMENT)
                element = element[np.lexsort((element["key"], element["owners"]))]
                size, element = int(element["key"][0]), element[1:]  # the one without owners comes first
                if 100 * len(element) < threshold * size:
                    continue
                alone = size - len(element)
                rep.append(owner)
                n.append(size)
                prefix.append(size - -(-threshold * size // 100) + 1 - alone)
                keys.append(element["key"].tobytes())
            yield common.as_batch(ROW, rep=rep, n=n, prefix=prefix, keys=keys)

    return run


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])
    for batch in batches:
        for rep, prefix, keys in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
            key = np.frombuffer(keys, np.int64)[:prefix]
            yield common.as_batch(schema, key=key, rep=np.full(len(key), rep))


class _Forest:
    """Rows that are connected so far."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def block_links(sizes: np.ndarray, rows: list[np.ndarray], side: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Pairs of rows that link and connect what was not yet connected.

    ``side`` 0 marks the rows of the first block and 1 those of the second; with
    a single block all are 0, and each row meets the others of its own block.
    """
    two = bool(side.any())
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    _, column = np.unique(np.concatenate(rows), return_inverse=True)
    begin = np.r_[0, np.cumsum(lengths)]
    who = np.repeat(np.arange(len(rows)), lengths)
    indexed = np.flatnonzero(side[who] == 1) if two else np.arange(len(who))
    by_column = indexed[np.argsort(column[indexed], kind="stable")]
    posting = who[by_column]
    at = np.searchsorted(column[by_column], np.arange(column.max() + 2))
    forest, found = _Forest(len(rows)), []
    for x in np.flatnonzero(side == 0):
        own = column[begin[x]:begin[x + 1]]
        lists = [posting[at[c]:at[c + 1]] for c in own]
        if not lists:
            continue
        other, overlap = np.unique(np.concatenate(lists), return_counts=True)
        least = np.minimum(sizes[other], sizes[x]) * 100 >= threshold * np.maximum(sizes[other], sizes[x])
        linked = least & (100 * overlap >= threshold * (sizes[other] + sizes[x] - overlap)) & (other != x)
        for y in other[linked].tolist():
            if forest.join(int(x), y):
                found.append((int(x), y))
    return found


def _products(threshold: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
        for (_, i, j), table in common.groups(batches, ["cluster", "i", "j"]):
            rep = table.column("rep").to_numpy()
            rows = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
            side = (table.column("block").to_numpy() != i).astype(np.int8) if i != j else np.zeros(len(rep), np.int8)
            if i != j and (side.all() or not side.any()):
                continue
            links = block_links(table.column("n").to_numpy(), rows, side, threshold)
            if links:
                u, v = np.asarray(links).T
                yield common.as_batch(schema, u=rep[u], v=rep[v])

    return run


def _classes(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    """``(doc_id, n_shingles, set_key, text_key, class, component_id)`` for every row; ``class`` is null for an empty set."""
    spark = docs.sparkSession
    buckets = min(common.partitions(docs), 1 << 16)
    texts = docs.select("text")
    keyed = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("text_key"), "text")
    seen = common.cut(keyed.mapInArrow(common.tidy(_members(size)), MEMBER_DDL))
    members = seen.where("set_key IS NOT NULL").drop("gram", "documents")
    top = (seen.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("documents").alias("documents"))
           .orderBy(F.desc("documents"), "gram").limit(FREQUENT).collect())
    table = np.asarray([(r.gram, r.documents) for r in top], np.int64).reshape(-1, 2)
    grams = table[:, 0].copy().view(np.uint64)
    order = np.argsort(grams)
    known = spark.sparkContext.broadcast((grams[order], np.minimum(table[order, 1], (1 << 31) - 1).astype(np.uint32)))

    filled = members.where("n_shingles > 0").withColumn("rep", F.expr("conv(hex(substring(set_key, 1, 8)), 16, -10)").cast("long"))
    sets = filled.groupBy("rep").agg(F.min("doc_id").alias("least_id"))
    shared = postings.shared_keys(texts.mapInArrow(common.tidy(_dealt(size, buckets, known)), postings.DEALT_DDL), buckets)
    rows = common.cut(shared.mapInArrow(common.tidy(_rows(threshold)), ROW_DDL), few=False)

    prefixes = rows.select("rep", "prefix", "keys").mapInArrow(_prefixes, "key long, rep long")
    least = prefixes.groupBy("key").agg(F.min("rep").alias("first"), F.count("*").alias("k")).where("k > 1").drop("k")
    clusters = connected(prefixes.join(least, "key").select(F.col("rep").alias("u"), F.col("first").alias("v")))
    # where a row belongs is worked out without its n-grams: they are moved to their cluster once, and from there to their products
    placed = rows.select("rep", "n").join(clusters.select(F.col("id").alias("rep"), F.col("component").alias("cluster")), "rep")
    blocks = placed.groupBy("cluster").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    row = rows.join(placed.drop("n").join(blocks, "cluster"), "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pairs = (row.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "n", "keys"))
    links = (pairs.repartition(buckets, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
             .mapInArrow(common.tidy(_products(threshold)), "u long, v long"))
    joined = connected(links)

    # sets without links are a class of their own and need no further look
    linked = sets.join(joined.withColumnRenamed("id", "rep"), "rep").select("rep", F.col("component").alias("class"), "least_id")
    smallest = linked.groupBy("class").agg(F.min("least_id").alias("class_id"))
    named = sets.select("rep", "least_id").join(linked.join(smallest, "class").select("rep", "class", "class_id"), "rep", "left").select(
        "rep", F.coalesce("class", "rep").alias("class"), F.when(F.col("class").isNull(), F.col("least_id")).otherwise(F.col("class_id")).alias("component_id"))
    columns = ["doc_id", "n_shingles", "set_key", "text_key", "class", "component_id"]
    return filled.join(named, "rep").select(*columns).union(
        members.where("n_shingles = 0").withColumns({"class": F.lit(None).cast("long"), "component_id": F.col("doc_id")}).select(*columns))


def text_key(text: Column) -> Column:
    """128 bits of a text's hash; a null text is empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def jaccard_components(docs: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, set_key, component_id)`` for every row of ``docs(doc_id, text)``.

    Two documents link when 100 * |A and B| >= ``threshold`` * |A or B| for their
    sets of distinct runs of ``size`` words; ``component_id`` is the smallest
    doc_id reachable by links. A text with fewer words is one run of all of
    them; a null text or one without words has an empty set, links with nothing
    and keeps its own id. Rows with the same doc_id and other texts are documents of
    their own. A row without doc_id links like any other and has the component of its class, which is null only
    if no row of the class has an id. Columns other than the two are not looked at. An empty
    table gives an empty result.
    """
    return _classes(docs, size, threshold).select("doc_id", "n_shingles", "set_key", "component_id")


def without_duplicates(docs: DataFrame, size: int = 5, threshold: int = 75) -> DataFrame:
    """The rows of ``docs``, all columns, of which no class of near duplicates has a smaller one: one row of each class.

    The smallest is that with the smallest doc_id (a missing one comes last), then with the smallest hash of its text; of rows
    that agree in both any one. Rows are met by doc_id and text, so other texts with the id of a dropped one stay.
    Rows with an empty set stay, all of them.
    """
    rows = common.cut(_classes(docs, size, threshold).select("doc_id", "n_shingles", "text_key", "class"))
    filled = rows.where("n_shingles > 0")
    first = filled.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("w")).select("w.doc_id", "w.text_key", F.lit(True).alias("one"))
    empty = rows.where("n_shingles = 0").select("doc_id", "text_key").distinct().withColumn("one", F.lit(False))
    times = filled.groupBy("doc_id", "text_key").agg(F.count("*").alias("times")).where("times > 1").select("doc_id", "text_key")

    def met(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(right, F.col("met_id").eqNullSafe(right["doc_id"]) & (F.col("met_key") == right["text_key"]), how)

    again = met(first.withColumnsRenamed({"doc_id": "met_id", "text_key": "met_key"}), times, "left_semi").withColumnsRenamed({"met_id": "doc_id", "met_key": "text_key"})
    single = met(first.withColumnsRenamed({"doc_id": "met_id", "text_key": "met_key"}), times, "left_anti").withColumnsRenamed({"met_id": "doc_id", "met_key": "text_key"})
    asked = docs.select(F.col("doc_id").cast("long").alias("met_id"), text_key(F.col("text")).alias("met_key"), common.together(docs).alias("rest"))
    kept = met(asked, single.union(empty), "left_semi").select("rest")
    repeated = met(asked, again, "left_semi").groupBy("met_id", "met_key").agg(F.first("rest").alias("rest")).select("rest")
    return kept.union(repeated).select(*common.apart("rest", docs.columns))
