"""Nearest vectors by multi-index hashing over learned rotated binary codes.

A rotation is learned on a bounded sample so that the signs of the rotated, centred
vectors quantise them best (iterative quantisation, Gong and Lazebnik 2011); every
vector gets the code of signs.  Codes are cut into substrings, each with an index of
its own.  If two codes differ in at most ``radius`` bits, some substring differs in at
most its share of them (Norouzi et al. 2012), so probing each substring's buckets
within that share returns every code within the radius; the full distance is checked
and the rest is ranked by the inner product of the original vectors in double precision.

Equal vectors are one class.  A class keeps its ``k + 1`` smallest ids, as no other
can be among the ``k`` nearest, and equal queries are searched once.  Queries and
classes meet in blocks, so memory is bounded and only the best of a block leave it.
The radius is learned too: it holds ``coverage`` of the sample's true neighbours.  A
query that finds too few rows is searched again with the whole range of distances.

Null, zero, non-finite vectors and null ids take no part, nor do vectors of another
length than the most frequent one (the larger length on a tie).  Rows that repeat an id
and a vector count once.  A table without vectors gives no rows.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graticule.llm.common import named
from graticule.session import durable

POPULATION = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


class BinaryCodes:
    """Rotations learned on a sample, and the codes of vectors."""

    def __init__(self, sample, rotations=2, rounds=30, seed=7):
        rng = np.random.default_rng(seed)
        self.centre = sample.mean(0)
        flat = sample - self.centre
        self.rotations = []
        for _ in range(rotations):
            turn = np.linalg.qr(rng.normal(size=(flat.shape[1],) * 2))[0]
            for _ in range(rounds):
                left, _, right = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
                turn = (left @ right).T
            self.rotations.append(turn)
        self.bits = rotations * flat.shape[1]

    def codes(self, vectors):
        """Rows of 16-bit substrings; the last one may be padded with zeros."""
        flat = vectors - self.centre
        signs = np.concatenate([flat @ turn > 0 for turn in self.rotations], axis=1)
        signs = np.pad(signs, ((0, 0), (0, -self.bits % 16)))
        return np.packbits(signs, axis=1).view(np.uint16)


def distances(code, codes):
    return POPULATION[codes ^ code].sum(-1, dtype=np.int32)


def learned_radius(sample, model, k, coverage, queries=300):
    """Distance that holds ``coverage`` of the sample's true neighbours."""
    codes = model.codes(sample)
    found = []
    for i in range(min(queries, len(sample))):
        scores = sample @ sample[i]
        scores[i] = -np.inf
        near = np.argsort(-scores)[:k]
        found.append(distances(codes[i], codes[near]))
    return int(math.ceil(np.quantile(np.concatenate(found), coverage))) if found else model.bits


class SubstringIndex:
    """One index per substring: its distinct values and the rows of each."""

    def __init__(self, codes):
        self.codes = codes
        self.tables = []
        for column in codes.T:
            order = np.argsort(column, kind="stable")
            values, counts = np.unique(column, return_counts=True)
            self.tables.append((order, values, counts))

    def within(self, code, radius):
        """Rows whose code lies within ``radius``, in ascending order."""
        parts = len(self.tables)
        share, more = divmod(radius, parts)
        marked = np.zeros(len(self.codes), dtype=bool)
        for j, (order, values, counts) in enumerate(self.tables):
            # at most ``more`` substrings can exceed their share by one, so the
            # others need only be probed to one bit less
            reach = share if j <= more else share - 1
            if reach < 0:
                continue
            hit = POPULATION[values ^ code[j]] <= reach
            marked[order[np.repeat(hit, counts)]] = True
        rows = np.flatnonzero(marked)
        return rows[distances(code, self.codes[rows]) <= radius]


def search_block(index, queries, radius, k):
    """Best ``k`` classes of one block of the index for one block of queries."""
    out = ([], [], [])
    if index.num_rows and queries.num_rows:
        ids, vectors = np.asarray(index["_class"]), _matrix(index["_vec"])
        found = SubstringIndex(_codes(index["_code"]))
        for q, v, c in zip(np.asarray(queries["_query"]), _matrix(queries["_qvec"]),
                           _codes(queries["_qcode"])):
            rows = found.within(c, radius)
            scores = (vectors[rows] * v).sum(1)
            # ties with the last place stay: ids decide between them later
            best = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(rows) > k else (
                np.arange(len(rows)))
            out[0].extend([int(q)] * len(best))
            out[1].extend(ids[rows[best]].tolist())
            out[2].extend(scores[best].tolist())
    return pa.table({"_query": pa.array(out[0], pa.int64()), "_class": pa.array(out[1], pa.int64()),
                     "score": pa.array(out[2], pa.float64())})


def _matrix(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1)


def _codes(column):
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.stack([np.frombuffer(x.as_py(), dtype=np.uint16) for x in column])


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(_id, _vec): the vectors that take part, as doubles, without repeated rows."""
    flat = rows.select(
        named(key).cast("bigint").alias("_id"),
        F.transform(named(vector), lambda x: x.cast("double") + 0.0).alias("_vec"))
    flat = flat.where(
        F.col("_id").isNotNull() & F.col("_vec").isNotNull()
        & F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("_vec", lambda x: x != 0))
    return flat.dropDuplicates(["_id", "_vec"])


def nearest(rows: DataFrame, key="vec_id", vector="embedding", every=20, k=20, sample=10_000,
            rotations=2, coverage=0.985, index_block=4096, query_block=1024) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose id is divisible by ``every``."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    flat = durable(usable(rows, key, vector))
    lengths = flat.groupBy(F.size("_vec").alias("n")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        return empty
    flat = flat.where(F.size("_vec") == common["n"])
    total = common["count"]
    # the k + 1 smallest ids of each class; Spark limits the groups before the shuffle
    place = F.row_number().over(Window.partitionBy("_vec").orderBy("_id"))
    classes = flat.withColumn("_n", place).where(F.col("_n") <= k + 1).groupBy("_vec").agg(
        F.sort_array(F.collect_list("_id")).alias("_ids")).withColumn("_class", F.col("_ids")[0])
    # a class is named by its smallest id; an id with several vectors names several
    classes = durable(classes.withColumn("_class", F.xxhash64("_class", "_vec")))
    n_classes = classes.count()
    share = min(1.0, sample / n_classes)
    drawn = classes.where(
        F.pmod(F.xxhash64("_class", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20)
    ).select("_class", "_vec").limit(2 * sample).toArrow().sort_by("_class")
    learning = _matrix(drawn["_vec"]) if drawn.num_rows else None
    if learning is None:
        learning = _matrix(classes.select("_vec").limit(1).toArrow()["_vec"])
    model = BinaryCodes(learning, rotations)
    radius = learned_radius(learning, model, k, coverage)

    def code(batches):
        for b in batches:
            codes = model.codes(_matrix(b["_vec"])) if b.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [b["_class"], b["_vec"], pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["_class", "_vec", "_code"])

    index = durable(classes.select("_class", "_vec").mapInArrow(
        code, "_class bigint, _vec array<double>, _code binary"))
    asking = flat.where(F.col("_id") % every == 0).join(
        classes.select("_vec", "_class"), "_vec").select("_id", "_class")
    asking = durable(asking)
    wanted = asking.select(F.col("_class").alias("_query")).distinct()
    ids = classes.select("_class", "_ids")
    lists = durable(_lists(_search(index, wanted, n_classes, radius, k, index_block, query_block),
                           ids, k))
    # fewer than there are rows to find: search those without a radius
    short = durable(wanted.join(
        lists.where(F.size("_near") >= min(k + 1, total)).select("_query"), "_query", "left_anti"))
    if not short.isEmpty():
        again = _lists(_search(index, short, n_classes, model.bits, k, index_block, query_block),
                       ids, k)
        lists = lists.join(short, "_query", "left_anti").unionByName(again)
    others = F.slice(F.filter("_near", lambda x: x["id"] != F.col("_id")), 1, k)
    return asking.join(lists, asking["_class"] == lists["_query"]).select(
        F.col("_id"), F.posexplode(others).alias("_rank", "_x")).select(
        F.col("_id").alias("query_id"), (F.col("_rank") + 1).alias("rank"),
        F.col("_x.id").alias("vec_id"), (-F.col("_x.far")).alias("score"))


def _search(index, wanted, n_classes, radius, k, index_block, query_block):
    """Best k + 1 classes of each block for each wanted class."""
    queries = index.join(wanted, index["_class"] == wanted["_query"]).select(
        "_query", F.col("_vec").alias("_qvec"), F.col("_code").alias("_qcode"))
    blocks = -(-n_classes // index_block)
    groups = -(-wanted.count() // query_block) or 1
    left = index.withColumn("_b", F.pmod(F.xxhash64("_class"), F.lit(blocks))).withColumn(
        "_g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")))
    right = queries.withColumn("_g", F.pmod(F.xxhash64("_query", F.lit(3)), F.lit(groups))).withColumn(
        "_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        return search_block(a, b, radius, k + 1)

    return left.groupBy("_b", "_g").cogroup(right.groupBy("_b", "_g")).applyInArrow(
        meet, "_query bigint, _class bigint, score double")


def _lists(found, ids, k):
    """The k + 1 nearest rows of each wanted class, nearest first, then by id."""
    # classes with the same score can hold smaller ids: none of them is cut off here
    top = found.withColumn("_n", F.rank().over(
        Window.partitionBy("_query").orderBy(F.desc("score")))).where(F.col("_n") <= k + 1)
    spread = top.join(ids, "_class").select(
        "_query", F.explode("_ids").alias("id"), (-F.col("score")).alias("far"))
    near = spread.withColumn("_n", F.row_number().over(
        Window.partitionBy("_query").orderBy("far", "id"))).where(F.col("_n") <= k + 1)
    return near.groupBy("_query").agg(
        F.sort_array(F.collect_list(F.struct("far", "id"))).alias("_near"))
