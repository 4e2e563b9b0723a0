"""Exact k-means of integer vectors, centroids filtered by n-simplex projection.

A few vectors serve as pivots.  Their mutual distances fix the vertices of a simplex;
the distances of a vector to the pivots make it the apex of a simplex over that base
(Connor, Cardillo, Vadicamo and Rabitti 2016).  The Euclidean distance of two apexes
never exceeds the true distance, and with the last coordinate of one negated it is
never below it.  Apexes of the vectors are made once and stored with them; those of the
centroids are made anew each round.  A centroid whose lower bound lies above the least
upper bound cannot be the nearest; the others are compared by exact integer distances.

A round sends one row of sums for each centroid out of each task, so that the driver
sees ``k`` rows however many vectors there are.  Rounds stop early only when the
centroids repeat, since nothing can change from there on.

Null vectors, vectors of another length and those with a null or non-finite component
take no part.  Rows that repeat an id count one by one.  A null id is an id like any
other, and last when the first centroids are chosen; rows with the same id are then
taken by their components.  Ties go to the smaller centroid.  Fewer vectors than ``k``
give as many centroids; an empty table gives no rows.  Other columns are not read, and
their names do not matter.  Components beyond 2**27 units are refused with an error, as
their squared distances would not fit a long.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from graticule.llm.common import named
from graticule.session import durable

LIMIT = 1 << 27
SLACK = 1e-6  # of the squared distances involved: far above any rounding


class Base:
    """Vertices of the pivots' simplex, and apexes over it from squared distances."""

    def __init__(self, vectors, least=0.1):
        """Pivots that stand less than ``least`` of the spread off the others are left out."""
        self.pivots, self.vertices = np.zeros((0, vectors.shape[1]), np.int64), []
        spread = max([float(squared(vectors, v).max()) for v in vectors], default=0.0)
        for vector in vectors:
            apex = self.apexes(self.distances(vector[None]))[0] if len(self.pivots) else np.zeros(0)
            if len(self.pivots) and apex[-1] ** 2 <= least ** 2 * spread:
                continue
            self.pivots = np.concatenate([self.pivots, vector[None]])
            self.vertices.append(apex)

    def distances(self, vectors):
        """Squared distances to the pivots, one column each."""
        return np.stack([squared(vectors, p) for p in self.pivots], axis=1).astype(np.float64)

    def apexes(self, distances):
        """One coordinate for each pivot; the last one is the height over the base."""
        n = len(self.pivots)
        apex = np.zeros((len(distances), n))
        first = distances[:, 0]
        for i in range(1, n):
            vertex = self.vertices[i]
            known = apex[:, :i - 1] @ vertex[:i - 1]
            apex[:, i - 1] = ((first - distances[:, i] + vertex @ vertex) / 2 - known) / vertex[i - 1]
        apex[:, n - 1] = np.sqrt(np.maximum(first - (apex[:, :n - 1] ** 2).sum(1), 0))
        return apex


def squared(vectors, point):
    """Exact squared distances of integer vectors to an integer point."""
    gap = vectors - point
    return np.einsum("ij,ij->i", gap, gap)


def bounds(apexes, centres):
    """Squared lower and upper bounds of the distance, vectors by centroids."""
    flat = ((apexes[:, None, :-1] - centres[None, :, :-1]) ** 2).sum(2)
    height, other = apexes[:, None, -1], centres[None, :, -1]
    lower, upper = flat + (height - other) ** 2, flat + (height + other) ** 2
    slack = SLACK * ((apexes ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :])
    return lower - slack, upper + slack


def nearest(vectors, apexes, centroids, centres):
    """Nearest centroid, squared distance, and the number of exact comparisons."""
    lower, upper = bounds(apexes, centres)
    open_ = lower <= upper.min(1, keepdims=True)
    cluster = np.full(len(vectors), -1, np.int32)
    best = np.full(len(vectors), np.iinfo(np.int64).max)
    for c in range(len(centroids)):
        rows = np.flatnonzero(open_[:, c])
        found = squared(vectors[rows], centroids[c])
        closer = found < best[rows]
        rows = rows[closer]
        cluster[rows], best[rows] = c, found[closer]
    return cluster, best, int(open_.sum())


def quantise(vectors: DataFrame, key="vec_id", vector="embedding", width=64, scale=1024):
    """``_id`` and ``_v``, the integers floor(scale * x), of the vectors that take part."""
    x = named(vector).cast("array<double>")
    whole = F.coalesce((F.size(x) == width) & F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    units = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("bigint"))
    refused = F.raise_error(F.lit(f"a component is beyond {LIMIT} units"))
    fits = F.forall(x, lambda v: F.abs(v * F.lit(float(scale))) <= float(LIMIT))
    return vectors.where(whole).select(
        named(key).alias("_id"), F.when(fits, units).otherwise(refused.cast("array<bigint>")).alias("_v"))


def first_rows(kept: DataFrame, n, salt):
    """The vectors of the ``n`` smallest hashes of ``salt:id``."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")), 256)
    rows = kept.orderBy(order.asc_nulls_last(), "_v").limit(n).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def matrix(column, dtype):
    """A batch's list column as rows of equal length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(dtype)


def project(kept: DataFrame, base: Base) -> DataFrame:
    """``kept`` with the apex ``_apex`` of each vector."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        apexes = base.apexes(base.distances(matrix(column, np.int64)))
        ends = np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(apexes.ravel()))

    return kept.select("_id", "_v", run("_v").alias("_apex"))


def round_sums(table: DataFrame, base: Base, centroids, width):
    """{centroid: (vectors, componentwise sums)} and the number of exact comparisons."""
    centres = base.apexes(base.distances(centroids))

    def run(batches):
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64)
        compared = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = matrix(batch.column("_v"), np.int64)
            cluster, _, n = nearest(
                vectors, matrix(batch.column("_apex"), np.float64), centroids, centres)
            np.add.at(sums, cluster, vectors)
            counts += np.bincount(cluster, minlength=len(centroids))
            compared += n
        columns = [pa.array(np.arange(len(centroids), dtype=np.int32)), pa.array(counts),
                   pa.array([compared] + [0] * (len(centroids) - 1), pa.int64())]
        columns += [pa.array(sums[:, i]) for i in range(width)]
        yield pa.RecordBatch.from_arrays(columns, names=["c", "n", "compared", *map(str, range(width))])

    parts = table.mapInArrow(run, "c int, n bigint, compared bigint, " + ", ".join(
        f"`{i}` bigint" for i in range(width)))
    rows = parts.groupBy("c").agg(
        F.sum("n").alias("n"), F.sum("compared").alias("compared"),
        *[F.sum(F.col(str(i)).cast("decimal(38,0)")).alias(str(i)) for i in range(width)]).collect()
    return ({r["c"]: (r["n"], [int(r[str(i)]) for i in range(width)]) for r in rows},
            sum(r["compared"] for r in rows))


def cluster(vectors: DataFrame, key="vec_id", vector="embedding", k=8, rounds=10, width=64,
            scale=1024, salt="3", pivots=16, trace=None) -> DataFrame:
    """One row per vector: key, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    ``trace``, a list, gets the number of exact comparisons of each round.
    """
    spark = vectors.sparkSession
    kept = quantise(vectors, key, vector, width, scale)
    start = first_rows(kept, max(k, pivots), salt)
    empty = "cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(start):
        return kept.select(named("_id").alias(key), *[
            F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in empty.split(", ")])
    base = Base(start[:pivots])
    table = durable(project(kept, base))
    centroids = start[:k]
    for _ in range(rounds):
        found, compared = round_sums(table, base, centroids, width)
        if trace is not None:
            trace.append(compared)
        moved = centroids.copy()
        for c, (n, sums) in found.items():
            if n:
                moved[c] = [s // n for s in sums]
        if (moved == centroids).all():
            break
        centroids = moved
    centres = base.apexes(base.distances(centroids))

    def assign(batches):
        for batch in batches:
            if batch.num_rows:
                nearest_, distance, _ = nearest(
                    matrix(batch.column("_v"), np.int64), matrix(batch.column("_apex"), np.float64),
                    centroids, centres)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id"), pa.array(nearest_), pa.array(distance)],
                    names=["_id", "cluster", "distance"])

    id_type = kept.schema["_id"].dataType.simpleString()
    placed = durable(table.mapInArrow(assign, f"_id {id_type}, cluster int, distance bigint"))
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = sum(sums.values())
    text = [",".join(map(str, map(int, c))) for c in centroids]
    facts = spark.createDataFrame(
        [(c, s, total, hashlib.sha256(text[c].encode()).hexdigest()) for c, s in sums.items()],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # k rows
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
