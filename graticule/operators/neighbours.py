"""Approximate nearest neighbours: sorted LSH codes, refined by neighbour descent.

Rows are sorted by codes of random hyperplanes, so that rows with a long common prefix
stand together (an LSH forest, Bawa, Condie and Ganesan 2005), and are compared with the
rows of their own and the adjoining block only.  A few orders give first lists, which
then improve from each other: neighbours of neighbours are likely neighbours (Dong,
Moses and Li 2011).  Blocks are cut by position, so no bucket can be large, and a row
meets a fixed number of others: the work is proportional to the rows at every size.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.graph import (
    _matrix, _smallest, _vectors, distances, distinct_vectors, list_neighbours)
from graticule.session import discard, stored

BITS = 60


def _pick(ids, d, k):
    """(row, column) numbers of the ``k`` smallest finite entries of each row of ``d``."""
    width = min(k, d.shape[1])
    near = np.argpartition(d, width - 1, axis=1)[:, :width] if width < d.shape[1] else np.broadcast_to(
        np.arange(d.shape[1]), d.shape)
    keep = np.isfinite(np.take_along_axis(d, near, axis=1)).ravel()
    return np.repeat(np.arange(len(ids)), near.shape[1])[keep], near.ravel()[keep]


def _merge(parts, k):
    """Best ``k`` different neighbours of each row."""
    once = parts.groupBy("_rep", "_nbr").agg(F.min("_d").alias("_d"))
    return _smallest(once, ["_rep"], ["_d", "_nbr"], k).select("_rep", "_nbr", "_d")


PAIRS = "_rep bigint, _nbr bigint, _d double"


def _pairs(ids, others, d):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(d, pa.float64())],
        names=["_rep", "_nbr", "_d"])


def sorted_orders(reps: DataFrame, k, orders, block, seed, rows_per_task=50_000) -> DataFrame:
    """First lists (_rep, _nbr, _d) from the blocks of a few sorted orders."""
    size = F.size("_f")
    shape = reps.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("d")).first()
    if not shape["n"]:
        return reps.select(F.col("_rep"), F.col("_rep").alias("_nbr"), F.lit(0.0).alias("_d")).limit(0)
    mean = reps.agg(*[F.avg(F.col("_f")[i]).alias(f"m{i}") for i in range(shape["d"])]).first()
    centre = np.array(mean, float)
    planes = np.random.default_rng(seed).normal(size=(shape["d"], orders * BITS))

    @F.pandas_udf("array<bigint>")
    def codes(f: pd.Series) -> pd.Series:
        if not len(f):
            return pd.Series([], dtype=object)
        bits = ((_matrix(f) - centre) @ planes > 0).reshape(len(f), orders, BITS)
        return pd.Series(list(bits @ (1 << np.arange(BITS, dtype=np.int64)[::-1])))

    placed = reps.select("_rep", "_f", F.posexplode(codes("_f")).alias("_order", "_code"))
    tasks = max(1, -(-shape["n"] * orders // rows_per_task))
    keys = ["_order", "_code", "_rep"]

    def compare(batches):
        order = held = None

        def search(left, right):
            d = distances(left[1], right[1])
            d[left[0][:, None] == right[0][None, :]] = np.inf
            i, j = _pick(left[0], d, k)
            yield _pairs(left[0][i], right[0][j], d[i, j])
            if left is not right:
                j, i = _pick(right[0], d.T, k)
                yield _pairs(right[0][j], left[0][i], d[i, j])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not batch.num_rows:
                continue
            ids, vectors = table.column("_rep").to_numpy(), _vectors(table)
            which = table.column("_order").to_numpy()
            for start in range(0, len(ids), block):
                for o in np.unique(which[start:start + block]):
                    rows = np.flatnonzero(which[start:start + block] == o) + start
                    now = ids[rows], vectors[rows]
                    yield from search(now, now)
                    if order == o:
                        yield from search(held, now)
                    order, held = o, now

    ranged = placed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    return _merge(ranged.select("_rep", "_f", "_order").mapInArrow(compare, PAIRS), k)


def descend(best: DataFrame, reps: DataFrame, k, rows_per_task=400_000) -> DataFrame:
    """One round: rows that share a neighbour, or are one's neighbours, are compared.

    A row's list goes both ways; of the rows that name it, the ``k`` nearest count.
    """
    forward = best.select(F.col("_rep").alias("_v"), F.col("_nbr").alias("_rep"))
    reverse = _smallest(best.withColumnRenamed("_nbr", "_v"), ["_v"], ["_d", "_rep"], k).select(
        "_v", "_rep")
    own = reps.select(F.col("_rep").alias("_v"), "_rep")
    members = forward.unionByName(reverse).unionByName(own).distinct()
    # a list is at most 1 + 2 k rows; a task streams them and holds one
    lists = members.join(reps.select("_rep", "_f"), "_rep").select("_v", "_rep", "_f")
    tasks = max(1, -(-lists.count() // rows_per_task))
    sorted_lists = lists.repartition(tasks, "_v").sortWithinPartitions("_v", "_rep")

    def compare(batches):
        held = None  # the rows of a list that may go on in the next batch

        def search(table):
            which, ids, x = (*(table.column(c).to_numpy() for c in ("_v", "_rep")), _vectors(table))
            ends = np.flatnonzero(np.diff(which)) + 1
            for rows in np.split(np.arange(len(ids)), ends):
                d = distances(x[rows], x[rows])
                np.fill_diagonal(d, np.inf)
                i, j = _pick(ids[rows], d, k)
                yield _pairs(ids[rows][i], ids[rows][j], d[i, j])

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            which = table.column("_v").to_numpy()
            full = int(np.flatnonzero(which != which[-1])[-1]) + 1 if (which != which[-1]).any() else 0
            if full:
                yield from search(table.slice(0, full))
            held = table.slice(full)
        if held is not None:
            yield from search(held)

    found = sorted_lists.mapInArrow(compare, PAIRS)
    return _merge(found.unionByName(best), k)


def knn_lsh(df: DataFrame, k=10, key="id", features="features", seed=42, orders=6, block=128,
            rounds=2, wide=40) -> DataFrame:
    """The k nearest other rows found for each row: (key, nbr, distance, rank).

    Distances are exact, the choice is approximate; ``graph.knn_features`` is the exact
    form.  ``orders``, ``block``, ``rounds`` and ``wide``, the length of the lists during
    the search, trade work for recall.  Equal vectors are searched once and listed
    exactly; ties go to the smaller id.
    """
    rows, reps = distinct_vectors(df, k, key, features)
    wide = max(k, wide)
    best = stored(sorted_orders(reps, wide, orders, block, seed))
    for _ in range(rounds):
        last, best = best, stored(descend(best, reps, wide))
        discard(last)
    return list_neighbours(rows, reps, _smallest(best, ["_rep"], ["_d", "_nbr"], k).drop("_rn"), k, key)
