"""Clusters by n-simplex bounds against plain exact rounds and SQL."""

import hashlib
import math

import numpy as np
import pytest

from compare import compare
from graticule.llm import checks, simplex_clusters
from graticule.llm.queries import QUERIES


def plain(rows, k=8, rounds=10, width=64):
    """The contract in exact integers, one vector at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (
        r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def assign(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(assign(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(column) // len(vs) for column in zip(*vs)]
    found = [(i, assign(v)) for i, v in kept]
    inertia = {}
    for _, (d, n) in found:
        inertia[n] = inertia.get(n, 0) + d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), text[n]) for i, (d, n) in found), key=str)


def test_sql_on_the_given_table(spark, small, duck):
    ok, message = compare(
        spark, duck, QUERIES["op13_simplex_clusters"], checks.CENTROIDS, small)
    assert ok, message


def test_awkward_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + 0.2 * rng.normal(size=64)).tolist()) for i in range(120)]
    rows += [(3, rows[3][1]), (3, rows[7][1]), (None, rows[9][1]), (None, rows[10][1]), (200, None),
             (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64),
             (205, [float("inf")] * 64), (206, [0.0] * 64), (207, [-0.0] * 64), (208, [1.0] * 65)]
    df = spark.createDataFrame(
        [(i, v, 1, "x") for i, v in rows],
        "vec_id bigint, embedding array<double>, cluster int, _v string")
    for k, pivots in ((8, 16), (3, 2), (8, 1)):
        trace = []
        found = simplex_clusters.cluster(df, k=k, pivots=pivots, trace=trace)
        assert sorted(map(tuple, found.collect()), key=str) == plain(rows, k)
    assert trace


def test_few_and_equal_vectors(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert simplex_clusters.cluster(spark.createDataFrame([], schema)).count() == 0
    for rows in ([(1, [0.5] * 64)], [(i, [0.25] * 64) for i in range(20)],
                 [(i, [float(i)] * 64) for i in range(5)]):
        found = simplex_clusters.cluster(spark.createDataFrame(rows, schema))
        assert sorted(map(tuple, found.collect()), key=str) == plain(rows)


def test_beyond_a_long(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        simplex_clusters.cluster(df).count()


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(8, 64)) * 3000
    vectors = np.floor(np.repeat(centres, 100, 0) + 100 * rng.normal(size=(800, 64))).astype(np.int64)
    centroids = np.floor(centres).astype(np.int64)
    base = simplex_clusters.Base(vectors[::50])
    assert 2 <= len(base.pivots) <= 16
    apexes = base.apexes(base.distances(vectors))
    points = base.apexes(base.distances(centroids))
    exact = np.stack([simplex_clusters.squared(vectors, c) for c in centroids], axis=1)
    lower, upper = simplex_clusters.bounds(apexes, points)
    assert (lower <= exact).all() and (exact <= upper).all()
    cluster, distance, compared = simplex_clusters.nearest(vectors, apexes, centroids, points)
    assert (cluster == exact.argmin(1)).all() and (distance == exact.min(1)).all()
    assert compared < 800 * 8 / 2
