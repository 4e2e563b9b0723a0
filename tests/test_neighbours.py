"""Approximate neighbours: recall against brute force, exact distances, copies, empty tables."""

import numpy as np

from graticule.operators import neighbours


def brute(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    return d, [set(np.lexsort((np.arange(len(x)), row))[:k]) for row in d]


def test_recall_and_distances(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(900, 16))
    clustered = rng.normal(size=(30, 16))[rng.integers(0, 30, 900)] * 4 + rng.normal(size=(900, 16))
    for x in (flat, clustered):
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id bigint, features array<double>, _rep int")
        got = neighbours.knn_lsh(df, 8, block=64).toPandas()
        d, want = brute(x, 8)
        assert len(got) == 900 * 8
        assert np.allclose(got["distance"], d[got["id"], got["nbr"]])
        hits = sum(n in want[i] for i, n in zip(got["id"], got["nbr"]))
        assert hits >= 0.9 * 900 * 8
        ordered = got.sort_values(["id", "rank"])
        assert (ordered.groupby("id")["distance"].diff().fillna(0) >= 0).all()


def test_copies_few_and_none(spark):
    schema = "id bigint, features array<float>"
    assert neighbours.knn_lsh(spark.createDataFrame([], schema)).count() == 0
    one = neighbours.knn_lsh(spark.createDataFrame([(1, [1.0, 2.0])], schema))
    assert one.count() == 0
    rows = [(i, [0.0, 1.0]) for i in range(40)] + [(50, [3.0, 1.0])]
    got = neighbours.knn_lsh(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted((r["nbr"], r["distance"], r["rank"]) for r in got if r["id"] == 50) == [
        (0, 3.0, 1), (1, 3.0, 2), (2, 3.0, 3)]
    assert [r["distance"] for r in got if r["id"] == 7] == [0.0] * 3
