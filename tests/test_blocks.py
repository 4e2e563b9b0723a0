"""Products instead of differences, streamed lists, links shuffled once."""

import numpy as np
import pytest

from graticule.operators import graph, neighbours, spatial


@pytest.mark.parametrize("offset,digits", [(0, 0), (1e6, 1), (0, 9)])
def test_nearest_rows_are_exact(offset, digits):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 6)).round(digits) * 3 + offset
    x[5] = np.nan
    x[6, 2] = np.inf
    ids = np.arange(700)
    d = graph.distances(x, x)
    d[ids, ids] = np.inf
    found = [np.concatenate(c) for c in zip(*graph.nearest_rows(x, x, ids, ids, 7, 100, 150, 60))]
    for row in range(700):
        near = [j for j in np.lexsort((ids, d[row])) if np.isfinite(d[row, j])][:7]
        at = found[0] == row
        assert found[1][at].tolist() == near
        assert (found[2][at] == d[row, near]).all()


def test_near_distances_keep_their_bound():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(200, 8)) + 50, rng.normal(size=(50, 8)) * 1e-7 + 50])
    got = np.concatenate([d for _, d in graph._near_distances(x, x, 64)])
    want = graph.distances(x, x)
    assert (np.abs(got - want) <= graph.NEAR / 2 * want).all()


def test_medoids_leave_out_rows_without_community(spark):
    rows = [(i, [float(i % 5), 1.0], 1 if i < 9 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "id bigint, features array<double>, community bigint")
    got = graph.medoids(df).collect()
    assert [(r["community"], r["id"], r["members"]) for r in got] == [(1, 2, 9)]


def test_lists_are_streamed(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(150, 4)))], "_rep bigint, _f array<double>")
    best = neighbours.sorted_orders(df, 5, 2, 16, 1)
    best = spark.createDataFrame(best.collect(), best.schema)  # its blocks depend on the batches
    one = neighbours.descend(best, df, 5)
    assert "collect_list" not in one._jdf.queryExecution().toString()
    whole = sorted(map(tuple, one.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(tuple, neighbours.descend(best, df, 5, 40).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pair_sums_meet_as_in_a_join(spark):
    rows = [(1, 2, 0.5), (1, 2, 0.25), (2, 1, 0.5), (2, 3, 1.0), (4, 4, 2.0), (4, 4, 1.0), (None, 5, 3.0), (5, None, 1.0)]
    weights = spark.createDataFrame(rows, "cell bigint, nbr bigint, w double")
    s0 = s1 = 0.0
    for a, b, w in rows:
        back = [v for c, d, v in rows if a is not None and b is not None and (c, d) == (b, a)] or [0.0]
        s0 += w * len(back)
        s1 += sum(w * w + w * v for v in back)
    assert tuple(spatial._pair_sums(weights).first()) == (s0, s1)
    assert "Join" not in spatial._pair_sums(weights)._jdf.queryExecution().toString()


def test_links_are_dealt_by_number(spark, monkeypatch):
    values = spark.range(40).selectExpr("id as cell", "cast(id % 7 as double) as x")
    weights = spark.range(40).selectExpr("id as cell", "(id + 1) % 40 as nbr", "1D as w")
    whole = sorted(map(tuple, spatial._lagged(values, weights, "x").collect()))
    monkeypatch.setattr(spatial, "LINKS", 5, raising=False)
    dealt = spatial._lagged(values, weights, "x")
    assert "RepartitionByExpression [cell" in dealt._jdf.queryExecution().toString()
    assert sorted(map(tuple, dealt.collect())) == whole
