"""Empty, constant and one-row inputs, gaps, and the former limits."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.functions import geometry, scaling
from graticule.operators import (
    aggregates, climate, distance, graph, joins, models, modularity, rasterize, resample, spatial)


def test_hazard_without_region(spark):
    df = spark.createDataFrame([("a", 0, 1), ("b", 1, 1), ("b", 1, 0)], "hazard string, region_id int, n int")
    got = {r["hazard"]: r["hazard_coverage"] for r in aggregates.hazard_stats(df).collect()}
    assert got == {"a": None, "b": 50.0}


def test_centroids(spark):
    ring = lambda *p: "array(" + ",".join(f"named_struct('x', {x}D, 'y', {y}D)" for x, y in p) + ")"
    flat = ring((0, 0), (2, 0), (4, 0), (0, 0))
    square = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
    hole = ring((0, 0), (0, 2), (2, 2), (2, 0), (0, 0))
    row = spark.range(1).select(
        geometry.centroid(F.expr(flat)).alias("a"),
        geometry.centroid_of_rings(F.array(F.expr(square), F.expr(hole))).alias("b")).first()
    assert tuple(row["a"]) == (1.5, 0.0)
    want = (16 * 2 - 4 * 1) / 12
    assert row["b"]["x"] == pytest.approx(want) and row["b"]["y"] == pytest.approx(want)


def test_exact_member(spark):
    maps = spark.createDataFrame(
        [("a", 1, 0.2), ("b", 1, 0.8), ("b", 2, 0.5)], "model string, cell int, p double")
    errors = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.1, 0.2)], "model string, mae double, mse double")
    got = {r["cell"]: r["p_mae"] for r in models.inverse_error_ensemble(maps, errors).collect()}
    assert got == {1: 0.2, 2: 0.5}


def test_constant_residuals(spark):
    values = spark.createDataFrame([(i, 1.0) for i in range(4)], "cell bigint, x double")
    weights = spark.createDataFrame([(i, (i + 1) % 4, 1.0) for i in range(4)], "cell bigint, nbr bigint, w double")
    assert spatial.morans_i(values, weights).first()["morans_i"] is None
    local = spatial.local_morans_i(values, weights, k=1).collect()
    assert len(local) == 4 and all(r["p_sim"] is None for r in local)
    one = spatial.morans_i(values.limit(1), weights).collect()
    assert one[0]["z_norm"] is None


def test_densities(spark):
    df = spark.createDataFrame(
        [("a", 0.1), ("a", 0.9), ("a", 3.0), ("one", 0.5), ("same", 0.3), ("same", 0.3)], "k string, v double")
    rows = aggregates.kde_1d(df, "v", 0.0, 1.0, points=5, keys=["k"]).collect()
    got = {(r["k"], round(r["x"], 6)): r["density"] for r in rows}
    v = np.array([0.1, 0.9, 3.0])
    h = v.std(ddof=1) * 3 ** -0.2
    for x in (0.0, 0.5, 1.0):
        want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (3 * h * math.sqrt(2 * math.pi))
        assert got["a", x] == pytest.approx(want)
        assert got["one", x] is None and got["same", x] is None
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert aggregates.kde_2d(same, "x", "y").count() == 0
    assert aggregates.kde_2d(same.limit(0), "x", "y").count() == 0


@pytest.mark.parametrize("tolerance", [1e-3, 1e-6, 1e-11])
def test_density_within_tolerance(spark, tolerance):
    """Skewed values, far ones, few and equal ones, empty tables."""
    rng = np.random.default_rng(4)
    sets = {"normal": rng.normal(0.4, 0.2, 3000), "skewed": rng.lognormal(-2, 1.5, 2000),
            "far": np.append(rng.normal(0.5, 0.1, 50), [1e6, -1e6]), "narrow": rng.normal(0.5, 1e-4, 300),
            "two": np.array([0.1, 0.9]), "outside": rng.normal(90, 0.1, 100), None: rng.uniform(0, 1, 400)}
    rows = [(k, float(v)) for k, vs in sets.items() for v in vs]
    rows += [("one", 0.5), ("same", 0.3), ("same", 0.3), ("same", None), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    out = aggregates.kde_1d_within(df, "v", 0.0, 1.0, 41, tolerance, ["k"]).collect()
    assert len(out) == 41 * (len(sets) + 2)
    got = {(r["k"], round(r["x"] * 40)): r["density"] for r in out}
    for k, v in sets.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        peak = 1 / (h * math.sqrt(2 * math.pi))
        for i in range(41):
            want = np.exp(-0.5 * ((i / 40 - v) / h) ** 2).mean() * peak
            assert abs(got[k, i] - want) <= tolerance * peak + 1e-13 * peak, (k, i)
    assert got["one", 0] is None and got["same", 3] is None
    v = sets["normal"]
    alone = df.where("k = 'normal'").select("v")
    plain = aggregates.kde_1d_within(alone, "v", 0.0, 1.0, 41, tolerance).collect()
    assert len(plain) == 41
    for r in plain:
        assert r["density"] == pytest.approx(got["normal", round(r["x"] * 40)], abs=1e-9)
    assert aggregates.kde_1d_within(df.limit(0), "v", 0.0, 1.0, keys=["k"]).count() == 0


def test_yeo_johnson_outside_first_bracket(spark):
    rng = np.random.default_rng(1)
    x = 30 - rng.exponential(1.0, 400)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lam = scaling.yeo_johnson(df, "v").first()["lambda"]
    assert lam > 3

    def score(lam):
        t = ((x + 1) ** lam - 1) / lam
        return -len(x) / 2 * math.log(t.var()) + (lam - 1) * np.log1p(x).sum()

    assert score(lam) >= max(score(lam - 0.01), score(lam + 0.01))
    for flat in (df.limit(0), df.limit(1)):
        assert all(r["lambda"] is None for r in scaling.yeo_johnson(flat, "v").collect())


def test_codes(spark):
    df = spark.createDataFrame([("b", 3), ("a", 1), ("c", 2), (None, 0), ("a", 9)], "k string, o int")
    assert {r["k"]: r["code"] for r in scaling.label_encode(df, "k").collect()} == {
        "a": 0, "b": 1, "c": 2, None: None}
    assert {r["k"]: r["code"] for r in scaling.code_first_seen(df, "k", "o").collect()} == {
        "a": 1, "c": 2, "b": 3, None: None}
    assert scaling.label_encode(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("share", [0.02, 0.3])
def test_distance_with_gaps(spark, share):
    rng = np.random.default_rng(5)
    cells = [(r * 70 + c, r, c, bool(rng.random() < share)) for r in range(75) for c in range(70)
             if rng.random() < 0.4 and not 20 < c < 28]
    df = spark.createDataFrame(cells, "cell bigint, r int, c int, hit boolean")
    got = {r["cell"]: r["distance"] for r in distance.nearest_distance(df, "hit").collect()}
    hits = np.array([(r, c) for _, r, c, h in cells if h])
    for cell, r, c, _ in cells:
        assert got[cell] == pytest.approx(np.sqrt(((hits - (r, c)) ** 2).sum(1).min()))


def test_coarse_target_uses_all_source_cells(spark):
    rows = [(r, c, 1.0 if (r, c) == (2, 6) else 0.0) for r in range(8) for c in range(8)]
    source = spark.createDataFrame(rows, "r int, c int, v double")
    target = spark.createDataFrame([(r * 2 + c, r, c) for r in range(2) for c in range(2)],
                                   "cell bigint, r int, c int")
    for method in ("bilinear", "cubic", "cubic_spline"):
        out = resample.resample_grid(source, target, method, (0.0, 0.0, 1.0), (0.0, 0.0, 4.0), "v")
        assert sum(abs(r["v"]) for r in out.collect()) > 0.01, method
    flat = resample.resample_grid(source.withColumn("v", F.lit(3.0)), target, "cubic",
                                  (0.0, 0.0, 1.0), (0.0, 0.0, 4.0), "v")
    assert [round(r["v"], 9) for r in flat.collect()] == [3.0] * 4


def test_drought_over_a_calendar_gap(spark):
    df = spark.sql("""select 1 as cell, to_date(m) as month, s as spei from values
        ('2000-01-01', -3.0), ('2000-02-01', -3.0), ('2000-09-01', 0.0) t(m, s)""")
    assert climate.drought_index(df).first()["drought_months"] == 2


def test_dedupe_keeps_the_first(spark):
    df = spark.createDataFrame([(2, "p", "b"), (1, "p", "c"), (3, "q", "a")], "i int, g string, v string")
    got = sorted(tuple(r) for r in joins.dedupe_geometry(df, "g", ["i"]).collect())
    assert got == [(1, "p", "c"), (3, "q", "a")]


def test_stack_keeps_every_label(spark):
    label = spark.createDataFrame([(i, i % 2) for i in range(20)], "cell bigint, y int")
    a = spark.createDataFrame([(i, 0.1 * (i % 7)) for i in range(15)], "cell bigint, p double")
    _, frame = models.stack_meta({"a": a}, label)
    assert frame.count() == 20 and frame.where("cell = 19").first()["a"] == 0.0


def modularity_scan(edges, groups):
    """Modularity times W * W, and whether one node's move or one merge raises it."""
    weight, degree, total = {}, {}, {}
    for a, b in edges:
        if a != b:
            for x, y in ((a, b), (b, a)):
                weight.setdefault(x, {}).setdefault(y, 0)
                weight[x][y] += 1
                degree[x] = degree.get(x, 0) + 1
    W = sum(degree.values())
    for i, k in degree.items():
        total[groups[i]] = total.get(groups[i], 0) + k
    into = {i: {} for i in weight}
    between = {}
    for i, near in weight.items():
        for j, w in near.items():
            into[i][groups[j]] = into[i].get(groups[j], 0) + w
            pair = groups[i], groups[j]
            between[pair] = between.get(pair, 0) + w
    raising = 0
    for i, near in into.items():
        k, own = degree[i], groups[i]
        stay = W * near.get(own, 0) - k * (total[own] - k)
        raising += sum(W * w - k * total[c] > stay for c, w in near.items() if c != own) + (stay < 0)
    merges = sum(W * w > total[a] * total[b] for (a, b), w in between.items() if a != b)
    inside = sum(w for (a, b), w in between.items() if a == b)
    return W * inside - sum(k * k for k in total.values()), raising, merges


def test_no_move_raises_modularity(spark):
    rng = np.random.default_rng(11)
    chain = [(i, i + 1) for i in range(59)]
    planted = [(int(a), int(b)) for a, b in rng.integers(0, 90, (2500, 2))
               if rng.random() < (0.5 if a // 15 == b // 15 else 0.02)]
    star = [(0, i) for i in range(1, 40)] + [(1, 2), (3, 4)]
    for edges, n in ((chain, 60), (planted + [(5, 5)], 90), (star, 41)):
        trace = []
        got = {r["id"]: r["community"] for r in graph.communities(
            spark.range(n), spark.createDataFrame(edges, "src long, dst long"), trace=trace).collect()}
        value, raising, merges = modularity_scan(edges, got)
        assert raising == 0 and merges == 0 and value > 0 and len(got) == n
        for c in set(got.values()):  # connected, and named after the smallest member
            members = {i for i in got if got[i] == c}
            seen, queue = {c}, [c]
            while queue:
                i = queue.pop()
                for a, b in edges:
                    for x, y in ((a, b), (b, a)):
                        if x == i and y in members and y not in seen:
                            seen.add(y)
                            queue.append(y)
            assert seen == members and min(members) == c
    assert len({got[i] for i in range(1, 40)}) < 39
    plain = graph.communities(spark.range(3), spark.createDataFrame([], "src long, dst long"))
    assert {tuple(r) for r in plain.collect()} == {(0, 0), (1, 1), (2, 2)}


def test_rounds_without_a_move_are_few(spark, monkeypatch):
    """One round shows that no node moves, and communities that stay are not merged again."""
    counts = {"rounds": 0, "settled": 0, "merges": 0}

    def counted(name, key):
        old = getattr(modularity, name)

        def run(*args, **kwargs):
            counts[key] += 1
            return old(*args, **kwargs)
        monkeypatch.setattr(modularity, name, run)

    for name, key in (("_best_moves", "rounds"), ("settle", "settled"), ("merge", "merges")):
        counted(name, key)
    clique = lambda ids: [(a, b) for a in ids for b in ids if a < b]
    edges = clique(range(0, 6)) + clique(range(10, 17)) + [(5, 10)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 17), 99]], "id long")
    trace = []
    got = {r["id"]: r["community"] for r in graph.communities(
        nodes, spark.createDataFrame(edges, "src long, dst long"), trace=trace).collect()}
    assert got == {**{i: 0 for i in range(6)}, **{i: 10 for i in range(10, 17)}, 99: 99}
    assert counts["rounds"] - len(trace) <= counts["settled"] and counts["merges"] == 1, (counts, trace)


def test_a_node_bound_by_its_name_leaves(spark):
    """Node 0 names its community and is better off alone: the other name sets it free."""
    links = spark.createDataFrame(
        [(1, 2, 9), (2, 1, 9), (0, 7, 1), (7, 0, 1)], "src long, dst long, w long")
    state = spark.createDataFrame(
        [(0, 0, 1), (1, 0, 9), (2, 0, 9), (7, 7, 60)], "id long, com long, k long")
    got, moved = modularity.settle(links, state, 38)
    coms = {r["id"]: r["com"] for r in got.collect()}
    assert moved and coms[0] not in (coms[1], coms[7]) and coms[1] == coms[2]


def brute_force_breaks(values, classes):
    """(least squared deviation, breaks) over all partitions of the sorted values."""
    v, n = np.unique(values, return_counts=True)
    x = v - values.mean()
    cn, cs, cq = (np.concatenate([[0.0], np.cumsum(n * x ** k)]) for k in range(3))
    best, cuts = np.full((classes + 1, len(v) + 1), np.inf), np.zeros((classes + 1, len(v) + 1), int)
    best[0, 0] = 0.0
    for j in range(1, len(v) + 1):
        total = best[:-1, :j] + cq[j] - cq[:j] - (cs[j] - cs[:j]) ** 2 / (cn[j] - cn[:j])
        cuts[1:, j] = total.argmin(axis=1)
        best[1:, j] = total.min(axis=1)
    breaks, j = [], len(v)
    for k in range(classes, 0, -1):
        breaks.append(v[j - 1])
        j = cuts[k, j]
    return best[classes, -1], [v[0]] + breaks[::-1]


def test_breaks_beyond_the_bins(spark):
    """Exact for more values than bins: skewed, even, clustered and rounded ones."""
    rng = np.random.default_rng(8)
    tables = {
        "skewed": np.concatenate([rng.exponential(0.01, 380), rng.random(40)]),
        "even": rng.random(400),
        "clustered": np.concatenate([rng.normal(k, 0.02, 90) for k in (0, 1, 1.1, 7)]) * 1e6 + 1e9,
        "repeated": np.round(rng.gamma(0.5, 40, 3000)),
    }
    for name, values in tables.items():
        df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(4)
        for classes, bins in ((4, 24), (2, 3)) if name == "skewed" else ((7, 64),):
            got = spatial.jenks_breaks(df, "v", classes, bins=bins).first()["breaks"]
            assert got == brute_force_breaks(values, classes)[1], (name, classes, bins)


def test_breaks_of_many_values(spark):
    values = np.random.default_rng(9).exponential(1.0, 20000) ** 3
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    got = spatial.jenks_breaks(df, "v", 5).first()["breaks"]
    assert got == brute_force_breaks(values, 5)[1]


def test_draws_are_one_rule():
    for size in (3, 9, 30, 8991):
        picks = spatial._draws(size, 50, 8, 42)
        assert picks.shape == (50, 9) and picks.max() < size
        if size >= 9:
            assert all(len(set(row)) == 9 for row in picks.tolist())


def test_long_outline(spark):
    n = 100_000
    turn = [2 * math.pi * i / n for i in range(n)]
    ring = [(100 + math.cos(t) * (60 + 30 * math.sin(i * 0.02)), 100 + math.sin(t) * (60 + 30 * math.sin(i * 0.02)))
            for i, t in enumerate(turn)]
    star = spark.createDataFrame(
        [(1, [[*ring, ring[0]]])], "id int, rings array<array<struct<x:double,y:double>>>")
    twice = star.union(star)
    cells = rasterize.centre_cells(twice, ["id"], height=200, width=200)
    got = {(r["r"], r["c"]) for r in cells.collect()}
    assert cells.count() == len(got)
    # every centre within the inner circle is inside, none beyond the outer one
    far = lambda r, c: math.hypot(r - 99.5, c - 99.5)
    inner = {(r, c) for r in range(200) for c in range(200) if far(r, c) < 30}
    assert inner <= got and max(far(r, c) for r, c in got) < 91


def test_filters_and_columns_reach_the_scan(spark, small, capsys):
    from graticule.sources.layers import scan_layer

    layer = scan_layer(spark, f"{small}/orders.parquet", "o_totalprice", "o_orderkey", 150,
                       where=F.col("o_totalprice") > 250000)
    layer.explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThan(o_totalprice,250000" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan
