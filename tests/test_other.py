"""Climate, graph, spatial statistics, sources and models on small inputs."""

import datetime
import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from graticule.functions.special import gamma_cdf, normal_quantile
from graticule.operators import cells, climate, graph, joins, models, spatial
from graticule.operators.aggregates import hazard_stats
from graticule.operators.ranks import hash_rank
from graticule.sources import layers, npy, text


def test_gamma_and_normal():
    assert np.allclose(gamma_cdf([1.0, 2.0, 10.0], [1.0, 1.0, 1.0]), 1 - np.exp([-1.0, -2.0, -10.0]))
    assert np.allclose(gamma_cdf([3.0], [2.0]), 1 - math.exp(-3) * 4)
    assert np.allclose(normal_quantile([0.5, 0.975, 0.001, 0.999]), [0, 1.959963984540054, -3.090232306167813, 3.090232306167813])


def test_published_fire_weather_day(spark):
    row = [(1, datetime.date(2020, 4, 13), 17.0, 42.0, 25.0, 0.0, 46.0)]
    df = spark.createDataFrame(row, "cell long, date date, t double, h double, w double, rain double, lat double")
    got = climate.fire_weather(df).first()
    assert [round(got[c], 1) for c in ("ffmc", "dmc", "dc", "isi", "bui", "fwi")] == [
        87.7, 8.5, 19.0, 10.9, 8.5, 10.1]


def test_fire_codes_survive_a_missing_day(spark):
    day = lambda i: datetime.date(2020, 4, 13) + datetime.timedelta(i)
    rows = [(1, day(0), 17.0, 42.0, 25.0, 0.0, 46.0), (1, day(1), None, 42.0, 25.0, 0.0, 46.0),
            (1, day(2), 20.0, 21.0, 25.0, 2.4, 46.0)]
    schema = "cell long, date date, t double, h double, w double, rain double, lat double"
    got = climate.fire_weather(spark.createDataFrame(rows, schema)).orderBy("date").collect()
    assert got[1]["fwi"] is None and round(got[2]["ffmc"], 1) == 86.2


def test_heatwave_runs_end_with_the_year(spark):
    start = datetime.date(2019, 12, 1)
    days = [start + datetime.timedelta(i) for i in range(62)]
    hot = lambda d: datetime.date(2019, 12, 28) <= d <= datetime.date(2020, 1, 5)
    rows = [(1, d, 30.0 if hot(d) else 10.0) for d in days]
    df = spark.createDataFrame(rows, "cell long, date date, t double")
    got = climate.heatwave_index(df, quantile=0.9).first()["heatwave_days"]
    assert got == 5  # four December days are too few


def test_spei_is_standard(spark):
    rng = np.random.default_rng(4)
    rows = [(c, datetime.date(1950 + y, m, 1), float(rng.gamma(2.0, 3.0)))
            for c in (1, 2) for y in range(60) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "cell long, month date, wb double")
    got = climate.spei(df, offset=0.0).agg(F.avg("spei").alias("m"), F.stddev("spei").alias("s")).first()
    assert abs(got["m"]) < 0.02 and abs(got["s"] - 1) < 0.05


def brute_neighbours(ids, x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    return {i: [(int(b), d[a, j]) for b, j in sorted(
        ((ids[j], j) for j in range(len(ids)) if j != a), key=lambda t: (d[a, t[1]], t[0]))[:k]]
        for a, i in enumerate(ids)}


@pytest.mark.parametrize("block,pivots", [(1024, None), (7, 6)])
def test_neighbours_with_many_copies(spark, block, pivots):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 5)).round(3)
    x[10:50] = x[10]  # a third of the rows are one vector
    ids = rng.permutation(120)
    pdf = pd.DataFrame({"id": ids, "features": list(x)})
    got = graph.knn_features(spark.createDataFrame(pdf), 6, block=block, pivots=pivots).toPandas()
    want = brute_neighbours(ids, x, 6)
    lists = got.sort_values("rank").groupby("id")["nbr"].apply(list)
    assert {i: lists[i] for i in ids} == {i: [b for b, _ in want[i]] for i in ids}


def test_medoids_with_copies(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(150, 3)).round(2)
    x[:60] = x[0]
    group = np.arange(150) % 4 // 3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(150), "features": list(x), "community": group}))
    got = {r["community"]: r["id"] for r in graph.medoids(df, first=2, block=16).collect()}
    for k in (0, 1):
        ids = np.flatnonzero(group == k)
        total = np.sqrt(((x[ids][:, None] - x[ids][None]) ** 2).sum(axis=2)).sum(axis=1).round(9)
        assert got[k] == ids[total.argmin()]


def test_communities_of_two_cliques(spark):
    clique = lambda ids: list(itertools.combinations(ids, 2))
    edges = clique(range(0, 6)) + clique(range(10, 17)) + [(5, 10)]
    nodes = spark.createDataFrame([(i,) for i in [*range(6), *range(10, 17), 99]], "id long")
    links = spark.createDataFrame(edges, "src long, dst long")
    got = {r["id"]: r["community"] for r in graph.communities(nodes, links).collect()}
    assert {got[i] for i in range(6)} == {0} and {got[i] for i in range(10, 17)} == {10} and got[99] == 99


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200)
    links = spark.range(199).selectExpr("id as src", "id + 1 as dst")
    got = graph.connected_components(nodes, links).select("component").distinct().collect()
    assert [r["component"] for r in got] == [0]


def test_local_moran_on_a_small_grid(spark):
    from graticule.operators.distance import knn_coords

    rows = [(r * 12 + c, r, c, float((r < 6) * 5 + (r * 7 + c * 3) % 4)) for r in range(12) for c in range(12)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, x double")
    weights = knn_coords(df, 8, 12)
    got = spatial.local_morans_i(df, weights, permutations=199).toPandas()
    x = df.toPandas().set_index("cell")["x"]
    z = x - x.mean()
    near = weights.toPandas().groupby("cell")["nbr"].apply(lambda s: z[s].mean())
    want = (len(z) - 1) * z * near / (z ** 2).sum()
    assert np.allclose(got.set_index("cell")["local_i"].sort_index(), want.sort_index())
    assert got["p_sim"].between(1 / 200, 0.5 + 1 / 200).all()
    # the top rows are alike, so their middle is a hot spot
    assert got.set_index("cell").loc[2 * 12 + 5, "hotspot"] == 1
    whole = spatial.morans_i(df, weights).first()
    assert abs(whole["morans_i"] - want.sum() / (len(z) - 1)) < 1e-9 and whole["p_norm"] < 1e-6


def test_natural_breaks(spark):
    values = [1.0, 2.0, 2.5, 10.0, 11.0, 12.0, 40.0, 41.0, 44.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    got = spatial.jenks_breaks(df, "x", 3).first()["breaks"]
    assert got == [1.0, 2.5, 12.0, 44.0]
    six = spatial.jenks_breaks(df, "x", 5).first()["breaks"]
    assert len(six) == 6 and six == sorted(six)


def test_published_coverage(spark):
    rows = spark.createDataFrame([(99559, 209691714)], "a long, b long")
    assert rows.select(F.round(F.col("a") / F.col("b") * 100, 2).alias("x")).first()["x"] == 0.05
    small = spark.createDataFrame(
        [("flood", 1, 2), ("flood", 1, None), ("flood", 0, 1), ("flood", 3, 0)],
        "hazard string, region_id int, n int")
    assert hazard_stats(small).first()[1:] == (1, 3, 33.33)


def test_missing_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, -9999.0), (3, 4.0), (4, None)], "cell long, v double")
    got = [r["v"] for r in cells.nan_to_null(df, ["v"], [-9999]).orderBy("cell").collect()]
    assert got == [None, None, 4.0, None]
    code = spark.createDataFrame([(None,), (0,), (3,)], "n int").select(cells.binarize("n").alias("y"))
    assert [r["y"] for r in code.collect()] == [0, 0, 1]


def test_rotation_has_four_turns(spark):
    df = spark.createDataFrame([(0, 1), (1, 2)], "r long, c long")
    turned = df
    for h, w in ((2, 3), (3, 2), (2, 3), (3, 2)):
        turned = cells.rotate_quarter(turned, h, w)
    assert sorted(turned.collect()) == sorted(df.collect())


def test_unknown_names():
    with pytest.raises(ValueError):
        layers.hazard_variables("meteor")
    with pytest.raises(ValueError):
        layers.Registry([("slope", "p", "continuous", "feature")]).check(["slope", "typo"])


def test_npy_source(spark, tmp_path):
    data = np.arange(35, dtype="float32").reshape(7, 5)
    data[2, 3], data[6, 4] = np.nan, -9999
    path = str(tmp_path / "a.npy")
    np.save(path, data)
    got = npy.scan_npy_grid(spark, path, rows_per_task=2, nodata=-9999).toPandas()
    assert len(got) == 35 and got["value"].isna().sum() == 2
    known = got.dropna()
    assert (known["value"] == known["cell"]).all() and (known["cell"] == known["r"] * 5 + known["c"]).all()


def test_ascii_grid(spark, tmp_path):
    path = tmp_path / "a.asc"
    path.write_text("ncols 3\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -1\n1 2 3\n 4 -1 6\n")
    got = text.scan_ascii_grid(spark, str(path)).orderBy("cell").collect()
    assert [r["value"] for r in got] == [1, 2, 3, 4, None, 6]


def test_events_source(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text(
        "event,hazard,starttime,endtime,geometry\n"
        'a,flood,2020-01-02T03:04:05,,"POLYGON ((0 0, 2 0, 2 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 0.5))"\n'
        'b,flood,nonsense,,"LINESTRING (1 1, 2 3)"\nc,fire,,,"POLYGON EMPTY"\n')
    got = text.scan_events_csv(spark, str(path)).orderBy("event").collect()
    assert [r["event"] for r in got] == ["a", "b"]
    assert [len(ring) for ring in got[0]["rings"]] == [4, 4] and got[1]["starttime"] is None
    assert got[1]["rings"][0][1].asDict() == {"x": 2.0, "y": 3.0}


def test_layer_round_trip(spark, tmp_path):
    path = str(tmp_path / "layer")
    df = spark.range(2000).selectExpr("id as cell", "id div 4 as r", "id % 4 as c", "id * 1.5D as value")
    layers.write_layer(df, path, block=100)
    back = spark.read.parquet(path)
    assert back.where("row_block = 2").agg(F.min("r"), F.max("r")).first()[:] == (200, 299)
    assert back.drop("row_block").exceptAll(df.select(*back.drop("row_block").columns)).count() == 0


def test_bucketed_layers_join_without_exchange(spark, tmp_path):
    names = [f"bucketed_{i}" for i in range(4)]
    tables = [layers.save_bucketed(
        spark.range(500).selectExpr("id as cell", f"id * {i + 1} as v{i}"), name, str(tmp_path / name), 4)
        for i, name in enumerate(names)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = joins.align_layers(tables)
        plan = whole._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 3 and "Exchange" not in plan
        assert {tuple(r) for r in whole.collect()} == {(i, i, 2 * i, 3 * i, 4 * i) for i in range(500)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        for name in names:
            spark.sql(f"drop table {name}")


def training(spark):
    rng = np.random.default_rng(8)
    a, b = rng.random(400), rng.random(400)
    pdf = pd.DataFrame({"cell": np.arange(400), "a": a, "b": b, "y": (a + 0.1 * rng.random(400) > 0.6).astype(int)})
    return spark.createDataFrame(pdf)


def test_models_learn_and_rank_features(spark):
    df = training(spark)
    model = models.fit_lr(df, ["a", "b"], C=100.0)
    assert models.score_cells(model, df, keep=("y",)).agg(models.accuracy()).first()[0] > 0.9
    table = {r["variable"]: r["importance"] for r in models.permutation_importance(model, df, ["a", "b"]).collect()}
    assert table["a"] > 0.2 and abs(table["b"]) < 0.05
    forest = models.fit_rf(df, ["a", "b"], trees=10, depth=4)
    ranked = models.feature_importance(spark, forest, ["a", "b"]).orderBy(F.desc("importance")).first()
    assert ranked["variable"] == "a"


def test_shuffled_variables_are_those_of_the_ranking(spark):
    """Each variable moves on by its own distance in one random order; missing values too."""
    df = training(spark).withColumn("b", F.when(F.col("cell") % 7 != 0, F.col("b")))
    seen = []

    class Spy:
        def transform(self, cells):
            seen.append(cells)
            return cells.withColumn("prediction", F.lit(0.0))

    models.permutation_importance(Spy(), df, ["a", "b"], seed=5)
    got = seen[0].toPandas().set_index(["variable", "cell"]).sort_index()
    order = hash_rank(df, 5, "cell", into="k").toPandas().sort_values("k")
    rng = random.Random(5)
    for v in ("a", "b"):
        shift = rng.randrange(1, 400)
        want = pd.Series(np.roll(order[v].to_numpy(), shift), order["cell"].to_numpy()).sort_index()
        rows = got.loc[v]
        assert np.array_equal(rows[v].to_numpy(), want.to_numpy(), equal_nan=True)
        other = "b" if v == "a" else "a"
        plain = order.set_index("cell").sort_index()
        assert np.array_equal(rows[other].to_numpy(), plain[other].to_numpy(), equal_nan=True)
    assert len(seen) == 1 and len(got) == 3 * 400


def test_settings_run_together_as_alone(spark):
    df = training(spark)
    settings = models.random_settings({"regParam": (1e-3, 1.0), "elasticNetParam": [0.0, 1.0]}, 5)
    one, many = (models.param_search(
        LogisticRegression(labelCol="y"), settings, df.where("cell < 300"), df.where("cell >= 300"),
        ["a", "b"], parallelism=k).collect() for k in (1, 5))
    assert one == many and len(one) == 5 and one[0]["val_loss"] == min(r["val_loss"] for r in one)
    assert models.param_search(LogisticRegression(labelCol="y"), [], df, df, ["a"]).count() == 0


def test_random_settings_are_repeatable():
    ranges = {"maxIter": [10, 20], "regParam": (0.0, 1.0)}
    first = models.random_settings(ranges, 5)
    assert first == models.random_settings(ranges, 5) and all(0 <= s["regParam"] <= 1 for s in first)


def test_saved_model_scores_alike(spark, tmp_path):
    df = training(spark)
    model = models.fit_lr(df, ["a", "b"])
    models.save_model(model, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    a = {r["cell"]: r["p"] for r in models.score_cells(model, df).collect()}
    assert a == {r["cell"]: r["p"] for r in models.score_cells(again, df).collect()}


def test_ensemble_of_equal_errors_is_the_mean(spark):
    maps = spark.createDataFrame([(1, "a", 0.2), (1, "b", 0.6), (2, "a", 0.5), (2, "b", None)],
                                 "cell long, model string, p double")
    errors = spark.createDataFrame([("a", 0.1, 0.1), ("b", 0.1, 0.3)], "model string, mae double, mse double")
    got = {r["cell"]: r for r in models.inverse_error_ensemble(maps, errors).collect()}
    assert abs(got[1]["p_mae"] - 0.4) < 1e-12 and abs(got[1]["p_mse"] - 0.3) < 1e-12 and got[2]["p_mae"] == 0.5
