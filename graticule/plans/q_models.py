"""Queries: models, importances, ensembles; writing and reading tables."""

import os
import uuid

from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from graticule.functions.scaling import minmax_scale, target_scale
from graticule.operators import evaluation as E
from graticule.operators import joins
from graticule.operators import models as M
from graticule.operators.aggregates import region_stats
from graticule.plans import fixtures as X
from graticule.plans.catalog import query
from graticule.plans.q_evaluation import COMPARISON
from graticule.session import scratch_folder
from graticule.sources import layers as L
from graticule.sources import npy, text

VARS = ["price", "cust", "age", "prio"]


def ml_grid(spark, d):
    """Scaled features, label and split per cell."""
    f = minmax_scale(X.features(spark, d), VARS)
    s = X.split(spark, d).select("cell", "r", "c", "v", "split")
    return f.join(s, "cell").withColumn("v", F.col("v") - 50000)


def sets(spark, d):
    grid = ml_grid(spark, d)
    return grid.where(F.col("split").isin(1, 2)), grid.where(F.col("split") == 3)


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("train_frame", """
select g.cell, s.split, coalesce(cast(g.n > 0 as integer), 0) as y, coalesce(f.price, 0.0) as price,
  f.cust, case when s.split = 3 then 'test' else 'train' end as set
from g_missing g join split s on g.cell = s.cell
join (select cell, case when prio > 1 then price end as price, cust from features) f
on g.cell = f.cell where g.v is not null and s.split > 0""", ["g_missing", "split", "features"])
def train_frame(spark, d):
    f = X.features(spark, d).select(
        "cell", F.when(F.col("prio") > 1, F.col("price")).alias("price"), "cust")
    cells = X.g_missing(spark, d).join(X.split(spark, d).select("cell", "split"), "cell").join(f, "cell")
    return M.train_frame(cells, ["price", "cust"], "v", "n")


def fitted_scores(fit):
    def run(spark, d):
        train, test = sets(spark, d)
        return M.score_cells(fit(train), test, keep=("y",))
    return run


query("fit_lr")(fitted_scores(lambda t: M.fit_lr(t, VARS)))
query("fit_rf")(fitted_scores(lambda t: M.fit_rf(t, VARS)))
query("fit_mlp")(fitted_scores(lambda t: M.fit_mlp(t, VARS)))


@query("fit_rf_reg")
def fit_rf_reg(spark, d):
    train, test = sets(spark, d)
    target = target_scale(train, "v", "target")
    return M.score_cells(M.fit_rf_reg(target, ["cust", "age", "prio"], "target"), test)


@query("fit_patch_model")
def fit_patch_model(spark, d):
    frame = M.patch_frame(ml_grid(spark, d), VARS)
    model = M.fit_patch_model(frame.where(F.col("split").isin(1, 2)))
    return M.score_cells(model, frame.where(F.col("split") == 3), keep=("y",))


MODEL_CHECKS = ["fit_lr", "fit_mlp", "fit_patch_model", "fit_rf", "fit_rf_reg", "feature_importance",
                "hazard_map", "save_load_model"]


@query("model_checks", "select model, true as ok from (values "
       + ", ".join(f"('{m}')" for m in MODEL_CHECKS) + ") t(model)")
def model_checks(spark, d):
    """What must hold for any fitted model: optimum, floors of accuracy, ranges, round trip."""
    grid = M.spread(ml_grid(spark, d))
    train, test = grid.where(F.col("split").isin(1, 2)), grid.where(F.col("split") == 3)
    ok = {}
    lr = M.fit_lr(train, VARS)
    scored = M.score_cells(lr, train, keep=("y", *VARS))
    off = F.col("p") - F.col("y")
    coefficients = lr.stages[-1].coefficients.toArray()
    slopes = scored.agg(F.sum(off).alias("b"), F.count(F.lit(1)).alias("n"),
                        *[F.sum(off * F.col(v)).alias(v) for v in VARS]).first()
    # at the optimum the loss has no slope left, the penalty's included
    gradient = [slopes["b"]] + [slopes[v] + c for v, c in zip(VARS, coefficients)]
    ok["fit_lr"] = max(abs(g) for g in gradient) < 0.01 * slopes["n"]

    def area(model, cells):
        rows = M.score_cells(model, cells, keep=("y",)).withColumn("model", F.lit("m"))
        return E.auroc(E.cumulative_curve(rows)).first()["auroc"]

    ok["fit_mlp"] = area(M.fit_mlp(train, VARS), test) > 0.8
    forest = M.fit_rf(train, VARS)
    ok["fit_rf"] = area(forest, test) > 0.9
    shares = [r["importance"] for r in M.feature_importance(spark, forest, VARS).collect()]
    ok["feature_importance"] = abs(sum(shares) - 1) < 1e-9 and min(shares) >= 0
    frame = M.patch_frame(grid, VARS)
    patch = M.fit_patch_model(frame.where(F.col("split").isin(1, 2)))
    ok["fit_patch_model"] = area(patch, frame.where(F.col("split") == 3)) > 0.7
    target = target_scale(train, "v", "target")
    ends = target.agg(F.min("target"), F.max("target")).first()
    found = M.score_cells(M.fit_rf_reg(target, ["cust", "age", "prio"], "target"), test).agg(
        F.min("p"), F.max("p")).first()
    ok["fit_rf_reg"] = ends[0] <= found[0] <= found[1] <= ends[1]
    world = M.hazard_map(lr, grid, VARS, "v").join(grid.select("cell", "v"), "cell")
    ok["hazard_map"] = world.where(F.col("p").isNull() != (F.coalesce("v", F.lit(0.0)) <= 0)).isEmpty()
    path = os.path.join(scratch_folder(spark), f"model-{uuid.uuid4().hex}")
    M.save_model(lr, path)
    again = M.score_cells(M.load_model(path), test).withColumnRenamed("p", "q")
    ok["save_load_model"] = M.score_cells(lr, test).join(again, "cell").where("p <> q").isEmpty()
    grid.unpersist()
    return spark.createDataFrame([(m, bool(ok[m])) for m in MODEL_CHECKS], "model string, ok boolean")


@query("score_cells", """
with lim as (select min(price) as p0, max(price) - min(price) as p1, min(prio) as q0,
  max(prio) - min(prio) as q1 from features)
select f.cell, round(1 / (1 + exp(-(4 * (price - p0) / p1 - 6 * (prio - q0) / q1))), 9) as p
from features f, lim, split s where f.cell = s.cell and s.split = 3""", ["features", "split"])
def score_cells(spark, d):
    import numpy as np
    weights = np.array([4.0, -6.0])
    predict = lambda x: 1 / (1 + np.exp(-(x @ weights)))
    test = sets(spark, d)[1]
    return rounded(M.score_foreign(predict, test, ["price", "prio"]), "p", digits=9)


@query("hazard_map")
def hazard_map(spark, d):
    grid = ml_grid(spark, d)
    model = M.fit_lr(grid.where(F.col("split").isin(1, 2)), VARS)
    return M.hazard_map(model, grid, VARS, "v")


@query("save_load_model")
def save_load_model(spark, d):
    train, test = sets(spark, d)
    path = os.path.join(scratch_folder(spark), f"model-{uuid.uuid4().hex}")
    M.save_model(M.fit_lr(train, VARS), path)
    return M.score_cells(M.load_model(path), test)


@query("feature_importance")
def feature_importance(spark, d):
    return M.feature_importance(spark, M.fit_rf(sets(spark, d)[0], VARS), VARS)


@query("permutation_importance")
def permutation_importance(spark, d):
    train, test = sets(spark, d)
    return M.permutation_importance(M.fit_rf(train, VARS), test, VARS)


@query("param_search")
def param_search(spark, d):
    grid = ml_grid(spark, d)
    part = lambda k: grid.where(F.col("split") == k)
    settings = M.random_settings({"regParam": (1e-4, 1.0), "elasticNetParam": [0.0, 0.5, 1.0]}, 8)
    return M.param_search(LogisticRegression(labelCol="y"), settings, part(1), part(2), VARS)


@query("inverse_error_ensemble", """
with e as (select model, avg(abs(y - p)) as mae, avg((y - p) * (y - p)) as mse from scores_multi
  group by 1)
select cell, round(sum(p / mae) / sum(1 / mae), 9) as p_mae,
  round(sum(p / mse) / sum(1 / mse), 9) as p_mse
from scores_multi s join e on s.model = e.model group by 1""", ["scores_multi"])
def inverse_error_ensemble(spark, d):
    scores = X.scores_multi(spark, d)
    out = M.inverse_error_ensemble(scores, E.error_metrics(scores))
    return rounded(out, "p_mae", "p_mse", digits=9)


@query("stack_meta")
def stack_meta(spark, d):
    scores = X.scores_multi(spark, d)
    maps = {m: scores.where(F.col("model") == m) for m in ("direct", "square", "reverse")}
    model, frame = M.stack_meta(maps, X.scores(spark, d).select("cell", "y"))
    return M.score_cells(model, frame)


@query("linear_multi_hazard", """
with s as (select min(price) as p0, max(price) as p1, min(age) as a0, max(age) as a1 from features)
select f.cell, case when g.v is not null then cast((price - p0) / (p1 - p0) >= 0.5 as integer)
  + cast((age - a0) / (a1 - a0) >= 0.3 as integer) end as n_hazards
from features f join g_missing g on f.cell = g.cell, s""", ["features", "g_missing"])
def linear_multi_hazard(spark, d):
    cells = X.features(spark, d).join(X.g_missing(spark, d).select("cell", "v"), "cell")
    return M.linear_multi_hazard(cells, {"price": 0.5, "age": 0.3}, "v")


# --- sinks and the sources that read what they wrote --------------------------------------

def new_path(spark, name):
    return os.path.join(scratch_folder(spark), f"{name}-{uuid.uuid4().hex}")


@query("write_layer", "select cell, r, c, v as value from g", ["g"])
def write_layer(spark, d):
    path = new_path(spark, "layer")
    L.write_layer(X.g(spark, d).select("cell", "r", "c", F.col("v").alias("value")), path)
    return spark.read.parquet(path).select("cell", "r", "c", "value")


METRIC_ROWS = f"""
select model, 'run' as experiment, accuracy, precision, recall, f1, auroc, ap, mae, best_threshold
from ({COMPARISON})"""


@query("append_metrics", f"select * from ({METRIC_ROWS}) union all select * from ({METRIC_ROWS})",
       ["curve", "best"])
def append_metrics(spark, d):
    path = new_path(spark, "metrics")
    rows = rounded(E.model_comparison(X.scores_multi(spark, d)), "auroc", "ap", "mae", digits=9)
    for _ in range(2):
        L.append_metrics(rows.withColumn("experiment", F.lit("run")), path)
    return L.read_metrics(spark, path)


REPORT = "region_id bigint, n_hazard_pixels bigint, n_pixel bigint, hazard_coverage double"
REPORT_SQL = """
select region_id, count(*) filter (n > 0) as n_hazard_pixels, count(*) as n_pixel,
  count(*) filter (n > 0) / count(*) * 100 as hazard_coverage
from hazards where region_id <> 0 group by 1"""


def report(spark, d):
    path = new_path(spark, "report")
    L.write_json_report(region_stats(X.hazards(spark, d), ()), path)
    return path


@query("write_json_report", f"""
select region_id, n_pixel, n_hazard_pixels, round(hazard_coverage, 9) as hazard_coverage
from ({REPORT_SQL})""", ["hazards"])
def write_json_report(spark, d):
    line = lambda name, kind: F.get_json_object("value", f"$.{name}").cast(kind).alias(name)
    return spark.read.text(report(spark, d)).select(
        line("region_id", "bigint"), line("n_pixel", "bigint"), line("n_hazard_pixels", "bigint"),
        F.round(line("hazard_coverage", "double"), 9).alias("hazard_coverage"))


@query("read_json_report", REPORT_SQL, ["hazards"])
def read_json_report(spark, d):
    return L.read_json_report(spark, report(spark, d), REPORT)


@query("scan_npy_grid", "select cell, r, c, v as value from g", ["g"])
def scan_npy_grid(spark, d):
    g = X.g(spark, d)
    height = g.agg(F.max("r")).first()[0] + 1
    path = new_path(spark, "grid") + ".npy"
    npy.write_npy_grid(g, path, height, X.WIDTH, "v")
    return npy.scan_npy_grid(spark, path)


@query("scan_ascii_grid", "select cell, r, c, v as value from g_missing", ["g_missing"])
def scan_ascii_grid(spark, d):
    g = X.g_missing(spark, d)
    height = g.agg(F.max("r")).first()[0] + 1
    value = F.coalesce(F.col("v"), F.lit(-9999.0)).cast("string")
    line = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("c", value.alias("t")))), lambda x: x["t"]), " ")
    body = g.groupBy("r").agg(line.alias("value"))
    head = [f"ncols {X.WIDTH}", f"nrows {height}", "xllcorner 0", "yllcorner 0", "cellsize 1",
            "NODATA_value -9999"]
    lines = spark.createDataFrame([(i - 6, h) for i, h in enumerate(head)], "r bigint, value string")
    path = new_path(spark, "ascii")
    lines.unionByName(body).orderBy("r").select("value").write.text(path)
    return text.scan_ascii_grid(spark, path)


@query("scan_events_csv", """
select cast(o_custkey as varchar) as event, o_orderpriority as hazard,
  case when o_orderstatus <> 'F' then o_orderdate end as starttime,
  o_orderkey % 150 + 2.5::double as x, o_orderkey // 150 + 0.5::double as y, 5 as corners
from orders""")
def scan_events_csv(spark, d):
    x, y = F.col("o_orderkey") % 150, F.expr("o_orderkey div 150")
    at = lambda a, b: F.concat((x + a).cast("string"), F.lit(" "), (y + b).cast("string"))
    ring = F.concat_ws(", ", at(0.5, 0.5), at(2.5, 0.5), at(2.5, 2.5), at(0.5, 2.5), at(0.5, 0.5))
    when = F.when(F.col("o_orderstatus") != "F",
                  F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("unknown")
    table = X.table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("event"), F.col("o_orderpriority").alias("hazard"),
        when.alias("starttime"), when.alias("endtime"),
        F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("geometry"))
    path = new_path(spark, "events")
    table.write.csv(path, header=True)
    corner = F.col("rings")[0][1]
    return text.scan_events_csv(spark, path).select(
        "event", "hazard", F.col("starttime").cast("timestamp_ntz").alias("starttime"),
        corner["x"].alias("x"), corner["y"].alias("y"), F.size(F.col("rings")[0]).alias("corners"))


@query("align_bucketed", "select cell, price, cust, age, prio from features", ["features"])
def align_bucketed(spark, d):
    f = X.features(spark, d)
    tables = [L.save_bucketed(
        f.select("cell", n), f"layer_{n}_{uuid.uuid4().hex}", new_path(spark, "bucketed"), 8) for n in VARS]
    return joins.align_layers(tables)
