"""Queries: evaluation of scored cells."""

from pyspark.sql import functions as F

from graticule.operators import evaluation as E
from graticule.plans import fixtures as X
from graticule.plans.catalog import query, view

view("curve", """
select model, p, tp, fp, cast(sum(tp) over w as bigint) as ctp,
  cast(sum(fp) over w as bigint) as cfp,
  cast(sum(tp) over (partition by model) as bigint) as pos,
  cast(sum(fp) over (partition by model) as bigint) as neg
from (select model, p, cast(sum(y) as bigint) as tp, cast(sum(1 - y) as bigint) as fp
      from scores_multi group by 1, 2)
window w as (partition by model order by p desc)""", ["scores_multi"])

F1_SQL = """2 * (ctp / (ctp + cfp)) * (ctp / pos) / (ctp / (ctp + cfp) + ctp / pos + 1e-10)"""

view("best", f"""
select model, p as threshold, f1 from (select model, p, f1, row_number() over
  (partition by model order by f1 desc, p) as rn from (select model, p, {F1_SQL} as f1 from curve))
where rn = 1""", ["curve"])


def curve(spark, d):
    return E.cumulative_curve(X.scores_multi(spark, d))


def rounded(df, *names, digits=9):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("cumulative_curve", "select model, p, tp, fp, ctp, cfp, pos, neg from curve", ["curve"])
def cumulative_curve(spark, d):
    return curve(spark, d)


@query("pr_curve", """
select model, p as threshold, ctp / (ctp + cfp) as precision, ctp / pos as recall from curve
union all select distinct model, null, 1.0, 0.0 from curve""", ["curve"])
def pr_curve(spark, d):
    return E.pr_curve(curve(spark, d))


@query("roc_curve", """
select model, p as threshold, cfp / neg as fpr, ctp / pos as tpr from curve
union all select distinct model, null, 0.0, 0.0 from curve""", ["curve"])
def roc_curve(spark, d):
    return E.roc_curve(curve(spark, d))


@query("auroc", """
select model, round(sum(fp * (ctp - tp / 2)) / (cast(max(pos) as double) * max(neg)), 9) as auroc
from curve group by 1""", ["curve"])
def auroc(spark, d):
    return rounded(E.auroc(curve(spark, d)), "auroc")


@query("average_precision", """
select model, round(sum(tp * ctp / (ctp + cfp)) / max(pos), 9) as ap from curve group by 1
""", ["curve"])
def average_precision(spark, d):
    return rounded(E.average_precision(curve(spark, d)), "ap")


@query("best_f1_threshold", "select model, threshold, round(f1, 9) as f1 from best", ["best"])
def best_f1_threshold(spark, d):
    return rounded(E.best_f1_threshold(curve(spark, d)), "f1")


@query("f1_threshold_grid", """
select model, threshold, round(f1, 9) as f1 from (
  select model, t as threshold, f1,
    row_number() over (partition by model order by f1 desc, t) as rn
  from (select model, t, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end
          as f1
        from (select model, t, sum(case when p >= t then y else 0 end) as tp,
                sum(case when p >= t then 1 - y else 0 end) as fp,
                sum(case when p < t then y else 0 end) as fn
              from scores_multi cross join (select i / 99.0 as t from range(100) r(i))
              group by 1, 2))) where rn = 1""", ["scores_multi"])
def f1_threshold_grid(spark, d):
    return rounded(E.f1_threshold_grid(X.scores_multi(spark, d)), "f1")


@query("roc_corner_threshold", """
select model, threshold from (select model, p as threshold, row_number() over (partition by model
  order by sqrt((1 - ctp / pos) * (1 - ctp / pos) + (cfp / neg) * (cfp / neg)), p desc) as rn
  from curve) where rn = 1""", ["curve"])
def roc_corner_threshold(spark, d):
    return E.roc_corner_threshold(curve(spark, d))


RATIOS = """
(tp + tn) / (tp + tn + fp + fn) as accuracy,
case when tp + fp = 0 then 0.0 else tp / (tp + fp) end as precision,
case when tp + fn = 0 then 0.0 else tp / (tp + fn) end as recall,
case when 2 * tp + fp + fn = 0 then 0.0 else 2 * tp / (2 * tp + fp + fn) end as f1"""


@query("classification_metrics", f"""
select model, tp, fp, fn, tn, {RATIOS} from (
  select s.model, count(*) filter (p >= threshold and y = 1) as tp,
    count(*) filter (p >= threshold and y = 0) as fp,
    count(*) filter (p < threshold and y = 1) as fn,
    count(*) filter (p < threshold and y = 0) as tn
  from scores_multi s join best b on s.model = b.model group by 1)""", ["scores_multi", "best"])
def classification_metrics(spark, d):
    scores = X.scores_multi(spark, d)
    return E.classification_metrics(scores, E.best_f1_threshold(E.cumulative_curve(scores)))


@query("confusion_matrix", """
select y, cast(p >= 0.5 as integer) as pred, count(*) as n,
  count(*) / sum(count(*)) over (partition by y) as share from scores group by 1, 2""", ["scores"])
def confusion_matrix(spark, d):
    return E.confusion_matrix(X.scores(spark, d))


CLIP = "greatest(1e-7, least(1 - 1e-7, coalesce(p, 0.0)))"


@query("error_metrics", f"""
select model, round(avg(abs(y - p)), 9) as mae, round(avg((y - p) * (y - p)), 9) as mse,
  round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)), 6) as r2,
  round(avg(-(y * ln({CLIP}) + (1 - y) * ln(1 - {CLIP}))), 6) as bce
from scores_multi group by 1""", ["scores_multi"])
def error_metrics(spark, d):
    out = E.error_metrics(X.scores_multi(spark, d))
    return rounded(rounded(out, "mae", "mse"), "r2", "bce", digits=6)


@query("safe_metrics", f"""
select bce, mse, mae, tp, fp, fn, tn, {RATIOS} from (
  select round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as bce,
    round(avg((y - q) * (y - q)), 6) as mse, round(avg(abs(y - q)), 6) as mae,
    count(*) filter (q > 0.5 and y = 1) as tp, count(*) filter (q > 0.5 and y = 0) as fp,
    count(*) filter (q <= 0.5 and y = 1) as fn, count(*) filter (q <= 0.5 and y = 0) as tn
  from (select y, {CLIP} as q from (
    select y, case when p < 0.1 then null else p * 1.1 end as p from scores)))""", ["scores"])
def safe_metrics(spark, d):
    rough = X.scores(spark, d).withColumn("p", F.when(F.col("p") >= 0.1, F.col("p") * 1.1))
    return rounded(E.safe_metrics(rough), "bce", "mse", "mae", digits=6)


@query("output_distribution", """
select model, y, cast(case when p = 1 then 9 else floor(p * 10) end as integer) as bin,
  count(*) as n from scores_multi group by 1, 2, 3""", ["scores_multi"])
def output_distribution(spark, d):
    return E.output_distribution(X.scores_multi(spark, d), 10, ["model"])


@query("residuals", "select cell, y - p as residual, p - y as map_residual from scores", ["scores"])
def residuals(spark, d):
    return E.residuals(X.scores(spark, d)).select("cell", "residual", "map_residual")


COMPARISON = f"""
select model, round(auroc, 9) as auroc, round(ap, 9) as ap, round(mae, 9) as mae,
  threshold as best_threshold, {RATIOS} from (
  select c.model, max(b.threshold) as threshold,
    sum(fp * (ctp - tp / 2)) / (cast(max(pos) as double) * max(neg)) as auroc,
    sum(tp * ctp / (ctp + cfp)) / max(pos) as ap,
    sum(tp * (1 - p) + fp * p) / sum(tp + fp) as mae,
    max(case when p = b.threshold then ctp end) as tp,
    max(case when p = b.threshold then cfp end) as fp,
    max(case when p = b.threshold then pos - ctp end) as fn,
    max(case when p = b.threshold then neg - cfp end) as tn
  from curve c join best b on c.model = b.model group by 1)"""


@query("model_comparison", COMPARISON, ["curve", "best"])
def model_comparison(spark, d):
    return rounded(E.model_comparison(X.scores_multi(spark, d)), "auroc", "ap", "mae")


@query("rank_models", f"select * from ({COMPARISON}) order by f1 desc", ["curve", "best"])
def rank_models(spark, d):
    return E.rank_models(rounded(E.model_comparison(X.scores_multi(spark, d)), "auroc", "ap", "mae"))
