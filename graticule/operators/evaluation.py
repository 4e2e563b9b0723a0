"""Exact ranking curves, thresholds and error measures of scored cells.

Scores are first counted per distinct value (map-side combined); everything else
works on those counts.  Curves accumulate through ``prefix_sums``, so one model
with most of the cells is still spread over many tasks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.scalar import clipped_probability
from graticule.operators.aggregates import histogram
from graticule.operators.ranks import join_back, prefix_sums


def score_counts(df: DataFrame, keys=("model",), y="y", p="p") -> DataFrame:
    """(keys, p, tp, fp): positives and negatives at each distinct score."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(
        *keys, F.col(p).alias("p")
    ).agg(F.sum(F.col(y).cast("long")).alias("tp"),
          F.sum((1 - F.col(y)).cast("long")).alias("fp"))


def _with_totals(counts, totals_of, keys):
    totals = totals_of.groupBy(*keys).agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg"))
    if keys:
        return join_back(counts, totals, keys)
    one = totals.select(F.struct("pos", "neg")).scalar()
    return counts.withColumn("_t", one).withColumns(
        {"pos": F.col("_t.pos"), "neg": F.col("_t.neg")}).drop("_t")


def cumulative_curve(df: DataFrame, keys=("model",), y="y", p="p", buckets=None) -> DataFrame:
    """Per distinct score: tp, fp there and ctp, cfp at or above it, with totals."""
    keys = list(keys)
    counts = score_counts(df, keys, y, p)
    running = prefix_sums(counts, "p", {"ctp": "tp", "cfp": "fp"}, keys,
                          descending=True, buckets=buckets)
    return _with_totals(running, counts, keys)


def _points(curve, keys, point, end):
    """One row per threshold, and the curve's end point next to the highest score.

    The highest score is the one with nothing accumulated before it, so the end
    point needs no second pass over the curve.
    """
    first = (F.col("ctp") == F.col("tp")) & (F.col("cfp") == F.col("fp"))
    row = lambda values: F.struct(*[v.cast("double").alias(n) for n, v in values.items()])
    both = F.when(first, F.array(row(point), row(end))).otherwise(F.array(row(point)))
    return curve.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.*")


def pr_curve(curve: DataFrame, keys=("model",)) -> DataFrame:
    """Precision and recall per threshold, plus the end point (1, 0)."""
    return _points(
        curve, keys,
        {"threshold": F.col("p"), "precision": F.col("ctp") / (F.col("ctp") + F.col("cfp")),
         "recall": F.coalesce(F.try_divide("ctp", "pos"), F.lit(1.0))},
        {"threshold": F.lit(None), "precision": F.lit(1.0), "recall": F.lit(0.0)})


def roc_curve(curve: DataFrame, keys=("model",)) -> DataFrame:
    """False and true positive rate per threshold, plus the start (0, 0)."""
    return _points(
        curve, keys,
        {"threshold": F.col("p"), "fpr": F.try_divide("cfp", "neg"),
         "tpr": F.try_divide("ctp", "pos")},
        {"threshold": F.lit(None), "fpr": F.lit(0.0), "tpr": F.lit(0.0)})


def _auroc():
    # a pair with equal scores counts half
    pairs = F.sum(F.col("fp") * (F.col("ctp") - F.col("tp") / 2))
    return F.try_divide(pairs, F.max("pos").cast("double") * F.max("neg"))


def _average_precision():
    step = F.col("tp") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    return F.try_divide(F.sum(step), F.max("pos").cast("double"))


def auroc(curve: DataFrame, keys=("model",)) -> DataFrame:
    return curve.groupBy(*keys).agg(_auroc().alias("auroc"))


def average_precision(curve: DataFrame, keys=("model",)) -> DataFrame:
    return curve.groupBy(*keys).agg(_average_precision().alias("ap"))


def _f1(eps=1e-10):
    precision = F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    recall = F.try_divide("ctp", "pos")
    return 2 * precision * recall / (precision + recall + F.lit(eps))


def best_f1_threshold(curve: DataFrame, keys=("model",)) -> DataFrame:
    """Score with the highest F1; the lowest of equals."""
    scored = curve.withColumn("_f1", _f1())
    return scored.groupBy(*keys).agg(
        F.max_by("p", F.struct("_f1", -F.col("p"))).alias("threshold"),
        F.max("_f1").alias("f1"))


def roc_corner_threshold(curve: DataFrame, keys=("model",)) -> DataFrame:
    """Score whose ROC point is nearest to the corner (0, 1)."""
    tpr, fpr = F.try_divide("ctp", "pos"), F.try_divide("cfp", "neg")
    gap = F.sqrt((1 - tpr) * (1 - tpr) + fpr * fpr)
    return curve.groupBy(*keys).agg(
        F.min_by("p", F.struct(gap.alias("g"), (-F.col("p")).alias("p"))).alias("threshold"))


def f1_threshold_grid(df: DataFrame, keys=("model",), y="y", p="p", steps=100) -> DataFrame:
    """Best of ``steps`` even thresholds on [0, 1]; the lowest of equals.

    Each row adds to the highest threshold it reaches, so the table is reduced to
    ``steps`` counts per key before they are accumulated.
    """
    last = steps - 1
    guess = F.floor(F.col(p) * last)
    at = lambda k: k / F.lit(float(last))
    level = F.when(at(guess + 1) <= F.col(p), guess + 1).when(
        at(guess) > F.col(p), guess - 1).otherwise(guess)
    level = F.least(F.greatest(level, F.lit(-1)), F.lit(last))
    counts = df.withColumn("_k", F.coalesce(level, F.lit(-1))).groupBy(*keys, "_k").agg(
        F.sum(F.col(y).cast("long")).alias("tp"), F.sum((1 - F.col(y)).cast("long")).alias("fp"))
    grid = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(last).cast("long")))
    ks = counts.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    every = ks.withColumn("_k", grid)
    full = every.join(counts, [*keys, "_k"], "left").fillna(0, ["tp", "fp"])
    above = Window.partitionBy(*keys).orderBy(F.desc("_k")).rowsBetween(
        Window.unboundedPreceding, 0)
    total = Window.partitionBy(*keys)
    run = full.select(
        *keys, "_k", F.sum("tp").over(above).alias("ctp"), F.sum("fp").over(above).alias("cfp"),
        F.sum("tp").over(total).alias("pos")).where(F.col("_k") >= 0)
    f1 = F.coalesce(
        F.try_divide(2 * F.col("ctp"), F.col("ctp") + F.col("cfp") + F.col("pos")), F.lit(0.0))
    scored = run.withColumn("_f1", f1)
    return scored.groupBy(*keys).agg(
        F.max_by(at(F.col("_k")), F.struct("_f1", -F.col("_k"))).alias("threshold"),
        F.max("_f1").alias("f1"))


def _ratios(df):
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({
        "accuracy": (tp + tn) / (tp + tn + fp + fn),
        "precision": safe(tp, tp + fp),
        "recall": safe(tp, tp + fn),
        "f1": safe(2 * tp, 2 * tp + fp + fn),
    })


def classification_metrics(df: DataFrame, thresholds: DataFrame, keys=("model",), y="y",
                           p="p") -> DataFrame:
    """Counts and ratios at each key's threshold; division by zero gives 0."""
    keys = list(keys)
    cut = join_back(df, thresholds.select(*keys, F.col("threshold").alias("_t")), keys)
    hit = F.col(p) >= F.col("_t")
    true = F.col(y) == 1
    return _ratios(cut.groupBy(*keys).agg(
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")))


def confusion_matrix(df: DataFrame, threshold=0.5, y="y", p="p") -> DataFrame:
    """Cells per (label, prediction) and the share within the label."""
    pred = (F.col(p) >= F.lit(threshold)).cast("int")
    counts = df.groupBy(y, pred.alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(y))
    return counts.withColumn("share", F.col("n") / total)


def error_metrics(df: DataFrame, keys=("model",), y="y", p="p") -> DataFrame:
    """MAE, MSE, R2 and binary cross-entropy."""
    err = F.col(y) - F.col(p)
    q = clipped_probability(p)
    bce = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    sst = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(err)).alias("mae"), F.avg(err * err).alias("mse"),
        (1 - F.try_divide(F.sum(err * err), sst)).alias("r2"), F.avg(bce).alias("bce"))


def safe_metrics(df: DataFrame, threshold=0.5, keys=(), y="y", p="p") -> DataFrame:
    """Losses and ratios with missing scores as 0, kept off 0 and 1."""
    q = clipped_probability(p)
    work = df.withColumns({"_q": q, "_y": F.coalesce(F.col(y), F.lit(0)).cast("double")})
    yy, qq = F.col("_y"), F.col("_q")
    hit, true = qq > threshold, yy == 1
    return _ratios(work.groupBy(*keys).agg(
        F.avg(-(yy * F.log(qq) + (1 - yy) * F.log(1 - qq))).alias("bce"),
        F.avg((yy - qq) * (yy - qq)).alias("mse"), F.avg(F.abs(yy - qq)).alias("mae"),
        F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn")))


def output_distribution(df: DataFrame, bins=20, keys=(), y="y", p="p") -> DataFrame:
    return histogram(df, p, 0, 1, bins, [*keys, y])


def residuals(df: DataFrame, y="y", p="p") -> DataFrame:
    """Truth minus score, and score minus truth as drawn on the residual map."""
    return df.withColumns({"residual": F.col(y) - F.col(p), "map_residual": F.col(p) - F.col(y)})


def model_comparison(df: DataFrame, keys=("model",), y="y", p="p") -> DataFrame:
    """All metrics per model, at the model's best-F1 threshold, from one curve."""
    keys = list(keys)
    curve = cumulative_curve(df, keys, y, p).withColumn("_f1", _f1())
    best = F.max_by(F.struct("p", "ctp", "cfp"), F.struct("_f1", -F.col("p")))
    mae = F.sum(F.col("tp") * (1 - F.col("p")) + F.col("fp") * F.col("p"))
    table = curve.groupBy(*keys).agg(
        best.alias("b"), F.max("pos").alias("pos"), F.max("neg").alias("neg"),
        _auroc().alias("auroc"), _average_precision().alias("ap"),
        (mae / F.sum(F.col("tp") + F.col("fp"))).alias("mae"))
    at_best = table.select(
        *keys, "auroc", "ap", "mae", F.col("b.p").alias("best_threshold"),
        F.col("b.ctp").alias("tp"), F.col("b.cfp").alias("fp"),
        (F.col("pos") - F.col("b.ctp")).alias("fn"), (F.col("neg") - F.col("b.cfp")).alias("tn"))
    return _ratios(at_best).drop("tp", "fp", "fn", "tn")


def rank_models(metrics: DataFrame, by="f1") -> DataFrame:
    return metrics.orderBy(F.desc(by))
