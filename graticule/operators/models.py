"""Fitting and scoring per-cell models with Spark ML, importances, ensembles."""

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graticule.functions.scalar import clipped_probability
from graticule.functions.scaling import minmax_scale
from graticule.operators import dense_net, logistic
from graticule.operators.cells import binarize, fill_missing, map_domain, valid_mask
from graticule.operators.focal import patch_extract
from graticule.operators.joins import scatter_to_grid
from graticule.operators.ranks import hash_rank
from graticule.operators.sampling import sample_fraction
from graticule.session import durable


# Rows of a fit that are worth a task of their own.
SHARE = 25_000


def train_frame(cells: DataFrame, variables, elevation, count, split="split", fraction=1.0,
                key="cell", seed=42) -> DataFrame:
    """Feature rows of the valid cells: set 'train' (splits 1, 2) or 'test' (3).

    The label is 1 where the count is positive; missing features become 0; a
    fraction below 1 samples the training rows.
    """
    rows = valid_mask(cells, elevation).where(F.col(split).isin(1, 2, 3))
    rows = fill_missing(rows.withColumn("y", binarize(count)), variables).select(
        key, split, "y", *variables)
    test = rows.where(F.col(split) == 3).withColumn("set", F.lit("test"))
    train = rows.where(F.col(split) < 3).withColumn("set", F.lit("train"))
    if fraction < 1.0:
        train = sample_fraction(train, fraction, key, seed)
    return train.unionByName(test)


def assembled(estimator, variables):
    """Pipeline that packs the variables into one vector for the estimator."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=list(variables), outputCol="features"), estimator])


def spread(rows: DataFrame, share=SHARE) -> DataFrame:
    """``rows`` kept in memory, in as many parts as there are cores and ``share`` allows.

    Adaptive execution sizes partitions by bytes, so that a narrow table of many rows
    ends up in a few of them and an optimiser's passes leave most cores idle; a large
    one ends up in ever more, each of which reports to the driver in every pass.
    """
    kept = rows.persist()
    parts = min(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(kept.count() / share))
    now = kept.rdd.getNumPartitions()
    if parts <= 1 or now == parts:
        return kept
    even = kept.repartition(parts).persist()
    even.count()
    kept.unpersist()
    return even


def _fit(train, variables, label, estimator, extra=()):
    """Fit on the needed columns only, kept for the passes an optimiser makes."""
    rows = spread(train.select(*variables, label, *extra))
    try:
        return assembled(estimator(rows), variables).fit(rows)
    finally:
        rows.unpersist()


def fit_lr(train: DataFrame, variables, label="y", C=1.0, iterations=100, weight=None):
    """L2 logistic regression; the penalty matches 1 / (2 C) times the squared weights."""
    def estimator(rows):
        model = LogisticRegression(
            labelCol=label, regParam=1.0 / (C * rows.count()), elasticNetParam=0.0,
            maxIter=iterations, tol=1e-4, standardization=False)
        return model.setWeightCol(weight) if weight else model

    return _fit(train, variables, label, estimator, [weight] if weight else [])


def fit_rf(train: DataFrame, variables, label="y", trees=100, depth=10, seed=42):
    return _fit(train, variables, label, lambda rows: RandomForestClassifier(
        labelCol=label, numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed))


def fit_rf_reg(train: DataFrame, variables, label, trees=100, depth=10, leaf=5, seed=42):
    return _fit(train, variables, label, lambda rows: RandomForestRegressor(
        labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed))


def fit_mlp(train: DataFrame, variables, label="y", hidden=(128, 128), iterations=100, seed=42):
    """Dense net with sigmoid units: Spark's model and start, its training on matrices of rows."""
    variables = list(variables)
    layers = [len(variables), *hidden, 2]
    net = MultilayerPerceptronClassifier(labelCol=label, layers=layers, maxIter=0, seed=seed)
    one = train.sparkSession.createDataFrame(
        [(*[0.0] * len(variables), 0.0)], ", ".join(f"`{c}` double" for c in [*variables, label]))
    start = assembled(net, variables).fit(one).stages[-1].weights.toArray()
    rows = spread(train.select(*variables, label))
    try:
        weights = dense_net.trained_weights(rows, variables, label, start, layers, iterations)
    finally:
        rows.unpersist()
    return assembled(net.setInitialWeights(Vectors.dense(weights)), variables).fit(one)


def patch_frame(cells: DataFrame, variables, patch=5, keep=("y", "split")) -> DataFrame:
    """Each cell's patches of all variables as one vector, next to its label."""
    return patch_extract(cells, variables, patch, carry=keep).select(
        "cell", *keep, array_to_vector(F.concat(*variables)).alias("features"))


def fit_patch_model(frame: DataFrame, estimator=None, label="y"):
    """Any classifier on the neighbourhood instead of the centre cell.

    The logistic regression that is meant without one reads patches that are kept compressed.
    """
    if estimator is None:
        estimator = LogisticRegression(labelCol=label, maxIter=50, regParam=1e-4)
        model = logistic.fit_packed(frame, estimator, "features", label, SHARE // 4)
        if model is not None:
            return PipelineModel(stages=[model])
    rows = spread(frame.select("features", label))
    try:
        return Pipeline(stages=[estimator]).fit(rows)
    finally:
        rows.unpersist()


def score_cells(model, cells: DataFrame, key="cell", keep=()) -> DataFrame:
    """(key, p): probability of the positive class, or the predicted value."""
    scored = model.transform(cells)
    if "probability" in scored.columns:
        p = vector_to_array("probability")[1]
    else:
        p = F.col("prediction")
    return scored.select(key, *keep, p.alias("p"))


def score_foreign(predict, cells: DataFrame, variables, key="cell") -> DataFrame:
    """Scores of a model from elsewhere: ``predict(matrix) -> vector`` per batch."""
    variables = list(variables)

    def run(batches):
        for pdf in batches:
            yield pdf[[key]].assign(p=predict(pdf[variables].to_numpy(float)))

    return cells.select(key, *variables).mapInPandas(run, f"{key} bigint, p double")


def hazard_map(model, cells: DataFrame, variables, elevation) -> DataFrame:
    """Scores of the cells with elevation above 0 on the whole grid."""
    domain = fill_missing(map_domain(cells, elevation), variables)
    return scatter_to_grid(cells.select("cell"), score_cells(model, domain))


def save_model(model: PipelineModel, path):
    model.write().overwrite().save(path)


def load_model(path) -> PipelineModel:
    return PipelineModel.load(path)


def feature_importance(spark, model: PipelineModel, variables) -> DataFrame:
    """Impurity importance per variable of a fitted forest."""
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(
        [(v, float(x)) for v, x in zip(variables, values)], "variable string, importance double")


def accuracy(y="y", p="p"):
    return F.avg(((F.col(p) > 0.5) == (F.col(y) == 1)).cast("double"))


def permutation_importance(model, cells: DataFrame, variables, metric=None, label="y",
                           key="cell", seed=42) -> DataFrame:
    """Baseline score minus the score with one variable shuffled.

    The rows are put in one random order; a variable is shuffled by giving each
    value to the row a random distance further on (around the end), so every
    value is used once and all variables share one ranking.  Each row sends every
    variable's value to the row that takes it, so one shuffle on the rank serves all
    variables, and one scoring pass all tables.
    """
    variables = list(variables)
    metric = metric if metric is not None else accuracy(label)
    base = durable(hash_rank(cells.select(key, label, *variables), seed, key, into="_rank"))
    n = base.count()
    rng = random.Random(seed)
    shifts = [rng.randrange(1, max(n, 2)) for _ in variables]
    row = F.struct(key, label, *variables)
    own = F.struct(F.col("_rank"), F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"), row.alias("row"))
    empty = F.lit(None).cast(base.select(row.alias("row")).schema["row"].dataType)
    # the row a random distance further on takes the value
    sent = [F.struct(
        (F.pmod(F.col("_rank") - 1 + s, F.lit(n)) + 1).alias("_rank"), F.lit(i).alias("i"),
        F.col(v).cast("double").alias("v"), empty.alias("row"))
        for i, (v, s) in enumerate(zip(variables, shifts))]
    met = base.select(F.explode(F.array(own, *sent)).alias("_e")).select("_e.*").groupBy("_rank").agg(
        F.max_by("row", F.col("row").isNotNull()).alias("row"),
        *[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"_{i}") for i in range(len(variables))])
    tables = [F.struct(F.lit("baseline").alias("variable"), "row.*")] + [
        F.struct(F.lit(v).alias("variable"), F.col(f"row.{key}"), F.col(f"row.{label}"), *[
            (F.col(f"_{i}").cast(base.schema[w].dataType) if w == v else F.col(f"row.{w}")).alias(w)
            for w in variables]) for i, v in enumerate(variables)]
    mixed = met.select(F.explode(F.array(*tables)).alias("_t")).select("_t.*")
    scores = score_cells(model, mixed, key, (label, "variable")).groupBy("variable").agg(
        metric.alias("_score"))
    baseline = F.max(F.when(F.col("variable") == "baseline", F.col("_score"))).over(
        Window.partitionBy())  # one row per variable
    return scores.withColumn("_base", baseline).select("variable", F.when(
        F.col("variable") == "baseline", F.col("_score")
    ).otherwise(F.col("_base") - F.col("_score")).alias("importance"))


def log_loss(y="y", p="p"):
    q = clipped_probability(p)
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def random_settings(ranges, n, seed=42):
    """``n`` draws from {name: list of choices or (low, high)}."""
    rng = random.Random(seed)
    pick = lambda r: rng.choice(r) if isinstance(r, list) else rng.uniform(*r)
    return [{name: pick(r) for name, r in ranges.items()} for _ in range(n)]


def param_search(estimator, settings, train: DataFrame, validation: DataFrame, variables,
                 label="y", parallelism=4) -> DataFrame:
    """Validation loss of each setting (a dict of estimator parameters), best first.

    The settings are a short list on the driver; each fit and each loss is a
    distributed job, and ``parallelism`` of them run at a time, so that small fits
    fill the cluster together.  Validation keeps the spatial split instead of a random one.
    """
    spark = train.sparkSession
    schema = "setting int, parameters string, val_loss double"
    if not settings:
        return spark.createDataFrame([], schema)
    pack = VectorAssembler(inputCols=list(variables), outputCol="features")
    packed = spread(pack.transform(train.select(*variables, label)))
    held = pack.transform(validation.select(*variables, label)).persist()
    maps = [{estimator.getParam(k): v for k, v in s.items()} for s in settings]
    models = estimator.fitMultiple(packed, maps)  # its iterator may be shared by threads

    @inheritable_thread_target(spark)
    def fit_next(_):
        i, model = next(models)
        loss = score_cells(model, held, label, ()).agg(log_loss(label)).first()[0]
        return i, str(sorted(settings[i].items())), float(loss)

    try:
        with ThreadPool(min(parallelism, len(maps))) as pool:
            rows = pool.map(fit_next, maps, chunksize=1)
    finally:
        packed.unpersist()
        held.unpersist()
    return spark.createDataFrame(rows, schema).orderBy("val_loss", "setting")


def inverse_error_ensemble(maps: DataFrame, errors: DataFrame, member="model", key="cell"):
    """Means of the members' maps weighted by 1 / MAE and 1 / MSE.

    ``errors`` has one row per member.  A member missing at a cell counts neither
    there nor in the weights.  Members without an error share all the weight where
    there are any, which is the limit of the weights.
    """
    weights = errors.select(
        member, F.try_divide(F.lit(1.0), "mae").alias("_a"), F.try_divide(F.lit(1.0), "mse").alias("_s"),
        (F.col("mae") == 0).alias("_a0"), (F.col("mse") == 0).alias("_s0"))
    joined = maps.where(F.col("p").isNotNull()).join(weights, member)

    def mean(w):
        exact = F.avg(F.when(F.col(f"{w}0"), F.col("p")))
        weighted = F.try_divide(F.sum(F.col(w) * F.col("p")), F.sum(w))
        return F.coalesce(exact, weighted)

    return joined.groupBy(key).agg(mean("_a").alias("p_mae"), mean("_s").alias("p_mse"))


def stack_meta(maps, labels: DataFrame, key="cell", label="y"):
    """Logistic model on the single-hazard maps: (fitted model, training frame).

    ``maps`` is {hazard: DataFrame (cell, p)}.  Every labelled cell counts; a map
    without it is 0 there.
    """
    aligned = labels
    for name, m in maps.items():
        aligned = aligned.join(m.select(key, F.col("p").alias(name)), key, "left")
    frame = fill_missing(aligned, list(maps))
    return fit_lr(frame, list(maps), label), frame


def linear_multi_hazard(cells: DataFrame, limits, elevation, key="cell") -> DataFrame:
    """Number of scaled hazard maps at or above their limits; missing at sea."""
    scaled = minmax_scale(cells, list(limits))
    total = F.lit(0)
    for name, limit in limits.items():
        total = total + F.when(F.col(name) >= F.lit(float(limit)), 1).otherwise(0)
    return scaled.select(key, F.when(F.col(elevation).isNotNull(), total).alias("n_hazards"))
