"""Fits on blocks of rows give what Spark's own fits give, on less space or in less time."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from graticule.operators import dense_net, lbfgs, models


def rows(spark, n=1500, parts=3):
    h = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0)
    df = spark.range(0, n, 1, parts).select("id", h(1).alias("a"), h(2).alias("b"), h(3).alias("e"))
    return df.withColumn("y", (F.col("a") + F.col("b") * F.col("b") + F.col("e") / 4 > 1.1).cast("int"))


def test_dense_net_takes_spark_steps(spark):
    """Stacks end in each partition, and the last one of each is not a whole one."""
    df, names = rows(spark), ["a", "b"]
    spark_net = MultilayerPerceptronClassifier(labelCol="y", layers=[2, 5, 4, 2], maxIter=12, seed=42)
    want = models.assembled(spark_net, names).fit(df).stages[-1].weights.toArray()
    start = models.assembled(spark_net.copy({spark_net.maxIter: 0}), names).fit(df).stages[-1].weights.toArray()
    got = dense_net.trained_weights(df, names, "y", start, [2, 5, 4, 2], 12)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-8) and not np.allclose(start, want, atol=1e-3)


def test_dense_net_is_a_spark_model(spark, tmp_path):
    df, names = rows(spark), ["a", "b"]
    model = models.fit_mlp(df, names, hidden=(6,), iterations=30)
    models.save_model(model, str(tmp_path / "net"))
    again = models.score_cells(models.load_model(str(tmp_path / "net")), df, "id", ("y",))
    got = models.score_cells(model, df, "id", ("y",)).withColumnRenamed("p", "q").join(again, "id").toPandas()
    assert (got["p"] == got["q"]).all() and len(got) == 1500
    hit = again.where((F.col("p") > 0.5) == (F.col("y") == 1)).count()
    assert hit > 1300


def test_dense_net_refuses_missing_values(spark):
    for bad in (F.lit(None).cast("double"), F.lit(float("nan"))):
        df = rows(spark).withColumn("a", F.when(F.col("id") == 7, bad).otherwise(F.col("a")))
        with pytest.raises(Exception, match="missing or NaN"):
            models.fit_mlp(df, ["a", "b"], hidden=(3,), iterations=2)


def patches(spark):
    cells = spark.range(0, 60 * 50, 1, 3).select(
        F.col("id").alias("cell"), F.expr("id div 60").alias("r"), (F.col("id") % 60).alias("c"),
        (F.pmod(F.xxhash64("id"), F.lit(100_003)) / 100_003.0).alias("v"),
        (F.col("id") % 7).cast("double").alias("u"))
    near = F.pmod(F.xxhash64("r", F.lit(1)), F.lit(5)) / 5.0
    return models.patch_frame(cells.withColumn("y", (F.col("v") + near > 1).cast("int")), ["v", "u"], 3, ("y",))


def test_patch_model_takes_spark_steps_on_little_space(spark, monkeypatch):
    sizes = []

    class Watched(lbfgs.BlockSum):
        def __init__(self, *args):
            super().__init__(*args)
            sizes.append((self.rows, self.blocks.map(lambda b: len(b[1])).sum()))

    monkeypatch.setattr(lbfgs, "BlockSum", Watched)
    frame = patches(spark)
    got = models.fit_patch_model(frame).stages[-1]
    want = LogisticRegression(labelCol="y", maxIter=50, regParam=1e-4).fit(frame)
    assert np.allclose(got.coefficients.toArray(), want.coefficients.toArray(), rtol=1e-6, atol=1e-8)
    assert got.intercept == pytest.approx(want.intercept, rel=1e-6)
    (n, size), = sizes  # 18 numbers and a label a row
    assert n == 3000 and size < n * 19 * 8 / 2
    scored = models.score_cells(models.fit_patch_model(frame), frame)
    assert scored.where("p between 0 and 1").count() == 3000


def test_patch_model_of_one_class_and_of_any_classifier(spark):
    frame = patches(spark)
    only = models.fit_patch_model(frame.withColumn("y", F.lit(1))).stages[-1]
    assert (only.coefficients.toArray() == 0).all() and only.intercept == float("inf")
    other = models.fit_patch_model(frame, LogisticRegression(labelCol="y", maxIter=3))
    assert other.stages[-1].numFeatures == 18
