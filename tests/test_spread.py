"""Fits use every core on narrow tables and bounded numbers of tasks on large ones."""

import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from graticule.operators import models


def rows(spark, parts):
    return spark.range(60_000).select(
        (F.col("id") % 97).cast("double").alias("a"), (F.col("id") % 97 > 40).cast("int").alias("y")
    ).repartition(parts)


@pytest.mark.parametrize("parts", [1, 40])
def test_fits_run_on_every_core(spark, monkeypatch, parts):
    monkeypatch.setattr(models, "SHARE", 10_000, raising=False)
    monkeypatch.setattr(models.spread, "__defaults__", (10_000,)) if hasattr(models, "spread") else None
    seen = []

    def estimator(kept):
        seen.append(kept.rdd.getNumPartitions())
        assert kept.count() == 60_000
        return LogisticRegression(labelCol="y", maxIter=2)

    model = models._fit(rows(spark, parts), ["a"], "y", estimator)
    assert seen == [spark.sparkContext.defaultParallelism]
    assert model.stages[-1].numFeatures == 1


def test_small_tables_stay_in_one_piece(spark):
    kept = models.spread(rows(spark, 1))
    assert kept.rdd.getNumPartitions() == 3  # 60,000 rows, 25,000 a task
    few = models.spread(rows(spark, 1).limit(100))
    assert few.rdd.getNumPartitions() == 1
    kept.unpersist(), few.unpersist()
