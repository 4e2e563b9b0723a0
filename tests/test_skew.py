"""Ranks, running sums and samples when one group holds most rows."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from graticule.operators.aggregates import quantiles
from graticule.operators.evaluation import auroc, average_precision, cumulative_curve
from graticule.operators.ranks import hash_rank, hash_take, ordered_rank, prefix_sums
from graticule.operators.sampling import balance_by_region, balanced_batches, sample_n


def hot_rows(spark, n=3000):
    return spark.range(n).select(
        F.col("id").alias("cell"), F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id") % 50).alias("g"))


def by_md5(ids):
    return sorted(ids, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))


def test_hash_rank_in_buckets_equals_plain_order(spark):
    got = hash_rank(hot_rows(spark), 42, "cell", ["g"], bucket_rows=10).toPandas()
    for _, part in got.groupby("g"):
        want = {c: i + 1 for i, c in enumerate(by_md5(part["cell"]))}
        assert dict(zip(part["cell"], part["rank"])) == want


def test_hash_rank_over_the_whole_table(spark):
    got = hash_rank(hot_rows(spark), 42, "cell", bucket_rows=16).toPandas()
    assert list(got.sort_values("rank")["cell"]) == by_md5(range(3000))


def test_hash_take_keeps_exactly_the_quota(spark):
    rows = hot_rows(spark)
    got = hash_take(rows, 42, "cell", 25, ["g"], bucket_rows=10).toPandas()
    sizes = rows.toPandas().groupby("g").size()
    assert got.groupby("g").size().to_dict() == sizes.clip(upper=25).to_dict()
    hot = set(got[got["g"] == 7]["cell"])
    members = rows.where("g = 7").toPandas()["cell"]
    assert hot == set(by_md5(members)[:25])


def test_hash_take_keeps_the_null_group(spark):
    rows = spark.range(40).select(
        F.col("id").alias("cell"), F.when(F.col("id") < 30, 1).alias("g"))
    assert hash_take(rows, 1, "cell", 100, ["g"]).count() == 40


def test_prefix_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b"], 4000, p=[0.9, 0.1]),
                        "p": rng.permutation(4000) / 7.0, "n": rng.integers(0, 5, 4000)})
    got = prefix_sums(spark.createDataFrame(pdf), "p", {"run": "n"}, ["k"], True, buckets=37).toPandas()
    pdf = pdf.sort_values("p", ascending=False)
    pdf["run"] = pdf.groupby("k")["n"].cumsum()
    both = got.merge(pdf, on=["k", "p"])
    assert len(both) == 4000 and (both["run_x"] == both["run_y"]).all()


def test_ordered_rank_is_gapless(spark):
    rows = spark.range(5000).select("id", (F.col("id") * 7919 % 13).alias("k"))
    got = ordered_rank(rows, ["k", "id"], "n", 100).toPandas().sort_values("n")
    assert list(got["n"]) == list(range(100, 5100))
    assert got[["k", "id"]].apply(tuple, axis=1).is_monotonic_increasing


def test_quantiles_of_a_hot_group(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"k": np.where(np.arange(2000) % 5, "hot", "cold"),
                        "x": rng.normal(size=2000).round(2)})
    got = quantiles(spark.createDataFrame(pdf), "x", [0, 0.1, 0.5, 0.95, 1], ["k"]).toPandas()
    for _, row in got.iterrows():
        want = np.quantile(pdf[pdf["k"] == row["k"]]["x"], row["q"])
        assert abs(row["value"] - want) < 1e-12


def test_balance_with_one_large_region(spark):
    rows = spark.range(2000).select(
        F.col("id").alias("cell"), F.when(F.col("id") < 1500, 1).otherwise(2).alias("rid"),
        F.lit(1).alias("split"), (F.col("id") % 20 == 0).cast("int").alias("y"))
    counts = balance_by_region(rows).groupBy("rid", "y").count().toPandas()
    assert sorted(map(tuple, counts.to_numpy())) == [(1, 0, 75), (1, 1, 75), (2, 0, 25), (2, 1, 25)]


def test_balance_drops_negatives_without_positives(spark):
    rows = spark.createDataFrame([(i, 1, 1, 0) for i in range(5)], "cell long, rid int, split int, y int")
    assert balance_by_region(rows).count() == 0


def test_batches_have_fixed_shares(spark):
    rows = spark.range(1000).select(F.col("id").alias("cell"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    for replacement in (False, True):
        got = balanced_batches(rows, 16, 3, replacement=replacement).groupBy("batch").agg(
            F.count("*").alias("n"), F.sum("y").alias("pos")).toPandas()
        assert set(got["n"]) == {16} and set(got["pos"]) == {4} and len(got) == 25


def test_batch_too_small(spark):
    rows = spark.createDataFrame([(1, 1)], "cell long, y int")
    try:
        balanced_batches(rows, 2, 9)
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_sample_n_edges(spark):
    rows = spark.range(30).select(F.col("id").alias("cell"), (F.col("id") % 4).cast("int").alias("split"))
    valid = rows.where("split > 0").count()
    assert sample_n(rows, 1000).count() == valid
    assert sample_n(rows, 0).count() == 0 and sample_n(rows, -3).count() == 0
    assert sample_n(rows, 7).count() == 7


def test_curve_areas(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 600)
    p = (rng.random(600) * 40).round() / 40
    df = spark.createDataFrame(pd.DataFrame({"y": y, "p": p, "model": "m"}))
    curve = cumulative_curve(df, buckets=8)
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert abs(auroc(curve).first()["auroc"] - wins) < 1e-12
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall, precision = y[hit].sum() / y.sum(), y[hit].mean()
        total, last = total + (recall - last) * precision, recall
    assert abs(average_precision(curve).first()["ap"] - total) < 1e-12
    squeezed = cumulative_curve(df.withColumn("p", F.col("p") * F.col("p") / 3))
    assert abs(auroc(squeezed).first()["auroc"] - wins) < 1e-12
