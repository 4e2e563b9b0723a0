import random

import numpy as np
from pyspark.sql import functions as F

from graticule.llm import language_mix, quality_trees, toxicity
from graticule.llm.common import remainder
from graticule.llm.queries import QUERIES
from helpers import LONG, awkward, empty


def test_remainder(spark):
    import zlib

    got = spark.createDataFrame([(5,), (123,), (None,)], "k bigint").select(
        remainder(F.col("k"), 4)).collect()
    assert [r[0] for r in got] == [zlib.crc32(b"5") % 4, zlib.crc32(b"123") % 4, 0]


# -- language ------------------------------------------------------------------------

AA, BB = "baba kaka lala nana", "qixo zuxy wyqu jixz"


def languages(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        for lang, words in (("aa", AA), ("bb", BB)):
            rows.append((" ".join(rng.choices(words.split(), k=40)), lang))
    rows += [("baba", None), (None, "aa"), ("", "cc"), ("123", "bb")]
    return spark.createDataFrame(rows, "text string, lang string")


def test_mixture(spark):
    model = language_mix.learn(languages(spark))
    assert model.names == ["aa", "bb"]
    tool = language_mix.Identifier(model)
    rng = random.Random(2)
    words = [rng.choice((AA if i % 4 else BB).split()) for i in range(200)]
    names, scores = tool.judge([" ".join(words), AA, BB.upper(), None, "", "12 34 !", LONG, "b"])
    assert names[:6] == ["aa", "aa", "bb", "und", "und", "und"]
    assert abs(scores[0] - 0.75) < 0.05 and scores[1] == 1.0 and scores[2] == 1.0
    assert scores[3] == scores[4] == scores[5] == 0.0 and all(0 <= s <= 1 for s in scores)


def test_one_document_alone_is_judged_alike(spark):
    model = language_mix.learn(languages(spark))
    texts = [AA, BB, AA + " " + BB, "baba qixo", LONG]
    together = language_mix.Identifier(model).judge(texts)
    alone = [language_mix.Identifier(model).judge([t]) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


def test_small_word_store(spark, monkeypatch):
    model = language_mix.learn(languages(spark))
    want = language_mix.Identifier(model).judge([AA, BB, AA + BB])
    monkeypatch.setattr(language_mix, "CACHE_WORDS", 3)
    tool = language_mix.Identifier(model)
    for _ in range(3):
        got = tool.judge([AA, BB, AA + BB])
        assert got[0] == want[0] and np.allclose(got[1], want[1])


def test_identify_awkward_rows(spark):
    model = language_mix.learn(languages(spark))
    docs = awkward(spark)
    rows = docs.select("text", language_mix.identify(F.col("text"), model).alias("f")).collect()
    assert len(rows) == docs.count()
    kept = language_mix.keep_identified(docs, model)
    assert kept.columns == docs.columns
    nothing = language_mix.learn(empty(spark))
    assert nothing.names == []
    assert language_mix.keep_identified(docs, nothing).count() == 0
    assert language_mix.keep_identified(empty(spark), model).count() == 0


def test_language_query(spark, small):
    got = QUERIES["op8_language_mix"](spark, small).join(
        spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    out = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out >= 0.9


# -- quality -------------------------------------------------------------------------

def brute_score(model, row):
    total = model.base
    for t in range(len(model.leaf)):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + (2 if row[model.feature[t, node]] > model.threshold[t, node] else 1)
        total += model.leaf[t, node - (2 ** model.depth - 1)]
    return 1 / (1 + np.exp(-total))


def test_trees_learn_and_walk():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(3000, 5)).astype(np.float32)
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(int)
    model = quality_trees.fit_trees(rows[:2000], labels[:2000], trees=60, depth=4)
    found = model.score(rows[2000:])
    assert ((found > 0.5) == labels[2000:]).mean() > 0.95
    assert np.allclose(found[:50], [brute_score(model, r) for r in rows[2000:2050]])


def test_trees_without_contrast():
    rows = np.zeros((4, 3), dtype=np.float32)
    assert np.allclose(quality_trees.fit_trees(rows, [1, 1, 1, 1]).score(rows), 0.999)
    assert np.allclose(quality_trees.fit_trees(rows[:0], []).score(rows), 0.5)
    mixed = quality_trees.fit_trees(rows, [0, 1, 0, 1])
    assert np.allclose(mixed.score(rows), 0.5)


def test_statistics_of_awkward_texts(spark):
    docs = awkward(spark)
    rows = docs.select("text", quality_trees.measure(F.col("text")).alias("f")).collect()
    for r in rows:
        assert len(r["f"]) == len(quality_trees.FEATURES) and np.isfinite(r["f"]).all()
        if not r["text"]:
            assert not any(r["f"])
    labels = spark.createDataFrame([(1, 1), (6, 0), (99, 1), (None, 0), (2, None)], "doc_id bigint, quality int")
    measured = docs.select("doc_id", quality_trees.measure(F.col("text")).alias("features"))
    model = quality_trees.learn(measured, labels)
    assert measured.select(quality_trees.score(F.col("features"), model)).count() == docs.count()
    assert quality_trees.learn(measured.limit(0), labels).base == 0.0


def test_quality_query(spark, small):
    got = QUERIES["op6_quality_trees"](spark, small).join(
        spark.read.parquet(f"{small}/labels.parquet"), "doc_id").toPandas()
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all()
    assert (got.predicted == got.quality).mean() > 0.9


# -- toxicity ------------------------------------------------------------------------

def labelled(spark):
    rng = random.Random(4)
    plain = [f"plain{i}" for i in range(60)]
    bad = {"foul": ["grubword", "grubthing"], "mean": ["vileness", "vilely"]}
    docs, labels = [], []
    for i in range(600):
        words, toxic = rng.choices(plain, k=30), i % 5 == 0
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad["foul"] + bad["mean"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(docs, "doc_id bigint, text string"),
            spark.createDataFrame(labels, "doc_id bigint, toxic int"), bad)


def test_chain(spark):
    docs, labels, bad = labelled(spark)
    chain = toxicity.learn(docs, labels.where("doc_id % 3 <> 0"), bad)
    assert chain.names == ["foul", "mean", "toxic"]
    rows = docs.join(labels, "doc_id").select(
        "text", "toxic", toxicity.predict(F.col("text"), chain).alias("p")).where("doc_id % 3 = 0")
    for r in rows.collect():
        assert (r["p"]["toxic"] > 0.5) == bool(r["toxic"])
        assert (r["p"]["foul"] > 0.5) == any(w in r["text"] for w in bad["foul"])
    # a word never seen, with a beginning that was
    new = chain.predict(["plain1 plain2 vileling", None, "", LONG])
    assert new[0, 2] > 5 * new[1:, 2].max() and (new[1:, 2] < 0.1).all()


def test_chain_without_examples(spark):
    docs, labels, bad = labelled(spark)
    for none in (labels.limit(0), labels.where("toxic = 0"), labels.selectExpr("doc_id", "cast(null as int) toxic")):
        chain = toxicity.learn(docs, none, bad)
        assert (chain.predict(["grubword", None]) < 0.6).all()
    chain = toxicity.learn(awkward(spark), spark.createDataFrame(
        [(1, 1), (3, 0), (6, 0), (None, 1)], "doc_id bigint, toxic int"), bad)
    assert awkward(spark).select(toxicity.predict(F.col("text"), chain)).count() == awkward(spark).count()


def test_toxicity_query(spark, small):
    got = QUERIES["op5_toxicity_chain"](spark, small).join(
        spark.read.parquet(f"{small}/labels.parquet").withColumnRenamed("toxic", "y"), "doc_id").toPandas()
    clean, bad = got[got.y == 0], got[got.y == 1]
    assert (clean.predicted == 0).mean() > 0.95
    assert bad.score.mean() > 3 * clean.score.mean()


def test_mixtures_stay_and_signs_are_no_letters(spark):
    model = language_mix.learn(languages(spark))
    docs = spark.createDataFrame(
        [(1, AA + " " + BB), (2, "½ ² Ⅷ ①"), (3, "½ " + AA), (4, None)], "doc_id bigint, text string")
    assert {r["doc_id"] for r in language_mix.keep_identified(docs, model).collect()} == {1, 3}
    names, scores = language_mix.Identifier(model).judge(["½ ² Ⅷ ①", "²x" + AA])
    assert names[0] == "und" and scores[0] == 0.0 and names[1] == "aa"


def test_repeated_labels_and_ids_do_not_multiply(spark):
    """A third of the rows share an id that has many labels: the fit stays bounded."""
    rows = [(i, f"plain text number {'bad' if i % 2 else 'good'} {i}") for i in range(60)]
    rows += [(7, f"hot bad row {i % 5}") for i in range(40)]
    labels = [(i, i % 2) for i in range(60)] + [(7, 0)] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("quality", F.col("toxic"))
    for sample in (20_000, 30):  # below and beyond the bound
        scores = []
        for _ in range(2):
            chain = toxicity.learn(docs, known, {"x": ["bad"]}, sample=sample)
            scores.append([r["p"]["toxic"] for r in docs.repartition(3).select(
                "doc_id", toxicity.predict(F.col("text"), chain).alias("p")).orderBy("doc_id", "p").collect()])
            measured = docs.select("doc_id", quality_trees.measure(F.col("text")).alias("features"))
            trees = quality_trees.learn(measured, known, sample=sample)
            scores[-1] += [r[0] for r in measured.select(
                "doc_id", quality_trees.score(F.col("features"), trees).alias("s")).orderBy(
                "doc_id", "s").select("s").collect()]
        assert scores[0] == scores[1] and len(scores[0]) == 200
