import corpus_pipeline
from graticule.llm import quality_rules, simhash
from helpers import awkward, empty

WORDS = [f"alpha{i} beta{i} gamma{i}" for i in range(40)]


def docs_of(spark):
    good = " ".join(WORDS)
    return awkward(spark, [
        (40, good + " mail joe@mail.example.com now."), (41, good + " mail joe@mail.example.com now."),
        (42, " ".join(reversed(WORDS)) + " something else."), (43, "buy now!! " * 60)])


def test_stages(spark):
    docs = docs_of(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, None)
        if name != "packing":
            assert found.columns == docs.columns
            docs = found
            seen[name] = sorted(r["doc_id"] for r in docs.collect())
    # 6 and 7 are long texts of few words, in repeated windows
    assert seen["quality_rules"] == [40, 41, 42]
    assert seen["language_mix"] == [40, 41, 42]
    assert seen["simhash"] == [40, 42] and seen["disclosure"] == [40, 42]
    assert "joe@" not in docs.where("doc_id = 40").first()["text"]
    assert {r["doc_id"] for r in found.collect()} == {40, 42}


def test_failing_lines_go(spark):
    """A document that passes goes on without its one failing line."""
    good = [" ".join(WORDS[:20]), " ".join(WORDS[20:])]
    text = good[0] + "\nBuy now!! Click here!!\n" + good[1]
    docs = awkward(spark, [(50, text), (51, "\n".join(good)), (52, "\n\n".join(good))])
    name, stage = corpus_pipeline.STAGES[0]
    found = stage(spark, docs, None)
    assert name == "quality_rules" and found.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    # the quick brute force: a line fails with "!!" or a phrase
    want = "\n".join(x for x in text.split("\n") if "!!" not in x)
    assert got == {50: want, 51: want, 52: "\n\n".join(good)}


def test_empty_stages(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, None).count() == 0


def test_run_follows_its_operators(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = simhash.keep_one(quality_rules.keep_good(docs))
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in want.select("doc_id").collect()}
    ends = {}
    for r in rows:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in ends.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
