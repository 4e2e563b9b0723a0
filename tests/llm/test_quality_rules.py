import re
from collections import Counter

from pyspark.sql import functions as F

from graticule.llm import quality_rules
from helpers import awkward, empty

JUNK = [
    (20, "\n".join(["home | about | news | help | more"] * 20) + "\n" + "good words here now. " * 3),
    (21, " ".join(f"SHOUT{i}!!" for i in range(80))),
    (22, " ".join(f"word{i}" for i in range(80)) + ".\nAll rights reserved by nobody."),
    (23, "same three words " * 40),
    (24, " ".join(f"w{i}" for i in range(50))),
    (25, " ".join(f"w{i}" for i in range(49))),
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered),
            len(words) < 50 or 100 * len(covered) > 50 * len(words))


def test_counts_and_verdicts(spark):
    docs = awkward(spark, JUNK)
    rows = quality_rules.clean_lines(docs).select("doc_id", "text", "_judged.*").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"], r["base_failed"]) == brute(r["text"]), r["doc_id"]
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert [kept[i] for i in (20, 21, 22, 23, 24, 25, 3, 4, 5)] == [
        False, False, True, False, True, False, False, False, False]


def test_rows_and_columns_stay(spark):
    docs = awkward(spark, JUNK)
    good = quality_rules.keep_good(docs)
    assert good.columns == docs.columns
    assert sorted(r["doc_id"] for r in good.collect()) == [22, 24]
    clean = quality_rules.keep_good(docs, replace=True).where("doc_id = 22").first()
    assert "rights" not in clean["text"]
    assert quality_rules.keep_good(empty(spark)).count() == 0


def test_a_phrase_fails_only_the_lines_it_makes_up(spark):
    long = "We read the privacy policy of this company and wrote down in our own words what it says about data."
    lines = ["Privacy policy", "Tous droits réservés.", "Datenschutzerklärung", long, "Nothing to see in here"]
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select(
        "line", quality_rules.line_fails(F.col("line")).alias("fails")).collect()
    assert [r["fails"] for r in rows] == [True, True, True, False, False]


def test_repeats_without_sorting_or_matching_all_words(spark):
    """Windows are compared by hashes, and lines without a mark are not counted word by word."""
    texts = ["a b c a b c a b", "a b c d", "a b", "", "x a b c y a b c z", "a a a a a", "b c b c b c d",
             " ".join(f"w{i % 700}" for i in range(1500))]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(
        "text", quality_rules.repeated_words(quality_rules.split_words(F.col("text"))).alias("n"))
    assert [r["n"] for r in rows.collect()] == [brute(x)[4] for x in texts]
    plan = str(rows._jdf.queryExecution().analyzed())
    assert "xxhash64" in plan
    judged = quality_rules.judge(F.lit("a b"))
    plan = str(spark.range(1).select(judged.alias("j"))._jdf.queryExecution().analyzed())
    assert "translate(" not in plan  # slow for each character


def test_equal_hashes_of_different_windows(spark, monkeypatch):
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *a: F.lit(5).cast("bigint"))
    texts = ["a b c d e f a b c", "a b c d e f", "a b c a b c"]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(
        quality_rules.repeated_words(quality_rules.split_words(F.col("text"))).alias("n")).collect()
    assert [r["n"] for r in rows] == [brute(x)[4] for x in texts]
