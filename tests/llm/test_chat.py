import hashlib

from pyspark.sql import functions as F

from graticule.llm import chat

WEIRD = ["</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<\\s>", "", None, "<</s>", "[/INST", "$1 \\n", "é😀\n"]


def tree(spark, rows):
    return spark.createDataFrame(
        rows, "tree bigint, node bigint, parent bigint, role string, text string, score double")


def test_texts_come_back(spark):
    rows = spark.createDataFrame(
        [(c, t, role, text) for c in (1, 2) for t, text in enumerate(WEIRD)
         for role in (["user", "assistant", None][t % 3],)],
        "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_turns(rows).select(
        "tree", "formatted", chat.read_back(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("spans")).alias("learned")).collect()
    assert len(done) == 2
    for r in done:
        assert [t["text"] for t in r["turns"]] == [t or "" for t in WEIRD]
        assert [t["role"] for t in r["turns"]] == [
            ["user", "assistant", ""][i % 3] for i in range(len(WEIRD))]
        assert r["learned"] == "".join(t or "" for t in WEIRD[1::3])


def test_best_branch(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0),
        (1, 3, 1, "assistant", "good", 3.0), (1, 4, 3, "user", "more", 1.0),
        (1, 5, 4, "assistant", "end", 2.0), (2, 1, None, "user", "alone", None),
        (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0),
        (4, 7, 99, "user", "orphan", 1.0), (None, 1, None, "user", "no tree", 1.0),
        (1, 5, 4, "assistant", "end", 2.0), (5, None, None, "user", "no id", 1.0),
    ]
    t = tree(spark, rows)
    paths = chat.best_paths(t, score="score", keep=None)
    got = {}
    for r in paths.collect():
        got.setdefault((r["tree"], r["branch"]), []).append((r["step"], r["node"]))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {
        (1, 1): [1, 3, 4, 5], (1, 2): [1, 2], (2, 1): [1], (4, 1): [7], (None, 1): [1]}
    text = chat.format_paths(chat.best_paths(t, score="score"), t, score="score")
    best = {r["tree"]: r["formatted"] for r in text.collect()}
    assert best[1] == ("<s>[INST] user [/INST]q</s><s>[INST] assistant [/INST]good</s>"
                       "<s>[INST] user [/INST]more</s><s>[INST] assistant [/INST]end</s>")


def test_long_and_repeated(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(300)]
    rows += [(2, 0, "user", "x"), (2, 0, "user", "x"), (2, None, "user", "first"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["tree"]: [t["text"] for t in r["turns"]] for r in chat.format_turns(df).select(
        "tree", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [f"t{t}" for t in range(300)], 2: ["first", "x", "x"], None: ["n"]}
    assert chat.format_turns(df.limit(0)).count() == 0


def test_query(spark, small, duck):
    from graticule.llm.queries import QUERIES

    got = {r["conv_id"]: r for r in QUERIES["op1_chat"](spark, small).collect()}
    rows = duck.sql("select conv_id, role, text from conversations order by conv_id, turn").fetchall()
    said = {}
    for c, role, text in rows:
        said.setdefault(c, []).append((role, text))
    said[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == said.keys()
    for c, turns in said.items():
        digest = hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        learned = "".join(b for a, b in turns if a == "assistant")
        assert got[c]["turns_sha256"] == digest and got[c]["n_turns"] == len(turns)
        assert got[c]["loss_chars"] == len(learned)
        assert got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
