"""The registered queries of the training-data operators and their checking SQL."""

import functools

from pyspark.sql import functions as F

from graticule.llm import (
    best_fit, chat, checks, disclosure, language_mix, multi_index, packing, quality_rules, quality_trees,
    simhash, simplex_clusters, toxicity, trie_bpe, turn_repair)
from graticule.llm.common import remainder, short_batches, table
from graticule.session import durable, ship_package

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, folder):
            ship_package(spark)
            short_batches(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return register


def tokenizer(name):
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_quality_rules", checks.QUALITY_RULES)
def op2(spark, folder):
    judged = quality_rules.clean_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *[F.col("judged")[k].alias(k) for k in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "n_failed_lines", "removed_chars")])


@query("op7_packing")
def op7(spark, folder):
    return packing.pack(
        table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), ids=False)


@query("op10_simhash")
def op10(spark, folder):
    return simhash.near_classes(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op1_chat", checks.CHAT)
def op1(spark, folder):
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id bigint, turn bigint, role string, text string")
    done = chat.format_turns(rows.unionByName(extra)).select(
        F.col("tree").alias("conv_id"), "formatted",
        chat.read_back(F.col("formatted")).alias("turns"),
        chat.learned_text(F.col("formatted"), F.col("spans")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("bigint").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"))


@query("op4_trie_bpe")
def op4(spark, folder):
    path = tokenizer("word_bpe_49k.json")
    coded = table(spark, folder, "documents").select(
        "doc_id", trie_bpe.encode(F.col("text"), path).alias("ids"))
    coded = coded.withColumn("decoded", trie_bpe.decode(F.col("ids"), path))
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_multi_index")
def op9(spark, folder):
    return multi_index.nearest(table(spark, folder, "embeddings").select("vec_id", "embedding"))


def language_model(docs):
    """Learned from the rows that are not held out."""
    return language_mix.learn(docs.where(remainder(F.col("doc_id"), 4) != 2))


@query("op8_language_mix")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    found = docs.select(
        "doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        language_mix.identify(F.col("text"), language_model(docs)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


@query("op6_quality_trees")
def op6(spark, folder):
    measured = durable(table(spark, folder, "documents").select(
        "doc_id", quality_trees.measure(F.col("text")).alias("features")))
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = quality_trees.learn(
        measured.where(~held_out), table(spark, folder, "labels").select("doc_id", "quality"))
    scored = measured.select(
        "doc_id", held_out.alias("held_out"),
        quality_trees.score(F.col("features"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


# Words that make a toxic text an example of a category.
TOXIC_WORDS = {
    "insult": ["clown", "idiot", "loser", "moron", "scum"],
    "contempt": ["disgusting", "pathetic", "stupid", "trash", "worthless"],
}


@query("op5_toxicity_chain")
def op5(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    chain = toxicity.learn(docs, labels.where(~held_out), TOXIC_WORDS)
    found = docs.select(
        "doc_id", held_out.alias("held_out"), toxicity.predict(F.col("text"), chain).alias("p"))
    return found.select(
        "doc_id", "held_out", F.col("p.insult").alias("p_insult"),
        F.col("p.contempt").alias("p_contempt"), F.col("p.toxic").alias("score"),
        (F.col("p.toxic") >= 0.5).cast("int").alias("predicted"),
        (F.col("p.toxic") >= 0.5).alias("toxic"))


@query("op3_disclosure")
def op3(spark, folder):
    found = disclosure.find_spans(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[disclosure.count_of(F.col("base"), kind).alias(f"n_{kind}")
                    for kind in disclosure.KINDS],
        F.sha2(disclosure.written(F.col("base")), 256).alias("base_sha256"),
        disclosure.written(F.col("spans")).alias("spans"))


@query("op11_turn_repair")
def op11(spark, folder):
    rows = table(spark, folder, "conversations")
    return turn_repair.audit(turn_repair.damage(rows), rows)


@query("op12_best_fit")
def op12(spark, folder):
    return best_fit.pack_whole(
        table(spark, folder, "documents"), tokenizer("byte_bpe_50k.json"), ids=False).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op13_simplex_clusters", checks.CENTROIDS)
def op13(spark, folder):
    return simplex_clusters.cluster(table(spark, folder, "embeddings"))
