import random

from pyspark.sql import functions as F

from graticule.llm import simhash
from helpers import LONG, awkward, empty


def brute_classes(prints, budget=4):
    """``prints``: [(key, fingerprint)]; smallest key reachable for each."""
    order = sorted(range(len(prints)), key=lambda i: (prints[i][0] is None, prints[i][0] or 0))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in order:
        for j in order:
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= budget:
                a, b = find(i), find(j)
                if a != b:
                    low = a if order.index(a) < order.index(b) else b
                    root[a] = root[b] = low
    return [prints[find(i)][0] for i in range(len(prints))]


def test_links_are_complete(spark):
    rng = random.Random(4)
    values = []
    for _ in range(30):
        value = rng.getrandbits(64)
        for _ in range(12):  # chains that drift away from their beginning
            values.append(value)
            for b in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << b
    values += [0, 1, 3, 7, 15, 31, (1 << 64) - 1, (1 << 64) - 16]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    got = {tuple(r) for r in simhash.near_pairs(df).collect()}
    want = {(a, b) for a in signed for b in signed
            if a < b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4}
    assert got == want
    assert simhash.near_pairs(df).count() == len(want)  # each once


def test_classes(spark):
    docs = awkward(spark, [(30, LONG.replace("word5 ", "other ", 3)), (31, "x y"), (31, "q r s t u")])
    rows = simhash.near_classes(docs).collect()
    assert len(rows) == docs.count()
    mask = (1 << 64) - 1
    texts = sorted((r["doc_id"] is None, r["doc_id"] or 0, simhash.fingerprint_of(r["text"]))
                   for r in docs.select("doc_id", "text").collect())
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"] & mask) for r in rows)
    assert got == texts
    prints = [(r["doc_id"], r["fp"] & mask) for r in rows]
    assert [r["component_id"] for r in rows] == brute_classes(prints)
    one = simhash.keep_one(docs)
    assert one.columns == docs.columns
    assert one.count() == len({(r["component_id"], ) for r in rows if r["doc_id"] != 31}) + len(
        {r["fp"] for r in rows if r["doc_id"] == 31})


def test_chain_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (55, 60)],
                                  "src bigint, dst bigint")
    got = {r["id"]: r["component"] for r in simhash.components(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 50: 50, 55: 50, 60: 50}
    assert simhash.components(pairs.limit(0)).count() == 0


def test_empty(spark):
    assert simhash.near_classes(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_hash_is_the_engines(spark):
    import xxhash

    text = "a bc def g"
    got = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()["h"]
    assert got & ((1 << 64) - 1) == xxhash.xxh64_intdigest(text, 42)
