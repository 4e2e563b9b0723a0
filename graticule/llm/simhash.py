"""SimHash fingerprints and near duplicates by pigeonring filtering.

A fingerprint has 64 bits over word shingles.  Two fingerprints link at ``budget`` or
fewer differing bits.  The bits are cut into ``budget + 1`` segments laid on a ring.
If two fingerprints link, some segment starts a chain on the ring in which every
prefix of ``l`` segments differs in at most ``l * budget / segments`` bits (Qin and Xiao
2018).  So the first segment of that chain is equal and its successor differs in at
most one bit, that is, one half of the successor is equal too: fingerprints meet on
(segment, successor's half) and the whole chain is checked before the full distance.

Equal fingerprints are one node, so copies are never expanded into pairs.  A null or
empty text has the fingerprint zero, which links like any other.
"""

from itertools import accumulate
from typing import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.llm.common import free_name, named
from graticule.session import durable

BITS = 64


def fingerprint_of(text, shingle=4, seed=42):
    """Fingerprint of one text as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        ends, starts = [len(joined) + 1], [0]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts, ends = [0, *ends[:-1]], ends[shingle - 1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b - 1], seed) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[k:k + 4096].view(np.uint8), bitorder="little")
        ones += bits.reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(text: Column, shingle=4, seed=42) -> Column:
    """Fingerprints as signed 64-bit numbers."""

    @F.arrow_udf("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [fingerprint_of(x.as_py(), shingle, seed) for x in texts]
            yield pa.array(np.array(found, dtype="<u8").view("<i8"))

    return run(text)


def segments(budget: int):
    """(first bit, width) of the segments on the ring."""
    n = budget + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _bits(value: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _meeting_keys(value: Column, budget: int) -> Column:
    ring = segments(budget)
    keys = []
    for k in range(len(ring)):
        first, width = ring[k]
        after, size = ring[(k + 1) % len(ring)]
        low = size // 2
        for half, (start, bits) in enumerate(((after, low), (after + low, size - low))):
            keys.append(F.struct(
                F.lit(2 * k + half).cast("tinyint").alias("t"),
                F.shiftleft(_bits(value, first, width), bits)
                .bitwiseOR(_bits(value, start, bits)).cast("int").alias("k")))
    return F.array(*keys)


def _first_meeting(a: Column, b: Column, budget: int) -> Column:
    """Number of the first key at which the chain holds and the keys are equal.

    Null if there is none.  A pair is taken at that key alone, so it comes once.
    """
    ring = segments(budget)
    n = len(ring)
    differ = a.bitwiseXOR(b)
    gaps = [F.bit_count(_bits(differ, *s)) for s in ring]
    tried = []
    for k in range(n):
        total, ok = gaps[k], gaps[k] == 0
        for length in range(2, n + 1):
            total = total + gaps[(k + length - 1) % n]
            ok = ok & (total * n <= length * budget)
        after, size = ring[(k + 1) % n]
        low = size // 2
        for half, (start, bits) in enumerate(((after, low), (after + low, size - low))):
            tried.append(F.when(ok & (_bits(differ, start, bits) == 0), F.lit(2 * k + half)))
    return F.coalesce(*tried)


def near_pairs(prints: DataFrame, budget=4, column="fp") -> DataFrame:
    """Pairs (src < dst) of different fingerprints at ``budget`` or fewer bits."""
    if not 2 <= budget <= 15:
        raise ValueError("the budget must lie between 2 and 15 bits")
    keyed = prints.where(named(column).isNotNull()).select(named(column).alias("fp")).distinct()
    keyed = keyed.select("fp", F.explode(_meeting_keys(F.col("fp"), budget)).alias("m")).select(
        "m.t", "m.k", "fp")
    a = keyed.select("t", "k", F.col("fp").alias("src"))
    b = keyed.select("t", "k", F.col("fp").alias("dst"))
    src, dst = F.col("src"), F.col("dst")
    near = a.join(b, [
        a["t"] == b["t"], a["k"] == b["k"], src < dst,
        F.bit_count(src.bitwiseXOR(dst)) <= budget,
        _first_meeting(src, dst, budget) == a["t"],
    ])
    return near.select("src", "dst")


def components(pairs: DataFrame) -> DataFrame:
    """(id, component): smallest id of each component of the graph of (src, dst).

    In each round every node points to its smallest neighbour, if that is smaller;
    pointers are doubled until they end in roots, and the links between different
    roots go to the next round.  Links within a dense group are gone after one round.
    """
    levels = []
    links = pairs
    while not links.isEmpty():
        ends = links.select("src", "dst").union(
            links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        tree = durable(ends.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("low")).select(
            "id", F.least("id", "low").alias("root")))
        while True:
            above = tree.select(F.col("id").alias("root"), F.col("root").alias("higher"))
            jumped = durable(tree.join(above, "root").select(
                "id", F.col("root").alias("was"), F.col("higher").alias("root")))
            tree = jumped.select("id", "root")
            if jumped.where(F.col("was") != F.col("root")).isEmpty():
                break
        levels.append(tree)
        links = durable(links.join(
            tree.select(F.col("id").alias("src"), F.col("root").alias("a")), "src").join(
            tree.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst").where(
            F.col("a") != F.col("b")).select(
            F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
    if not levels:
        return pairs.select(F.col("src").alias("id"), F.col("dst").alias("component")).limit(0)
    found = levels[0].select("id", F.col("root").alias("component"))
    for tree in levels[1:]:
        step = tree.select(F.col("id").alias("component"), F.col("root").alias("_next"))
        found = found.join(step, "component", "left").select(
            "id", F.coalesce("_next", "component").alias("component"))
    return found


def _classes(docs, key, text, budget, shingle, seed):
    """(rows with fingerprints, fingerprint -> component), both materialised or small."""
    prints = durable(docs.select(
        named(key).alias("_key"), F.xxhash64(named(text)).alias("_text"),
        fingerprints(named(text), shingle, seed).alias("_fp")))
    # the first row of a fingerprint: smallest key, null last, then the text's hash
    row = F.struct(F.col("_key").isNull().alias("last"), F.col("_key").alias("key"),
                   F.col("_text").alias("text"))
    nodes = durable(prints.groupBy(F.col("_fp").alias("id")).agg(F.min(row).alias("first")))
    pairs = durable(near_pairs(nodes, budget, "id"))
    # only fingerprints with a link can be in a larger component
    known = nodes.join(components(pairs), "id", "left")
    least = known.where(F.col("component").isNotNull()).groupBy("component").agg(
        F.min("first").alias("least"))
    return prints, known.join(least, "component", "left").select(
        F.col("id").alias("_fp"), F.coalesce("least", "first").alias("_first"))


def near_classes(docs: DataFrame, key="doc_id", text="text", budget=4, shingle=4, seed=42):
    """(key, fp, component_id): one row per row of ``docs``.

    ``component_id`` is the smallest key reachable over links, the own one included;
    null keys take part and count as larger than any other.
    """
    prints, parts = _classes(docs, key, text, budget, shingle, seed)
    return prints.join(parts, "_fp").select(
        F.col("_key").alias(key), F.col("_fp").alias("fp"),
        F.col("_first.key").alias("component_id"))


def keep_one(docs: DataFrame, key="doc_id", text="text", budget=4, shingle=4, seed=42) -> DataFrame:
    """One row of each group of near duplicates, with the columns of ``docs``.

    The row with the smallest key stays, a null key being larger than any other; of
    rows that share it, the text with the smallest hash, and of equal rows one.
    """
    columns = docs.columns
    _, parts = _classes(docs, key, text, budget, shingle, seed)
    mark, order = free_name(docs, "_first"), free_name(docs, "_order")
    firsts = parts.select(F.col("_first").alias(mark)).distinct()
    kept = docs.join(firsts, [
        named(key).eqNullSafe(F.col(mark)["key"]),
        F.xxhash64(named(text)) == F.col(mark)["text"]], "left_semi")
    same = Window.partitionBy(named(key), F.xxhash64(named(text))).orderBy(
        F.xxhash64(*[named(c) for c in columns if c not in (key, text)], F.lit(0)))
    return kept.withColumn(order, F.row_number().over(same)).where(F.col(order) == 1).select(
        *[named(c) for c in columns])
