"""Whole documents in few sequences: plans against exhaustive search, pieces against the library."""

import functools
import itertools
import random
import zlib
from collections import Counter

import numpy as np
from helpers import awkward, empty
from pyspark.sql import functions as F

from graticule.llm import best_fit
from graticule.llm.queries import QUERIES, tokenizer

FILE = "byte_bpe_50k.json"


@functools.cache
def library():
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer(FILE))
    tool.no_truncation()
    tool.no_padding()
    return tool


def ids_of(text):
    return library().encode(text or "", add_special_tokens=False).ids + [0]


def check_layout(rows, window):
    """Every sequence is gapless from 0 and within the window."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= window
    return len(by_sequence)


def expected(docs, window):
    out = Counter()
    for key, text in docs:
        ids = ids_of(text)
        first = (len(ids) - 1) % window + 1
        cuts = [0, *range(first, len(ids) + 1, window)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            out[key, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    return out


def test_fullest_against_all_combinations():
    rng = random.Random(4)
    for _ in range(300):
        stock = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        room = rng.randint(0, 40)
        best = max((s for s in (sum(n * k for n, k in zip(stock, take)) for take in itertools.product(
            *(range(n + 1) for n in stock.values()))) if s <= room), default=0)
        found = best_fit.fullest(stock, room)
        assert sum(k * n for k, n in found.items()) == best
        assert all(n <= stock[k] for k, n in found.items())


def fewest(pieces, window):
    """Fewest bins by search over all partitions."""
    best = len(pieces)

    def go(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for room in set(bins):
            if room >= pieces[i]:
                rest = list(bins)
                rest.remove(room)
                go(i + 1, [*rest, room - pieces[i]])
        go(i + 1, [*bins, window - pieces[i]])

    go(0, [])
    return best


def test_plans_use_everything_in_few_bins():
    rng = random.Random(9)
    over = 0
    for _ in range(60):
        pieces = sorted((rng.randint(1, 30) for _ in range(8)), reverse=True)
        plan = best_fit.plan_bins(dict(Counter(pieces)), 30)
        used = Counter()
        for bins, counts in plan:
            assert sum(k * n for k, n in counts.items()) <= 30
            for k, n in counts.items():
                used[k] += bins * n
        assert used == Counter(pieces)
        over += sum(bins for bins, _ in plan) - fewest(pieces, 30)
    assert over <= 2


def test_given_table(spark, small):
    rows = QUERIES["op12_best_fit"](spark, small).collect()
    docs = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select(
        "doc_id", "text").collect()]
    assert Counter(tuple(r)[:5] for r in rows) == expected(docs, 2048)
    used = check_layout(rows, 2048)
    assert used <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_awkward_rows(spark):
    docs = awkward(spark).withColumn("piece", F.lit("x")).withColumn("_row", F.lit("y"))
    for window, per_bucket in ((2048, 50_000), (7, 3)):
        pieces = docs.select("doc_id", F.explode(best_fit.whole_pieces(
            F.col("text"), tokenizer(FILE), window)).alias("p")).select("doc_id", "p.*")
        pieces = best_fit.durable(pieces.withColumn("_row", F.monotonically_increasing_id()))
        rows = best_fit.place(pieces, window, per_bucket).collect()
        given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
                       for r in rows) == expected(given, window)
        check_layout(rows, window)
        assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in rows)
    found = best_fit.pack_whole(docs, tokenizer(FILE))
    assert found.columns == ["doc_id", *best_fit.COLUMNS]


def test_wholly_repeated_rows_spread(spark):
    docs = spark.createDataFrame([(None, "same words")] * 500, "doc_id bigint, text string")
    rows = best_fit.pack_whole(docs, tokenizer(FILE), window=16, ids=False).collect()
    size = len(ids_of("same words"))
    assert len(rows) == 500 and check_layout(rows, 16) == -(-500 // (16 // size))


def test_empty(spark):
    assert best_fit.pack_whole(empty(spark), tokenizer(FILE)).count() == 0
