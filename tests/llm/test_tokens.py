import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graticule.llm import packing, trie_bpe
from helpers import awkward, empty

WORDS, BYTES = map(public_tokenizers.path, ("word_bpe_49k.json", "byte_bpe_50k.json"))
PIECES = [" ", "  ", "\n", "\t", "\x85", "\xa0", "　", "\x1c", "a", "the", "Thing", "é", "ß", "Σ", "1", "٣",
          "!", "...", "'s", "'S", "<|endoftext|>", "<|endof", "<|startoftext|>", "😀", "日本", "é", "\x00",
          "Ⅷ", "²", "ation", "ing", "internation"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(n)]


def test_trie_encodes_as_the_library():
    mine, library = trie_bpe.TrieCodec(WORDS), Tokenizer.from_file(WORDS)
    rows = texts(4000, 1) + ["a" * 3000, "th" * 2000, "Hello wörld, it's fine"]
    got = mine.encode(rows)
    for text, ids, want in zip(rows, got, library.encode_batch(rows, add_special_tokens=False)):
        ids = np.frombuffer(ids, "<i4").tolist()
        assert ids == want.ids, text
        assert mine.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


def test_small_store(monkeypatch):
    monkeypatch.setattr(trie_bpe, "CACHE_WORDS", 50)
    mine, library = trie_bpe.TrieCodec(WORDS), Tokenizer.from_file(WORDS)
    for k in range(5):
        rows = texts(40, 10 + k)
        want = [e.ids for e in library.encode_batch(rows, add_special_tokens=False)]
        assert [np.frombuffer(x, "<i4").tolist() for x in mine.encode(rows)] == want


def test_columns(spark):
    docs = awkward(spark)
    library = Tokenizer.from_file(WORDS)
    rows = docs.select("text", trie_bpe.encode(F.col("text"), WORDS).alias("ids")).withColumn(
        "back", trie_bpe.decode(F.col("ids"), WORDS)).collect()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want
        assert r["back"] == library.decode(want, skip_special_tokens=False)
    assert empty(spark).select(trie_bpe.encode(F.col("text"), WORDS)).count() == 0


def test_text_encoder():
    mine, library = packing.TextEncoder(BYTES), Tokenizer.from_file(BYTES)
    rows = texts(4000, 2) + ["a" * 100_000, " " * 100_000 + "x", "\n" * 30_000]
    for text, want in zip(rows, library.encode_batch(rows, add_special_tokens=False)):
        assert np.frombuffer(mine.ids(text), "<u4").tolist() == want.ids, text[:80]


def test_fill_window_is_best():
    rng = random.Random(3)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        capacity = rng.randint(1, 60)
        sums = {0}
        for length, n in counts.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        chosen = packing.fill_window(counts, capacity)
        assert all(chosen[k] <= counts[k] for k in chosen)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= capacity)


def test_plan_uses_everything():
    histogram = {3: 10, 7: 5, 16: 2, 1: 4, 5: 1}
    plan = packing.plan_windows(histogram, 16)
    used = {}
    for times, chosen in plan:
        assert sum(k * n for k, n in chosen.items()) <= 16
        for k, n in chosen.items():
            used[k] = used.get(k, 0) + n * times
    assert used == histogram


def test_pack(spark):
    docs = awkward(spark)
    library = Tokenizer.from_file(BYTES)
    rows = packing.pack(docs, BYTES).collect()
    seen = {}
    for r in rows:
        assert len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        assert r["offset"] + r["length"] <= 1024
        seen.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
    want = sorted(len(library.encode(t["text"] or "", add_special_tokens=False).ids) + 1
                  for t in docs.select("text").collect())
    assert sum(want) == sum(r["length"] for r in rows)
    assert sorted(r["doc_tokens"] for r in rows if r["start"] == 0) == want
    assert packing.pack(empty(spark), BYTES).count() == 0


def test_pack_fills(spark, small):
    from graticule.llm.queries import QUERIES

    rows = QUERIES["op7_packing"](spark, small).collect()
    windows = {r["sequence_id"] for r in rows}
    total = sum(r["length"] for r in rows)
    assert total / (1024 * len(windows)) > 0.95
    assert len({(r["doc_id"], r["start"]) for r in rows}) == len(rows)
