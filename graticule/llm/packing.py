"""Packing token sequences by minimum bin slack.

A document's ids are cut into whole windows and one remainder.  Remainders only
matter by their length, so the plan is made from a histogram of at most ``window``
lengths: a bitset subset-sum dynamic programme picks the multiset of remaining
lengths that holds the longest one and fills the window closest to its capacity, the
counts are read back from the stored bitsets, and the multiset is used as often as
the remaining counts allow.  The plan is a small table of patterns; the pieces of a
length are numbered and looked up in it, which is all that touches the data.
"""

import json
import os
import re
from array import array
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.llm.common import free_name, named
from graticule.llm.trie_bpe import byte_alphabet
from graticule.session import durable

# Fixed value: the pre-token pattern of the byte-level files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders = {}


class TextEncoder:
    """Token ids of whole texts by a byte-level BPE file.

    The file's vocabulary is handed to the faster of two libraries that merge alike;
    special tokens are cut out first, and what that library refuses (very long runs of
    one kind of character) goes to the other.
    """

    def __init__(self, path):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in byte_alphabet().items()}
        ranks = {bytes(map(back.__getitem__, t)): i for t, i in spec["model"]["vocab"].items()}
        self.fast = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.path, self.slow = path, None

    def _plain(self, text):
        try:
            return self.fast(text)
        except BaseException as error:  # a panic of the library is no Exception
            if isinstance(error, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text):
        """Ids of one text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if not any(s in text for s in self.specials):
            return array("I", self._plain(text)).tobytes()
        ids = []
        for part in self.cut.split(text):
            ids += [self.specials[part]] if part in self.specials else self._plain(part)
        return array("I", ids).tobytes()


def encoder(path):
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def window_pieces(text: Column, path: str, window=1024, end_id=0) -> Column:
    """Pieces of each text: (start, length, ids as little-endian unsigned 32-bit, doc_tokens).

    A null or empty text has one token, the end id.
    """

    @F.arrow_udf("array<struct<start:bigint,length:bigint,ids:binary,doc_tokens:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for texts in batches:
            offsets, starts, lengths, blocks, totals = [0], [], [], [], []
            for x in texts:
                ids = tool.ids(x.as_py()) + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    block = ids[4 * start:4 * (start + window)]
                    starts.append(start)
                    lengths.append(len(block) // 4)
                    blocks.append(block)
                    totals.append(total)
                offsets.append(len(starts))
            pieces = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(blocks, pa.binary()), pa.array(totals, pa.int64())],
                names=["start", "length", "ids", "doc_tokens"])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces)

    return run(text)


def fill_window(counts: dict, capacity: int) -> dict:
    """Multiset of the lengths in ``counts`` with the largest sum up to ``capacity``.

    Bit ``s`` of a bitset tells that the sum ``s`` can be reached.  A length is added
    in blocks of 1, 2, 4, ... pieces, so that its count is respected.
    """
    reach, steps = 1, []
    full = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, block = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            block *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            chosen[length] = chosen.get(length, 0) + take
    return chosen


def plan_windows(histogram: dict, window=1024) -> list:
    """[(times, {length: pieces in each window})], longest remaining piece first."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while counts:
        longest = max(counts)
        rest = dict(counts)
        rest[longest] -= 1
        if not rest[longest]:
            del rest[longest]
        chosen = fill_window(rest, window - longest) if longest < window else {}
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in chosen.items())
        plan.append((times, chosen))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
    return plan


def place_pieces(pieces: DataFrame, window=1024, order=("doc_id", "start"), per_bucket=50_000):
    """``pieces`` (with ``length``) with ``sequence_id`` and ``offset`` added.

    Pieces of one length are numbered in buckets by hash, so a frequent length is
    spread over tasks; equal rows take successive places.  The histogram and the plan
    have a few entries per length, however many rows there are.
    """
    bucket, rank, base = (free_name(pieces, x) for x in ("_bucket", "_rank", "_base"))
    total = pieces.count()
    parts = max(16, -(-total // per_bucket))
    keys = [named(c) for c in order]
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(parts)))
    sizes = durable(dealt.groupBy("length", bucket).agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(
        F.sum("n").alias("n")).collect()}
    if not histogram:
        return pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"),
                             F.lit(0).cast("bigint").alias("offset"))
    before = sizes.select("length", bucket, (F.sum("n").over(
        Window.partitionBy("length").orderBy(bucket)) - F.col("n")).alias(base))
    # one slot per (pattern, length): the run of numbered pieces that it takes
    slots, used, sequence = [], {}, 0
    for times, chosen in plan_windows(histogram, window):
        offset = 0
        for length in sorted(chosen, reverse=True):
            n = chosen[length]
            slots.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        sequence += times
    by_length = {}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    spark = pieces.sparkSession
    plan = spark.createDataFrame(
        list(by_length.items()),
        "length bigint, slots array<struct<first:bigint,n:bigint,sequence:bigint,offset:bigint>>")
    numbered = dealt.withColumn(rank, F.row_number().over(
        Window.partitionBy("length", bucket).orderBy(*keys)))
    numbered = numbered.join(F.broadcast(before), ["length", bucket]) if len(histogram) * parts <= (
        100_000) else numbered.join(before, ["length", bucket])
    numbered = numbered.withColumn(rank, F.col(rank) + F.col(base) - 1)
    # at most a row per length: bounded by the window
    numbered = numbered.join(F.broadcast(plan), "length")
    slot = F.array_max(F.filter("slots", lambda s: s["first"] <= F.col(rank)))
    placed = numbered.withColumn("slots", F.array(slot)).withColumn(
        rank, F.col(rank) - F.col("slots")[0]["first"])
    n = F.col("slots")[0]["n"]
    return placed.select(
        *[named(c) for c in pieces.columns],
        (F.col("slots")[0]["sequence"] + F.floor(F.col(rank) / n)).alias("sequence_id"),
        (F.col("slots")[0]["offset"] + F.col(rank) % n * F.col("length")).alias("offset"))


def cut_documents(docs: DataFrame, path: str, key="doc_id", text="text", window=1024, end_id=0):
    """One row per piece: key, start, length, ids (binary), doc_tokens."""
    return docs.select(
        named(key).alias(key),
        F.explode(window_pieces(named(text), path, window, end_id)).alias("_p")
    ).select(key, "_p.*")


def pack(docs: DataFrame, path: str, key="doc_id", text="text", window=1024, end_id=0, ids=True):
    """Every document's pieces with their ids, sequence and offset.

    Without ``ids`` a piece carries the checksum ``ids_crc32`` of its ids instead, and
    the ids themselves stay in the task that made them.
    """
    pieces = cut_documents(docs, path, key, text, window, end_id)
    pieces = pieces.withColumn("ids_crc32", F.crc32("ids"))
    if not ids:
        pieces = pieces.drop("ids")
    return place_pieces(durable(pieces), window, (key, "start", "length", "ids_crc32"))
