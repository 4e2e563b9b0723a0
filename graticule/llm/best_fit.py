"""Best-fit packing of whole documents by minimum bin slack.

A document stays whole unless it is longer than a sequence; then it is cut into full
sequences after a first piece that takes the odd rest.  Only lengths matter for the
plan, so it is made from a histogram of at most ``window`` lengths: for each bin a bitset
subset-sum dynamic programme over the lengths still in stock finds the fullest feasible
combination, counts are backtracked through the stored bitsets, and the combination is
removed from the stock, as often as the stock allows, since the same bin would be the
fullest again.  Two plans are made, with the longest piece in stock set first (Fleszar
and Hindi 2002) or with every piece free, and the one with fewer bins is used.

Pieces of one length are numbered in buckets of bounded size by a number that each row
gets when it is stored, so a frequent length and wholly repeated rows are spread evenly;
a piece's number finds its bin and its place there by binary search in the plan.

Null and empty texts have one token, the end id.  Very long texts give one row for each
piece.  Repeated rows and ids, null ids too, are packed one by one; which of several
pieces of the same length takes which place follows the stored order.  An empty table
gives no rows.  Columns other than the key and the text are not read.
"""

import zlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from graticule.llm.common import named
from graticule.llm.packing import encoder
from graticule.session import durable

COLUMNS = ("piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def whole_pieces(text: Column, path: str, window=2048, end_id=0, ids=True) -> Column:
    """(piece, start, length, ids_crc32, ids) of each text; only the first may be short."""
    kind = "piece:int,start:bigint,length:bigint,ids_crc32:bigint" + (",ids:binary" if ids else "")

    @F.arrow_udf(f"array<struct<{kind}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tool = encoder(path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for texts in batches:
            ends, rows = [0], []
            for x in texts:
                block = tool.ids(x.as_py()) + end
                total = len(block) // 4
                cuts = [0, *range((total - 1) % window + 1, total + 1, window)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = block[4 * a:4 * b]
                    rows.append((i, a, b - a, zlib.crc32(part), part))
                ends.append(len(rows))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["piece", "start", "length", "ids_crc32", "ids"]
            n = 5 if ids else 4
            pieces = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns[:n], kinds)], names=names[:n])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces)

    return run(text)


def fullest(stock: dict, room: int) -> dict:
    """{length: count} of the fullest combination of ``stock`` in ``room``, long ones preferred.

    Bit ``s`` of a layer's bitset tells that ``s`` can be filled by the lengths before it.
    """
    reach, layers, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted((n for n in stock if n <= room), reverse=True):
        layers.append((length, reach))
        shifted = reach
        for _ in range(min(stock[length], room // length)):
            shifted = (shifted << length) & mask
            if not shifted:
                break
            reach |= shifted
        if reach >> room:
            break
    total, counts = reach.bit_length() - 1, {}
    for length, before in reversed(layers):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            counts[length] = n
    return counts


def fill_bins(histogram: dict, window: int, longest_first: bool) -> list:
    """[(bins, {length: pieces in each})] that use up the whole histogram."""
    stock, plan = {k: n for k, n in histogram.items() if n > 0}, []
    while stock:
        if longest_first:
            seed = max(stock)
            stock[seed] -= 1
            counts = fullest({k: n for k, n in stock.items() if n}, window - seed)
            stock[seed] += 1
            counts[seed] = counts.get(seed, 0) + 1
        else:
            counts = fullest(stock, window)
        bins = min(stock[k] // n for k, n in counts.items())
        plan.append((bins, counts))
        for k, n in counts.items():
            stock[k] -= bins * n
            if not stock[k]:
                del stock[k]
    return plan


def plan_bins(histogram: dict, window=2048) -> list:
    """The plan with fewer bins; the longest piece first on a tie."""
    plans = [fill_bins(histogram, window, first) for first in (True, False)]
    return min(plans, key=lambda plan: sum(bins for bins, _ in plan))


def places(plan: list):
    """The plan as sorted arrays: (length, first number) -> pieces a bin, first bin, offset."""
    rows, used, sequence = [], {}, 0
    for bins, counts in plan:
        offset = 0
        for length in sorted(counts, reverse=True):
            n = counts[length]
            rows.append((length, used.get(length, 0), n, sequence, offset))
            used[length] = used.get(length, 0) + n * bins
            offset += n * length
        sequence += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def place(pieces: DataFrame, window=2048, per_bucket=50_000) -> DataFrame:
    """Stored ``pieces`` (``length`` and a distinct ``_row``) with sequence_id and offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    length, first, count, sequence, offset = places(plan_bins(histogram, window))
    shift = np.int64(max(histogram.values(), default=0) + 1)
    keys = length * shift + first

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def find(lengths: pa.Array, numbers: pa.Array) -> pa.Array:
        size, number = (x.to_numpy(zero_copy_only=False) for x in (lengths, numbers))
        i = np.searchsorted(keys, size * shift + number, side="right") - 1
        number = number - first[i]
        return pa.StructArray.from_arrays(
            [pa.array(sequence[i] + number // count[i]),
             pa.array(offset[i] + number % count[i] * size)], names=["sequence_id", "offset"])

    buckets = spark.createDataFrame(
        [(k, -(-n // per_bucket)) for k, n in histogram.items()], "length bigint, _buckets bigint")
    # a row per length, so no more than the window holds
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn(
        "_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets"))).drop("_buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(
        Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_number", F.row_number().over(
        Window.partitionBy("length", "_bucket").orderBy("_row")))
    numbered = numbered.join(before, ["length", "_bucket"])
    found = numbered.withColumn("_at", find(
        F.col("length"), F.col("_number") + F.col("_before") - 1))
    return found.select(*pieces.drop("_row").columns, "_at.sequence_id", "_at.offset")


def pack_whole(docs: DataFrame, path: str, key="doc_id", text="text", window=2048, end_id=0,
               ids=True) -> DataFrame:
    """Every document's pieces: key, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Without ``ids`` the ids stay in the task that made them.  A key with the name of
    another result column is refused.
    """
    if key.lower() in COLUMNS:
        raise ValueError(f"rename the key column: {key} is a column of the result")
    pieces = docs.select(
        named(key).alias("_key"),
        F.explode(whole_pieces(named(text), path, window, end_id, ids)).alias("_p"),
    ).select("_key", "_p.*").withColumn("_row", F.monotonically_increasing_id())
    return place(durable(pieces), window).withColumnRenamed("_key", key)
