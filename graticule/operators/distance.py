"""Distances on the grid: to the nearest feature, and nearest cells."""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators.focal import TILE, focal_apply
from graticule.session import durable

ROW_BLOCK = 32


def nearest_distance(grid: DataFrame, feature, into="distance") -> DataFrame:
    """Exact Euclidean distance in cells to the nearest feature cell.

    ``grid`` holds the cells asked for, with gaps or without; ``feature`` is a boolean
    column.  For blocks of rows, each column with a feature brings its features in the
    block and the nearest ones above and below.  That gives the vertical gap at every
    row of the block, stored or not, and along a row the smallest ``dx^2 + gap^2`` is
    read from the lower envelope of the columns' parabolas, in time linear in their
    number.  A group is bounded by the block's rows times the raster's width.  NULL
    when there is no feature at all.
    """
    block = F.floor(F.col("r") / ROW_BLOCK).cast("long")
    cells = grid.select(F.col("cell").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"),
                        block.alias("_block"))
    hits = grid.where(F.col(feature)).groupBy(
        F.col("c").cast("long").alias("c"), block.alias("_block")
    ).agg(F.collect_set(F.col("r").cast("long")).alias("_rows"))  # at most the block's rows
    ends = cells.agg(F.min("_block").alias("a"), F.max("_block").alias("b"))
    every = hits.select("c").distinct().withColumn(
        "_ends", ends.select(F.struct("a", "b")).scalar()
    ).select("c", F.explode(F.sequence("_ends.a", "_ends.b")).alias("_block"))
    along = Window.partitionBy("c").orderBy("_block")
    columns = every.join(hits, ["c", "_block"], "left").select(
        F.col("c").alias("_c"), F.col("_block").alias("_at"), "_rows",
        F.last(F.array_max("_rows"), ignorenulls=True).over(
            along.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
        F.first(F.array_min("_rows"), ignorenulls=True).over(
            along.rowsBetween(1, Window.unboundedFollowing)).alias("_below"))
    # a column's block without any feature before, inside or behind does not exist
    columns = columns.select("_c", "_at", "_above", "_below", F.coalesce(
        "_rows", F.array().cast("array<bigint>")).alias("_rows"))

    def run(table, near):
        r, c = table.column("r").to_numpy(), table.column("c").to_numpy()
        d = np.full(len(r), np.nan)
        if table.num_rows and near.num_rows:
            order = np.argsort(near.column("_c").to_numpy())
            xs = near.column("_c").to_numpy()[order]
            above, below = (near.column(n).to_numpy(zero_copy_only=False).astype(float)[order]
                            for n in ("_above", "_below"))
            inside = near.column("_rows").to_pylist()
            inside = [inside[i] for i in order]
            owner = np.repeat(np.arange(len(xs)), [len(i) for i in inside])
            rows = np.array([v for i in inside for v in i], dtype=float)
            for row in np.unique(r):
                gap = np.fmin(np.where(np.isnan(above), np.inf, row - above),
                              np.where(np.isnan(below), np.inf, below - row))
                np.minimum.at(gap, owner, np.abs(rows - row))
                at = np.nonzero(r == row)[0]
                d[at] = np.sqrt(_envelope(xs, gap ** 2, c[at]))
        return pa.table({"cell": table.column("cell"), "r": r, "c": c,
                         into: pa.array(d, mask=np.isnan(d))})

    schema = f"cell bigint, r bigint, c bigint, {into} double"
    return cells.groupBy("_block").cogroup(columns.groupBy("_at")).applyInArrow(run, schema)


def _envelope(xs, heights, ask):
    """min over j of (x - xs[j])^2 + heights[j] for each x of ``ask`` (Felzenszwalb 2012)."""
    kept, begins = [], []
    tops = (heights + xs.astype(float) ** 2).tolist()
    places = xs.tolist()
    for j, (x, top) in enumerate(zip(places, tops)):
        begin = -np.inf
        while kept:
            k = kept[-1]
            begin = (top - tops[k]) / (2 * (x - places[k]))
            if begin > begins[-1]:
                break
            kept.pop()
            begins.pop()
        kept.append(j)
        begins.append(begin if len(kept) > 1 else -np.inf)
    of = np.array(kept)[np.searchsorted(begins, ask, side="right") - 1]
    return (ask - xs[of]) ** 2 + heights[of]


def _offsets(radius):
    steps = range(-radius, radius + 1)
    return sorted(
        (dr * dr + dc * dc, dr, dc) for dr in steps for dc in steps
        if 0 < dr * dr + dc * dc <= radius * radius)


def knn_coords(df: DataFrame, k=8, width=None, radius=3, tile=TILE) -> DataFrame:
    """The k nearest present cells of each cell: (cell, nbr, rank, w).

    Ties go by row, then column.  Within a reach of ``radius`` nothing nearer
    can be missed; cells with fewer than k neighbours there are searched again
    with twice the reach, so a gap costs only the cells around it.
    """
    total = df.count()
    k = min(k, total - 1)
    kind = T.ArrayType(T.LongType())
    parts, open_cells = [], None
    while True:
        found = _ring_search(df, open_cells, k, width, radius, tile, kind)
        found = durable(found)
        parts.append(found.where(F.size("nbrs") == k))
        rest = found.where(F.size("nbrs") < k)
        if rest.isEmpty():
            break
        open_cells = rest.select("cell")
        radius *= 2
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select("cell", F.posexplode("nbrs").alias("_i", "nbr")).select(
        "cell", "nbr", (F.col("_i") + 1).alias("rank"), F.lit(1.0 / k).alias("w"))


def _ring_search(df, only, k, width, radius, tile, kind):
    steps = _offsets(radius)
    side = max(tile, radius)  # a tile's copies must reach only its neighbours

    def run(present, grids):
        h = radius
        core = present[h:h + side, h:h + side]
        ask = core & (grids["_ask"][h:h + side, h:h + side] > 0)
        rows, cols = np.nonzero(ask)
        out = np.full((side, side, k), np.nan)
        filled = np.zeros(len(rows), int)
        found = np.full((len(rows), k), np.nan)
        base = grids["_cell"][h:h + side, h:h + side][rows, cols]
        for _, dr, dc in steps:
            hit = present[rows + h + dr, cols + h + dc] & (filled < k)
            at = np.nonzero(hit)[0]
            found[at, filled[at]] = base[at] + dr * width + dc
            filled[at] += 1
            if (filled == k).all():
                break
        out[rows, cols] = found
        return {"nbrs": out}

    work = df.select("cell", "r", "c", F.col("cell").alias("_cell"))
    if only is None:
        work = work.withColumn("_ask", F.lit(1.0))
    else:
        work = work.join(only.withColumn("_ask", F.lit(1.0)), "cell", "left").fillna(0.0, ["_ask"])
    found = focal_apply(work, ["_cell", "_ask"], run, {"nbrs": kind}, radius, side)
    if only is not None:
        found = found.join(only, "cell", "left_semi")
    return found.select("cell", F.filter("nbrs", lambda n: n.isNotNull()).alias("nbrs"))
