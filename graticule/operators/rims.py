"""Water paths over tiles, solved inside each tile and on the graph of the tiles' rims.

Both parts read the grid twice, however long the paths are: a first pass leaves a small
table about each tile's rim, that table is solved as a graph of its own, and a second
pass brings the answer back to the cells.

*Accumulation.*  Inside a tile every path ends at an exit, an outlet or a cell that
drains to another tile.  Exits form a forest, each pointing to the exit that the cell
below it reaches, and sums over that forest enter the tiles again at their rims.

*Filling.*  Inside a tile water floods inwards from the rim, lowest cells first, and
every cell takes the label of the rim cell that it is flooded from (Barnes 2016).  Labels
meet at spill levels, within a tile and across rims.  The level of a label is the lowest
highest spill on any way to the outside; each label takes its lowest spill, and what is
joined that way becomes one, until all are joined to the outside (Boruvka's rounds).
"""

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.focal import TILE, tiled
from graticule.session import discard, stored

OUTSIDE = -(1 << 62)  # label of what drains freely
STEPS = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]


def _downhill(cells, parents):
    """(position of each cell's parent in the tile or -1, waves of cells from the top down)."""
    order = np.argsort(cells)
    at = np.searchsorted(cells, parents, sorter=order)
    found = order[np.minimum(at, len(cells) - 1)]
    below = np.where(cells[found] == parents, found, -1)
    waiting = np.bincount(below[below >= 0], minlength=len(cells))
    waves, ready, seen = [], np.flatnonzero(waiting == 0), 0
    while len(ready):
        waves.append(ready)
        seen += len(ready)
        into = below[ready]
        into = into[into >= 0]
        np.subtract.at(waiting, into, 1)
        into = np.unique(into)
        ready = into[waiting[into] == 0]
    if seen < len(cells):
        raise RuntimeError("the drainage table has a cycle")
    return below, waves


def _accumulate(below, waves, amounts):
    total = amounts.astype(float).copy()
    for wave in waves:
        into = below[wave]
        inside = into >= 0
        np.add.at(total, into[inside], total[wave[inside]])
    return total


def _numbers(table, *names):
    """Columns as arrays; missing numbers become the least long."""
    return [table.column(n).combine_chunks().fill_null(np.iinfo(np.int64).min).to_numpy(
        zero_copy_only=False) for n in names]


PATHS = "cell bigint, parent bigint, r bigint, c bigint, v double, exit bigint, below bigint, total double"


def tile_paths(flow: DataFrame, amount, tile=TILE) -> DataFrame:
    """Each cell with its exit from the tile, the cell below that, and the sum inside the tile."""

    def run(table):
        cells, parents = _numbers(table, "cell", "parent")
        below, waves = _downhill(cells, parents)
        exits = np.arange(len(cells))
        for wave in reversed(waves):
            inside = wave[below[wave] >= 0]
            exits[inside] = exits[below[inside]]
        total = _accumulate(below, waves, table.column("v").to_numpy())
        out = {n: table.column(n) for n in ("cell", "parent", "r", "c", "v")}
        out["exit"] = pa.array(cells[exits])
        out["below"] = table.column("parent").take(pa.array(exits))
        out["total"] = pa.array(total)
        return pa.table(out)

    cells = flow.select(*[F.col(n).cast("bigint").alias(n) for n in ("cell", "parent", "r", "c")],
                        amount.cast("double").alias("v"))
    return stored(cells.groupBy(F.floor(F.col("r") / tile), F.floor(F.col("c") / tile)).applyInArrow(
        run, PATHS))


def exit_forest(paths: DataFrame, tile=TILE) -> DataFrame:
    """The exits as a drainage table of their own: cell, parent, total, and the entry: below, row, col."""
    on_rim = lambda x: F.pmod(F.col(x), F.lit(tile)).isin(0, tile - 1)
    exits = paths.where("cell = exit").select("cell", "below", "total")
    rim = paths.where(on_rim("r") | on_rim("c")).select(
        F.col("cell").alias("below"), F.col("exit").alias("parent"), F.col("r").alias("row"),
        F.col("c").alias("col"))
    forest = stored(exits.join(rim, "below", "left").select(
        "cell", "parent", "total", "below", "row", "col"))
    if not forest.where("below is not null and parent is null").isEmpty():
        raise ValueError("a cell drains to one that is no neighbour in the table")
    return forest


def enter_tiles(paths: DataFrame, inflow: DataFrame, into, tile=TILE) -> DataFrame:
    """Sums of the cells once ``inflow`` (cell, row, col, gain) has come in over the rims."""

    def run(table, gains):
        if not table.num_rows:
            return pa.table({"cell": pa.array([], pa.int64()), into: pa.array([], pa.float64())})
        cells, parents = _numbers(table, "cell", "parent")
        below, waves = _downhill(cells, parents)
        amounts = table.column("v").to_numpy().astype(float).copy()
        if gains.num_rows:
            order = np.argsort(cells)
            at = order[np.searchsorted(cells, gains.column("cell").to_numpy(), sorter=order)]
            amounts[at] += gains.column("gain").to_numpy()
        return pa.table({"cell": pa.array(cells), into: pa.array(_accumulate(below, waves, amounts))})

    tiles = lambda df, r, c: df.groupBy(F.floor(F.col(r) / tile), F.floor(F.col(c) / tile))
    return tiles(paths, "r", "c").cogroup(tiles(inflow, "row", "col")).applyInArrow(run, f"cell bigint, `{into}` double")


def _flood(z, cells, rim, free):
    """Labels, levels and spills of a tile's cells, flooded from its rim.

    ``z`` is the height with a border of NaN, ``rim`` marks the seeds and ``free`` those
    that drain to the outside.
    """
    width = z.shape[1]
    heights, ids = z.ravel().tolist(), cells.ravel().tolist()
    near = [dr * width + dc for dr, dc in STEPS]
    seed, level = rim.ravel().tolist(), [None] * len(heights)
    label = [OUTSIDE if f else None for f in free.ravel().tolist()]
    heap = [(heights[i], i) for i in np.flatnonzero(rim.ravel()).tolist()]
    heapq.heapify(heap)
    spills = {}
    while heap:
        h, i = heapq.heappop(heap)
        if label[i] is None:
            label[i] = ids[i]
        mine, level[i] = label[i], h
        for j in (i + step for step in near):
            zj = heights[j]
            if zj != zj:
                continue
            other = label[j]
            if other is None:
                label[j] = mine
                if not seed[j]:
                    heapq.heappush(heap, (max(zj, h), j))
            elif other != mine:
                pair = (mine, other) if mine < other else (other, mine)
                at = max(h, level[j] if level[j] is not None else zj)
                if at < spills.get(pair, np.inf):
                    spills[pair] = at
    return label, level, spills


FLOOD = "kind int, cell bigint, r bigint, c bigint, z double, w double, label bigint, other bigint"


def flood_tiles(df: DataFrame, z, tile=TILE) -> DataFrame:
    """Flooded cells (kind 0), spills inside tiles (1) and towards cells of others (2)."""
    side = tile + 2

    def run(key, table):
        tr, tc = key[0].as_py(), key[1].as_py()
        r, c, ids = (table.column(n).to_numpy().astype("int64") for n in ("r", "c", "cell"))
        rows, cols = r - tr * tile + 1, c - tc * tile + 1
        height, cells = np.full((side, side), np.nan), np.zeros((side, side), "int64")
        height[rows, cols] = table.column("z").to_numpy(zero_copy_only=False).astype(float)
        cells[rows, cols] = ids
        inner = (rows > 0) & (rows <= tile) & (cols > 0) & (cols <= tile)
        if not inner.any():
            return _flooded([], [])
        core = np.zeros((side, side), bool)
        core[1:-1, 1:-1] = True
        known = ~np.isnan(height)
        around = np.zeros((side, side), "int64")
        for dr, dc in STEPS:
            around[1:-1, 1:-1] += known[1 + dr:side - 1 + dr, 1 + dc:side - 1 + dc]
        free = core & known & (around < 8)
        rim = core & known
        rim[2:-2, 2:-2] = False
        rim |= free
        alone = np.where(core, height, np.nan)
        label, level, spills = _flood(alone, cells, rim, free)
        across = {}
        for i, j in zip(*np.nonzero(rim)):
            for dr, dc in STEPS:
                a, b = i + dr, j + dc
                if core[a, b] or not known[a, b] or cells[i, j] > cells[a, b]:
                    continue
                pair = label[i * side + j], int(cells[a, b])
                at = max(height[i, j], height[a, b])
                across[pair] = min(at, across.get(pair, np.inf))
        own = [(0, int(n), int(y), int(x), None if zz != zz else zz, level[p], label[p], None)
               for n, y, x, zz, p in zip(ids[inner], r[inner], c[inner], height[rows, cols][inner].tolist(),
                                         (rows * side + cols)[inner].tolist())]
        edges = [(1, a, b, w) for (a, b), w in spills.items()] + [
            (2, a, b, w) for (a, b), w in across.items()]
        return _flooded(own, edges)

    cells = df.select("cell", "r", "c", F.col(z).cast("double").alias("z"))
    return stored(tiled(cells, 1, tile).groupBy("_tr", "_tc").applyInArrow(run, FLOOD))


def _flooded(own, edges):
    rows = own + [(k, None, None, None, None, w, a, b) for k, a, b, w in edges]
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    names = ["kind", "cell", "r", "c", "z", "w", "label", "other"]
    return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 8, kinds)], names=names)


def spill_levels(spills: DataFrame) -> DataFrame:
    """Lowest highest spill from each label to the outside: (label, level).

    Spills along a chain of lowest spills never rise, so a label's own lowest spill is
    the level that its way to the chain's end needs.
    """
    both = spills.select(F.explode(F.array(
        F.struct(F.col("a"), F.col("b"), F.col("w")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w")))).alias("e")).select("e.*")
    links = stored(both.where("a <> b").groupBy("a", "b").agg(F.min("w").alias("w")))
    state = stored(links.where(F.col("a") != OUTSIDE).select(
        F.col("a").alias("label")).distinct().select(
        "label", F.col("label").alias("group"), F.lit(None).cast("double").alias("level")))
    while True:
        low = stored(links.where(F.col("a") != OUTSIDE).groupBy("a").agg(F.min(F.struct(
            "w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "b")).alias("e")).select(
            "a", F.col("e.b").alias("b"), F.col("e.w").alias("w")))
        if low.isEmpty():
            return state.select("label", "level")
        back = low.select(F.col("a").alias("b"), F.col("b").alias("_back"))
        root = (F.col("_back") == F.col("a")) & (F.col("a") < F.col("b"))
        to = stored(low.join(back, "b", "left").select(
            "a", F.when(root, F.col("a")).otherwise(F.col("b")).alias("to"),
            F.when(~F.coalesce(root, F.lit(False)), F.col("w")).alias("w")))
        while True:  # pointers double
            hop = to.select(F.col("a").alias("to"), F.col("to").alias("_next"))
            after = stored(to.join(hop, "to", "left").select(
                "a", F.coalesce("_next", "to").alias("to"), "w", (F.col("_next") != F.col("to")).alias("_new")))
            discard(to)
            to = after.drop("_new")
            if after.where("_new").isEmpty():
                break
        step = to.select(F.col("a").alias("group"), F.col("to").alias("_to"), F.col("w").alias("_w"))
        new_state = stored(state.join(step, "group", "left").select(
            "label", F.coalesce("_to", "group").alias("group"), F.greatest("level", "_w").alias("level")))
        end = lambda c: to.select(F.col("a").alias(c), F.col("to").alias(f"_{c}"))
        new_links = stored(links.join(end("a"), "a", "left").join(end("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "w").where("a <> b").groupBy(
            "a", "b").agg(F.min("w").alias("w")))
        discard(state, links, low, after)
        state, links = new_state, new_links


def fill(df: DataFrame, z="z", tile=TILE) -> DataFrame:
    """(cell, r, c, z, filled): the lowest surface over ``z`` on which every cell drains."""
    flooded = flood_tiles(df, z, tile)
    cells = flooded.where("kind = 0")
    on_rim = lambda x: F.pmod(F.col(x), F.lit(tile)).isin(0, tile - 1)
    rim = cells.where(on_rim("r") | on_rim("c")).select(
        F.col("cell").alias("other"), F.col("label").alias("b"))
    across = flooded.where("kind = 2").select("label", "other", "w").join(rim, "other").select(
        F.col("label").alias("a"), "b", "w")
    inside = flooded.where("kind = 1").select(F.col("label").alias("a"), F.col("other").alias("b"), "w")
    levels = spill_levels(inside.unionByName(across))
    # what drains to the outside is as it should be, and would be one hot key
    held = cells.where(F.col("label") != OUTSIDE).join(levels, "label", "left").select(
        "cell", "r", "c", "z", F.greatest("w", "level").alias("filled"))
    rest = cells.where(F.coalesce(F.col("label") == OUTSIDE, F.lit(True)))
    return held.unionByName(rest.select("cell", "r", "c", "z", F.col("w").alias("filled"))).withColumnRenamed(
        "z", z)
