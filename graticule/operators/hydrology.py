"""Drainage on the grid: filling, accumulation, basins, stream order.

Water paths cross the whole raster, so these are iterative.  Every step halves
what is left (pointer doubling: rounds grow with the logarithm of the longest
path) or solves whole tiles at once, and each round ends in a checkpoint.
"""

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators import rims, stream_order
from graticule.operators.focal import TILE, focal_apply, windows
from graticule.operators.terrain import flow_direction
from graticule.session import durable

EARTH_KM = 6371.0088  # mean radius


def _lower(z, w, gradient):
    """Lower the water level w of the inner cells as far as its rim allows."""
    core = (slice(1, -1), slice(1, -1))
    zc = z[core]
    while True:
        rim = np.minimum.reduce([
            w[1 + dr:w.shape[0] - 1 + dr, 1 + dc:w.shape[1] - 1 + dc]
            for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc])
        new = np.minimum(w[core], np.maximum(zc, rim + gradient))
        if np.array_equal(new, w[core]):
            return
        w[core] = new


def fill_depressions(df: DataFrame, z="z", gradient=0.0, tile=TILE) -> DataFrame:
    """Raise pits until every cell drains over falling (or level) ground.

    The result is the lowest surface w >= z in which each cell has a neighbour
    with ``w + gradient`` not above it; cells on the raster's edge or next to a
    gap keep their height.  Level ground is found in two passes over the grid (see
    ``rims``); a ``gradient`` makes heights follow the path's length and takes rounds.
    """
    return _fill_sloping(df, z, gradient, tile) if gradient else rims.fill(df, z, tile)


def _fill_sloping(df, z, gradient, tile):
    """Planchon and Darboux 2001: tiles are solved whole and exchange their rims until
    none changes, so the rounds follow the tiles that a path crosses.  Levels only fall,
    so the rounds end."""

    def step(first):
        def run(present, grids):
            height = grids[z]
            known = ~np.isnan(height)
            if first:
                edge = np.zeros(known.shape, bool)
                edge[1:-1, 1:-1] = ~windows(known, 1, tile).all(axis=(2, 3))
                w = np.where(edge & known, height, np.inf)
                old = np.full(w.shape, np.nan)
            else:
                w = np.where(known, grids["w"], np.inf)
                old = w.copy()
            w = np.where(known, w, np.inf)
            _lower(np.where(known, height, np.inf), w, gradient)
            core = (slice(1, -1), slice(1, -1))
            out = np.where(known, w, np.nan)[core]
            return {z: height[core], "w": out,
                    "changed": (known[core] & (w != old)[core]).astype("int64")}
        return run

    kinds = {z: T.DoubleType(), "w": T.DoubleType(), "changed": T.LongType()}
    state = durable(focal_apply(df, [z], step(True), kinds, 1, tile))
    while True:
        state = durable(focal_apply(state, [z, "w"], step(False), kinds, 1, tile))
        if state.where("changed = 1").isEmpty():
            return state.select("cell", "r", "c", F.col(z), F.col("w").alias("filled"))


def _doubling(state, step, active, max_rounds=64):
    """Repeat ``step`` until no row is active: no path has 2 ** 64 cells, but a cycle does."""
    for _ in range(max_rounds):
        if state.where(active).isEmpty():
            return state
        state = durable(step(state))
    raise RuntimeError("the drainage table has a cycle")


def flow_accumulation(flow: DataFrame, value=None, into="upstream", tile=TILE) -> DataFrame:
    """Sum of ``value`` (1 per cell when None) over each cell and all above it.

    ``flow`` has (cell, parent), parent NULL at outlets.  With the cells' ``r`` and
    ``c`` tiles are summed whole and joined on their rims (see ``rims``).  Without, round
    k adds what lies 2^k to 2^(k+1) steps upstream.  Contributions combine on the map
    side, and finished cells leave the joins, so neither a large outlet nor the NULL
    pointers gather in one task.
    """
    amount = F.lit(1.0) if value is None else F.col(value).cast("double")
    if {"r", "c"} <= set(flow.columns):
        paths = rims.tile_paths(flow, amount, tile)
        return _tile_sums(paths, rims.exit_forest(paths, tile), into, tile)
    start = flow.select("cell", F.col("parent").alias("jump"), amount.alias("acc"))

    def step(state):
        moving = state.where(F.col("jump").isNotNull())
        gained = moving.groupBy("jump").agg(F.sum("acc").alias("gain")).withColumnRenamed("jump", "cell")
        hop = state.select(F.col("cell").alias("jump"), F.col("jump").alias("next"))
        moved = moving.join(hop, "jump").select("cell", F.col("next").alias("jump"), "acc")
        still = state.where(F.col("jump").isNull()).select("cell", "jump", "acc")
        return moved.unionByName(still).join(gained, "cell", "left").select(
            "cell", "jump", (F.col("acc") + F.coalesce("gain", F.lit(0.0))).alias("acc"))

    done = _doubling(durable(start), step, F.col("jump").isNotNull())
    return done.select("cell", F.col("acc").alias(into))


def _tile_sums(paths, forest, into, tile):
    entries = forest.where("below is not null").select("cell", "below", "row", "col")
    inflow = flow_accumulation(forest.select("cell", "parent", "total"), "total", "gain").join(
        entries, "cell").groupBy(F.col("below").alias("cell"), "row", "col").agg(F.sum("gain").alias("gain"))
    return rims.enter_tiles(paths, inflow, into, tile)


def basins(flow: DataFrame, tile=TILE) -> DataFrame:
    """Outlet of each cell, by tiles if the cells have ``r`` and ``c``.

    Without, or on the graph of the tiles' exits, pointers are doubled until they reach
    an end.
    """
    if {"r", "c"} <= set(flow.columns):
        paths = rims.tile_paths(flow, F.lit(0.0), tile)
        return _tile_basins(paths, rims.exit_forest(paths, tile))
    start = flow.select(
        "cell", F.col("parent").alias("jump"),
        F.when(F.col("parent").isNull(), F.col("cell")).alias("outlet"))

    def step(state):
        moving = state.where(F.col("jump").isNotNull()).select("cell", "jump")
        hop = state.select(F.col("cell").alias("jump"), F.col("jump").alias("next"), "outlet")
        moved = moving.join(hop, "jump").select("cell", F.col("next").alias("jump"), "outlet")
        return moved.unionByName(state.where(F.col("jump").isNull()))

    return _doubling(durable(start), step, F.col("jump").isNotNull()).select("cell", "outlet")


def _tile_basins(paths, forest):
    ends = basins(forest.select("cell", "parent")).withColumnRenamed("cell", "exit")
    return paths.select("cell", "exit").join(ends, "exit").select("cell", "outlet")


def cell_area(row: Column, top, resolution) -> Column:
    """Area in km2 of a cell of a geographic grid: narrower towards the poles.

    ``top`` is the latitude of the grid's upper edge in degrees.
    """
    edge = lambda r: F.sin(F.radians(F.lit(float(top)) - r * F.lit(float(resolution))))
    return F.radians(F.lit(float(resolution))) * F.lit(EARTH_KM ** 2) * (edge(row) - edge(row + 1))


def drainage(df: DataFrame, z="z", width=None, top=0.0, resolution=1.0, limit=100.0,
             gradient=0.0, tile=TILE):
    """Drainage on filled ground: (flow, upstream area, basins, streams with order).

    Pits are filled and flats drain by whole-numbered distances, so every cell inside the
    raster has a way down and only cells on its edge, or next to a gap, are outlets.  Streams are
    the cells with more than ``limit`` km2 upstream.
    """
    filled = durable(fill_depressions(df, z, gradient, tile))
    flow = durable(flow_direction(filled, "filled", width, tile, flats=True).join(
        filled.select("cell", F.col("filled")), "cell").withColumn(
        "area", cell_area(F.col("r"), top, resolution)))
    paths = rims.tile_paths(flow, F.col("area"), tile)
    forest = rims.exit_forest(paths, tile)
    upstream = durable(_tile_sums(paths, forest, "upstream_km2", tile))
    streams = durable(stream_cells(flow, upstream, limit, "upstream_km2", carry=("r", "c")))
    return flow, upstream, _tile_basins(paths, forest), streams.drop("r", "c").join(
        strahler(streams, tile), "cell")


def stream_cells(flow: DataFrame, upstream: DataFrame, limit, area="upstream", carry=()) -> DataFrame:
    """Stream links (cell, parent): cells with more than ``limit`` upstream.

    A stream cell's parent carries at least as much, so it is a stream cell too.  ``carry``
    names further columns of ``flow`` to keep.
    """
    return flow.join(upstream.where(F.col(area) > limit), "cell").select("cell", "parent", area, *carry)


def strahler(streams: DataFrame, tile=TILE) -> DataFrame:
    """Stream order of each cell of a network (cell, parent).

    With the cells' ``r`` and ``c`` tiles are solved whole (see ``stream_order``).  Without,
    cells of order > s are those at or below a meeting of two branches of order
    >= s.  Starting from all cells, each pass marks the meetings, sends the mark
    downstream by flow accumulation, and keeps the marked cells.  A pass works on
    the part that is left, which shrinks from order to order.
    """
    if {"r", "c"} <= set(streams.columns):
        return stream_order.tile_orders(streams, tile)
    network = durable(streams.select("cell", "parent"))
    levels = network.select("cell", F.lit(1).alias("level"))
    for level in itertools.count(2):  # each pass has fewer meetings than the one before
        meets = network.where(F.col("parent").isNotNull()).groupBy("parent").agg(
            F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
        if meets.isEmpty():
            break
        marked = network.join(
            meets.select(F.col("parent").alias("cell"), F.lit(1.0).alias("mark")), "cell", "left"
        ).fillna(0.0, ["mark"])
        reached = flow_accumulation(marked, "mark", "marks").where(F.col("marks") > 0)
        network = durable(network.join(reached.select("cell"), "cell", "left_semi"))
        levels = levels.unionByName(network.select("cell", F.lit(level).alias("level")))
    return levels.groupBy("cell").agg(F.max("level").alias("strahler"))
