"""Slope, aspect, curvature and flow direction from the 3 x 3 neighbourhood."""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators.focal import TILE, focal_apply, windows
from graticule.session import discard, stored

# The eight neighbours (row step, column step), clockwise from
# east, with their D8 codes 1, 2, 4 ... 128.
NEIGHBOURS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def _nine(grid, tile):
    """The 3 x 3 values of each cell; a missing neighbour counts as the centre."""
    near = windows(grid, 1, tile)
    centre = near[:, :, 1, 1]
    filled = np.where(np.isnan(near), centre[:, :, None, None], near)
    return filled, centre


def _gradient(near, size):
    """Horn's weighted differences, eastward and southward."""
    west = near[:, :, 0, 0] + 2 * near[:, :, 1, 0] + near[:, :, 2, 0]
    east = near[:, :, 0, 2] + 2 * near[:, :, 1, 2] + near[:, :, 2, 2]
    north = near[:, :, 0, 0] + 2 * near[:, :, 0, 1] + near[:, :, 0, 2]
    south = near[:, :, 2, 0] + 2 * near[:, :, 2, 1] + near[:, :, 2, 2]
    return (east - west) / (8 * size), (south - north) / (8 * size)


def terrain_slope(df: DataFrame, z="z", cell_size=1.0, tile=TILE) -> DataFrame:
    """Rise over run."""

    def run(present, grids):
        near, _ = _nine(grids[z], tile)
        dx, dy = _gradient(near, cell_size)
        return {"slope": np.sqrt(dx * dx + dy * dy)}

    return focal_apply(df, [z], run, {"slope": T.DoubleType()}, 1, tile)


def terrain_aspect(df: DataFrame, z="z", cell_size=1.0, tile=TILE) -> DataFrame:
    """Compass direction of steepest descent in degrees, missing where flat."""

    def run(present, grids):
        near, _ = _nine(grids[z], tile)
        dx, dy = _gradient(near, cell_size)
        # rows grow southward, so (-dx, dy) points down the slope as (east, north)
        angle = np.degrees(np.arctan2(-dx, dy)) % 360.0
        return {"aspect": np.where((dx == 0) & (dy == 0), np.nan, angle)}

    return focal_apply(df, [z], run, {"aspect": T.DoubleType()}, 1, tile)


def terrain_curvature(df: DataFrame, z="z", cell_size=1.0, tile=TILE) -> DataFrame:
    """Total, profile and planform curvature (Zevenbergen and Thorne 1987), x 100."""

    def run(present, grids):
        near, centre = _nine(grids[z], tile)
        L = cell_size
        n, s, w, e = near[:, :, 0, 1], near[:, :, 2, 1], near[:, :, 1, 0], near[:, :, 1, 2]
        d = ((w + e) / 2 - centre) / L ** 2
        ee = ((n + s) / 2 - centre) / L ** 2
        f = (-near[:, :, 0, 0] + near[:, :, 0, 2] + near[:, :, 2, 0] - near[:, :, 2, 2]) / (4 * L ** 2)
        g = (e - w) / (2 * L)
        h = (n - s) / (2 * L)
        gg = g * g + h * h
        with np.errstate(invalid="ignore", divide="ignore"):
            profile = 200 * (d * g * g + ee * h * h + f * g * h) / gg
            planform = -200 * (d * h * h + ee * g * g - f * g * h) / gg
        flat = gg == 0
        return {
            "curvature": -200 * (d + ee),
            "profile": np.where(flat & ~np.isnan(centre), 0.0, profile),
            "planform": np.where(flat & ~np.isnan(centre), 0.0, planform),
        }

    kind = T.DoubleType()
    outputs = {"curvature": kind, "profile": kind, "planform": kind}
    return focal_apply(df, [z], run, outputs, 1, tile)


def flow_direction(df: DataFrame, z="z", width=None, tile=TILE, flats=False) -> DataFrame:
    """D8: code of the steepest downslope neighbour and the cell it drains to.

    The first of equally steep neighbours, clockwise from east, is taken.  Pits, flats
    and cells that fall off the raster have neither; with ``flats`` the cells of a flat
    that has a way out drain as well.
    """
    if flats:
        return _with_flats(df, z, width, tile)

    def run(present, grids):
        near = windows(grids[z], 1, tile)
        best, none = _steepest(near)
        return {
            "direction": np.where(none, np.nan, 2.0 ** best),
            "parent": np.where(none, np.nan, grids["_cell"][1:-1, 1:-1] + _steps(width)[best]),
        }

    outputs = {"direction": T.LongType(), "parent": T.LongType()}
    work = df.selectExpr("cell", "r", "c", z, "cell as _cell")
    return focal_apply(work, [z, "_cell"], run, outputs, 1, tile)


def _steps(width):
    return np.array([dr * width + dc for dr, dc in NEIGHBOURS])


def _steepest(near):
    """Number of the steepest neighbour, and where nothing falls."""
    centre = near[:, :, 1, 1]
    drops = np.stack(
        [(centre - near[:, :, 1 + dr, 1 + dc]) / np.hypot(dr, dc) for dr, dc in NEIGHBOURS])
    drops = np.where(np.isnan(drops), -np.inf, drops)
    return drops.argmax(axis=0), drops.max(axis=0) <= 0


def _shifted(grid, fill=np.nan):
    """The eight neighbours' values of each cell of a grid."""
    wide = np.pad(grid, 1, constant_values=fill)
    n, m = grid.shape
    return np.stack([wide[1 + dr:1 + dr + n, 1 + dc:1 + dc + m] for dr, dc in NEIGHBOURS])


def _distances(start, level):
    """Steps from the ``start`` cells (with their steps so far) over cells of equal height."""
    wide = np.pad(level, 1, constant_values=np.nan)
    side, height = wide.shape[1], wide.ravel()
    near = np.array([dr * side + dc for dr, dc in NEIGHBOURS])
    found = np.pad(np.where(np.isnan(start), np.inf, start), 1, constant_values=np.inf).ravel()
    given = np.flatnonzero(np.isfinite(found))
    given = given[np.argsort(found[given], kind="stable")]
    steps, taken, new = found[given], 0, given[:0]
    while len(new) or taken < len(given):  # from the nearest cells outwards
        now = found[new[0]] if len(new) else steps[taken]
        upto = np.searchsorted(steps, now, "right")
        at = np.concatenate([new, given[taken:upto]])
        taken = max(taken, upto)
        at = at[found[at] == now]
        to = at[:, None] + near
        to = to[(height[to] == height[at][:, None]) & (found[to] > now + 1)]
        new = np.unique(to)
        found[new] = now + 1
    out = found.reshape(wide.shape)[1:-1, 1:-1]
    return np.where(np.isinf(out), np.nan, out)


def _with_flats(df, z, width, tile):
    """D8 where flats drain by two whole-numbered distances (Barnes, Lehman and Mulla 2014).

    A flat cell next to a draining cell of its height drains there.  The others take the
    flat neighbour with the smallest ``2 * toward - away``: steps to such a cell, and
    steps from higher ground.  Heights stay as they are, and since the next cell on a
    shortest way out always has a smaller number, paths end.  Distances are found in
    whole tiles; only flat cells take part.  Flats inside one tile are done at once; for the
    others tiles exchange their rims until none changes, which takes as many rounds as the
    tiles that a flat reaches across.
    """
    number, whole = T.DoubleType(), T.LongType()

    def first(present, grids):
        near = windows(grids[z], 1, tile + 2)
        centre = near[:, :, 1, 1]
        best, none = _steepest(near)
        known, full = ~np.isnan(centre), ~np.isnan(near).any(axis=(2, 3))
        flat, core = known & none & full, (slice(1, -1), slice(1, -1))
        ways = _shifted((known & ~flat).astype(float), 0.0)[(slice(None), *core)] == 1
        ways &= (_shifted(centre) == centre)[(slice(None), *core)]
        out, flat = np.where(none, np.nan, best)[core], flat[core]
        out = np.where(flat & ways.any(axis=0), ways.argmax(axis=0), out)
        higher = (_shifted(centre, -np.inf) > centre)[(slice(None), *core)].any(axis=0)
        return {z: centre[core], "_way": out, "_flat": flat.astype("int64"),
                "_toward": np.where(flat & ways.any(axis=0), 1.0, np.nan),
                "_away": np.where(flat & higher, 1.0, np.nan)}

    def alone(present, grids):
        core, level = (slice(1, -1), slice(1, -1)), grids[z]
        outside = np.zeros(level.shape)
        outside[core] = np.nan
        new = {n: _distances(grids[n], level) for n in ("_toward", "_away")}
        return {z: level[core], **choose(present, {**grids, **new}), "_old": grids["_way"][core],
                **{n: new[n][core] for n in new},
                "_open": (~np.isnan(_distances(outside, np.where(present, level, np.nan))))[core].astype("int64")}

    def further(present, grids):
        core = (slice(1, -1), slice(1, -1))
        new = {n: _distances(grids[n], grids[z])[core] for n in ("_toward", "_away")}
        changed = sum((np.nan_to_num(new[n]) != np.nan_to_num(grids[n][core])) for n in new) > 0
        return {z: grids[z][core], "_way": grids["_way"][core], **new,
                "_changed": changed.astype("int64")}

    def choose(present, grids):
        value = 2 * grids["_toward"] - np.nan_to_num(grids["_away"])
        same = _shifted(grids[z]) == grids[z]
        near = np.where(same & ~np.isnan(_shifted(value)), _shifted(value), np.inf)
        way = np.where(np.isfinite(near.min(axis=0)), near.argmin(axis=0), np.nan)
        return {"_way": np.where(np.isnan(grids["_way"]), way, grids["_way"])[1:-1, 1:-1]}

    kinds = {z: number, "_way": number, "_flat": whole, "_toward": number, "_away": number}
    ground = stored(focal_apply(df.select("cell", "r", "c", z), [z], first, kinds, 2, tile))
    columns = [z, "_way", "_toward", "_away"]
    kinds = {z: number, "_way": number, "_old": number, "_toward": number, "_away": number, "_open": whole}
    inside = stored(focal_apply(ground.where("_flat = 1"), columns, alone, kinds, 1, tile))
    flat = inside.where("_open = 1").select("cell", "r", "c", z, F.col("_old").alias("_way"), "_toward", "_away")
    kinds = {z: number, "_way": number, "_toward": number, "_away": number, "_changed": whole}
    while True:
        after = stored(focal_apply(flat, columns, further, kinds, 1, tile))
        discard(flat)
        flat = after
        if flat.where("_changed = 1").isEmpty():
            break
    routed = focal_apply(flat, columns, choose, {"_way": number}, 1, tile)
    every = ground.where("_flat = 0").unionByName(inside.where("_open = 0"), allowMissingColumns=True).select(
        "cell", "r", "c", "_way").unionByName(routed)
    step = F.get(F.array(*[F.lit(int(s)) for s in _steps(width)]), F.col("_way").cast("int"))
    return every.select(
        "cell", "r", "c", F.pow(F.lit(2.0), F.col("_way")).cast("bigint").alias("direction"),
        (F.col("cell") + step).alias("parent"))
