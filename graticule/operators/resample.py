"""Changing a grid's resolution."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsample_repeat(df: DataFrame, factor, value="value", trim=False) -> DataFrame:
    """Each cell becomes factor x factor cells; ``trim`` drops half a cell's border.

    With ``trim`` the new origin lies half an old cell inwards.
    """
    steps = F.sequence(F.lit(0).cast("long"), F.lit(factor - 1).cast("long"))
    out = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).select(
        (F.col("r") * factor + F.col("_i")).alias("r"),
        (F.col("c") * factor + F.col("_j")).alias("c"), value)
    if trim:
        half = factor // 2
        out = out.where((F.col("r") >= half) & (F.col("c") >= half)).select(
            (F.col("r") - half).alias("r"), (F.col("c") - half).alias("c"), value)
    return out


def _triangle(x: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - F.abs(x))


def downsample_bilinear(df: DataFrame, factor, value="value", height=None, width=None) -> DataFrame:
    """1/factor of the resolution with the triangular kernel stretched to it.

    A cell weighs on the up to four new cells whose centres are less than one new
    cell away; the sums combine on the map side.
    """
    def near(x):
        at = (F.col(x) + 0.5) / factor - 0.5
        return F.array(F.floor(at).cast("long"), (F.floor(at) + 1).cast("long")), at

    (rows, rat), (cols, cat) = near("r"), near("c")
    spread = df.where(F.col(value).isNotNull()).select(
        rat.alias("_ra"), cat.alias("_ca"), value,
        F.explode(rows).alias("r"), cols.alias("_cols"),
    ).select("_ra", "_ca", value, "r", F.explode("_cols").alias("c"))
    w = _triangle(F.col("_ra") - F.col("r")) * _triangle(F.col("_ca") - F.col("c"))
    inside = (F.col("r") >= 0) & (F.col("c") >= 0)
    if height is not None:
        inside &= F.col("r") < height // factor
    if width is not None:
        inside &= F.col("c") < width // factor
    return spread.where(inside).withColumn("_w", w).where(F.col("_w") > 0).groupBy("r", "c").agg(
        (F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def _linear(t):
    return np.maximum(0.0, 1 - t)


def _cubic(t):
    """Convolution cubic with a = -0.5 (Catmull-Rom)."""
    return np.where(t <= 1, (1.5 * t - 2.5) * t * t + 1,
                    np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))


def _bspline(t):
    return np.where(t < 1, (4 + t * t * (3 * t - 6)) / 6,
                    np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


# name -> (taps per axis, weight of a tap at a distance)
KERNELS = {
    "nearest": (1, None),
    "bilinear": (2, _linear),
    "cubic": (4, _cubic),
    "cubic_spline": (4, _bspline),
}


def resample_grid(source: DataFrame, target: DataFrame, method, source_grid, target_grid,
                  value="value", tile=128) -> DataFrame:
    """Values of ``source`` at the cells of ``target`` (cell, r, c).

    Grids are (left, top, resolution).  A target cell is the weighted mean of the
    1, 4 or 16 source cells around its centre; missing ones are left out.  For a
    coarser target the kernel is widened by the ratio of the resolutions, so every
    source cell has its weight.  A target cell whose nearest source cell is missing
    stays missing.

    Target cells are grouped by tile and every source cell goes to the tiles
    whose cells it weighs on (nearly always one), so neither side is multiplied
    by the number of taps.  Coarser targets get smaller tiles, which keeps the
    source cells of a group within about ``tile`` squared.
    """
    (sx, sy, sres), (tx, ty, tres) = source_grid, target_grid
    taps, kernel = KERNELS[method]
    step = tres / sres
    side = max(4, int(tile / max(1.0, step)))
    # source position of target row or column i is start + step * i
    y_start, x_start = (sy - ty + 0.5 * tres) / sres - 0.5, (tx - sx + 0.5 * tres) / sres - 0.5
    wide = max(1.0, step) if kernel is not None else 1.0
    half = math.ceil(taps / 2 * wide)
    reach = half + 0.51

    def tiles(name, start):
        at = lambda v: F.floor((v - start) / step / side).cast("long")
        return F.sequence(at(F.col(name) - reach), at(F.col(name) + reach))

    wanted = target.select(
        F.col("cell").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"),
        F.floor(F.col("r") / side).alias("_tr"), F.floor(F.col("c") / side).alias("_tc"))
    given = source.where(F.col(value).isNotNull()).select(
        F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"),
        F.col(value).cast("double").alias("v"),
        F.explode(tiles("r", y_start)).alias("_tr"), tiles("c", x_start).alias("_tcs"),
    ).select("sr", "sc", "v", "_tr", F.explode("_tcs").alias("_tc"))

    def run(asked, cells):
        if not asked.num_rows or not cells.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (
                ("cell", pa.int64()), ("r", pa.int64()), ("c", pa.int64()), (value, pa.float64()))})
        sr, sc = cells.column("sr").to_numpy(), cells.column("sc").to_numpy()
        top, left = sr.min(), sc.min()
        known = np.full((sr.max() - top + 1, sc.max() - left + 1), np.nan)
        known[sr - top, sc - left] = cells.column("v").to_numpy()

        def tap(rows, cols):
            rows, cols = rows - top, cols - left
            ok = (rows >= 0) & (rows < known.shape[0]) & (cols >= 0) & (cols < known.shape[1])
            return np.where(ok, known[np.where(ok, rows, 0), np.where(ok, cols, 0)], np.nan)

        y = y_start + step * asked.column("r").to_numpy()
        x = x_start + step * asked.column("c").to_numpy()
        near = tap(np.floor(y + 0.5).astype(int), np.floor(x + 0.5).astype(int))
        out = near
        if kernel is not None:
            total, weight = np.zeros(len(x)), np.zeros(len(x))
            for i in range(1 - half, half + 1):
                for j in range(1 - half, half + 1):
                    rows, cols = np.floor(y).astype(int) + i, np.floor(x).astype(int) + j
                    v = tap(rows, cols)
                    w = np.where(np.isnan(v), 0.0, kernel(np.abs(y - rows) / wide) * kernel(np.abs(x - cols) / wide))
                    total += w * np.where(np.isnan(v), 0.0, v)
                    weight += w
            with np.errstate(invalid="ignore", divide="ignore"):
                out = np.where(np.isnan(near), np.nan, total / weight)
        keep = ~np.isnan(out)
        mask = pa.array(keep)
        return pa.table({
            "cell": asked.column("cell").filter(mask), "r": asked.column("r").filter(mask),
            "c": asked.column("c").filter(mask), value: out[keep]})

    keys = ["_tr", "_tc"]
    return wanted.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(
        run, f"cell bigint, r bigint, c bigint, {value} double")
