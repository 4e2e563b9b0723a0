"""Neighbourhood operators on sparse cell tables.

Cells are shuffled once, by square tile; the cells within the kernel's reach of
a tile's edge travel to the neighbouring tile as well.  With 128-cell tiles a
5 x 5 kernel moves 6 % more rows than there are cells, a group is never larger
than one tile, and cells missing from the table (sea) are simply gaps.  RANGE
windows would need two shuffles and would lose the neighbours of a gap.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TILE = 128


def tiled(df: DataFrame, halo, tile=TILE) -> DataFrame:
    """Add the tile of each cell, with copies of edge cells for other tiles."""
    reach = lambda x: F.array_distinct(
        F.transform(
            F.array(F.col(x) - halo, F.col(x), F.col(x) + halo),
            lambda v: F.floor(v / tile).cast("long"),
        )
    )
    return df.withColumn("_tr", F.explode(reach("r"))).withColumn("_tc", F.explode(reach("c")))


def _dense(column, rows, cols, side):
    """Place values on a square; gaps and NULLs are NaN."""
    grid = np.full((side, side), np.nan)
    grid[rows, cols] = column
    return grid


def focal_apply(df: DataFrame, values, fn, outputs, halo, tile=TILE, carry=()) -> DataFrame:
    """Apply ``fn(present, grids) -> {name: per-cell array}`` tile by tile.

    ``present`` and each grid have ``tile + 2 * halo`` cells a side.  An output
    is a (tile, tile) array, or (tile, tile, n) for a list column; NaN becomes
    NULL.  The columns ``cell, r, c`` and those of ``carry`` are kept next to the
    ``outputs`` (name -> type), so that no join is needed to get them back.
    """
    values, carry = list(values), list(carry)
    schema = T.StructType(
        [T.StructField(k, T.LongType()) for k in ("cell", "r", "c")]
        + [df.schema[name] for name in carry]
        + [T.StructField(name, kind) for name, kind in outputs.items()]
    )
    side = tile + 2 * halo

    def run(key, table):
        tr, tc = key[0].as_py(), key[1].as_py()
        r = table.column("r").to_numpy().astype("int64")
        c = table.column("c").to_numpy().astype("int64")
        rows, cols = r - (tr * tile - halo), c - (tc * tile - halo)
        present = np.zeros((side, side), bool)
        present[rows, cols] = True
        grids = {}
        for name in values:
            column = table.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
            grids[name] = _dense(column, rows, cols, side)
        core = (r // tile == tr) & (c // tile == tc)
        if not core.any():
            return _arrow_table(schema, {}, 0)
        out = fn(present, grids)
        core = np.flatnonzero(core)
        core = core[np.lexsort((c[core], r[core]))]  # neighbours side by side
        at = (rows[core] - halo, cols[core] - halo)
        data = {
            "cell": table.column("cell").to_numpy()[core], "r": r[core], "c": c[core],
        }
        for name in carry:
            data[name] = table.column(name).take(pa.array(core))
        for name in outputs:
            data[name] = out[name][at]
        return _arrow_table(schema, data, len(core))

    needed = df.select(
        F.col("cell").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"),
        *dict.fromkeys(v for v in values + carry if v not in ("cell", "r", "c")),
    )
    return tiled(needed, halo, tile).groupBy("_tr", "_tc").applyInArrow(run, schema)


def _arrow_table(schema, data, n):
    arrays = []
    for field in schema.fields:
        if n == 0:
            arrays.append(pa.array([], to_arrow_type(field.dataType)))
            continue
        values = data[field.name]
        if isinstance(values, pa.ChunkedArray):
            arrays.append(values)
            continue
        kind = to_arrow_type(field.dataType)
        if isinstance(field.dataType, T.ArrayType):
            width = values.shape[-1]
            flat = values.reshape(-1)
            inner = pa.array(flat, mask=_missing(flat), type=kind.value_type)
            ends = np.arange(0, (n + 1) * width, width, dtype="int32")
            arrays.append(pa.ListArray.from_arrays(pa.array(ends), inner))
        else:
            mask = _missing(values)
            if kind == pa.int64() and values.dtype.kind == "f":
                values = np.where(mask, 0, values).astype("int64")
            arrays.append(pa.array(values, mask=mask, type=kind))
    return pa.table(arrays, names=[f.name for f in schema.fields])


def _missing(values):
    return np.isnan(values) if values.dtype.kind == "f" else np.zeros(values.shape, bool)


def windows(grid, radius, tile):
    """View of shape (tile, tile, P, P): the neighbourhood of each core cell."""
    size = 2 * radius + 1
    view = np.lib.stride_tricks.sliding_window_view(grid, (size, size))
    skip = (grid.shape[0] - tile) // 2 - radius
    return view[skip:skip + tile, skip:skip + tile]


def patch_extract(df: DataFrame, variables, size=5, tile=TILE, carry=()) -> DataFrame:
    """One row-major list of ``size * size`` values per variable and cell.

    Gaps, the outside of the raster and missing values are 0.
    """
    radius = size // 2

    def run(present, grids):
        out = {}
        for name in variables:
            grid = np.nan_to_num(grids[name], nan=0.0)
            out[name] = windows(grid, radius, tile).reshape(tile, tile, size * size)
        return out

    kind = T.ArrayType(T.DoubleType())
    return focal_apply(df, variables, run, {v: kind for v in variables}, radius, tile, carry)


def focal_sum_count(df: DataFrame, value, radius=1, tile=TILE) -> DataFrame:
    """Sum and number of present values in the square around each cell."""

    def run(present, grids):
        near = windows(grids[value], radius, tile)
        return {
            "total": np.nansum(near, axis=(2, 3)),
            "n": (~np.isnan(near)).sum(axis=(2, 3)).astype("int64"),
        }

    outputs = {"total": T.DoubleType(), "n": T.LongType()}
    return focal_apply(df, [value], run, outputs, radius, tile)


def erode_borders(df: DataFrame, split="split", kernel=5, height=None, width=None,
                  erode_train=False, tile=TILE, carry=()) -> DataFrame:
    """Drop (set to 0) cells whose kernel meets another split or leaves the raster.

    Training cells stay unless ``erode_train``; neighbours that belong to no
    split (0, or missing from the table) do not erode.  ``height`` and ``width``
    are the raster's size, whose outside always erodes.
    """
    radius = kernel // 2

    def run(present, grids):
        code = np.nan_to_num(grids[split], nan=0.0)
        near = windows(code, radius, tile)
        own = near[:, :, radius, radius]
        clash = ((near != 0) & (near != own[:, :, None, None])).any(axis=(2, 3))
        r = windows(grids["_row"], radius, tile)[:, :, radius, radius]
        c = windows(grids["_col"], radius, tile)[:, :, radius, radius]
        edge = (r < radius) | (r >= height - radius) | (c < radius) | (c >= width - radius)
        lose = clash | edge
        if not erode_train:
            lose &= own != 1
        return {split: np.where(lose, 0, own).astype("int64")}

    work = df.withColumn("_row", F.col("r")).withColumn("_col", F.col("c"))
    return focal_apply(work, [split, "_row", "_col"], run, {split: T.LongType()}, radius, tile,
                       carry)
