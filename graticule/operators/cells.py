"""Filters, masks and addressing on cell tables; all narrow (no shuffle)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_mask(df: DataFrame, elevation="v") -> DataFrame:
    """Cells whose elevation is present."""
    return df.where(F.col(elevation).isNotNull())


def map_domain(df: DataFrame, elevation="v") -> DataFrame:
    """Cells that get a value on the hazard map: elevation above 0."""
    return df.where(F.col(elevation) > 0)


def nan_to_null(df: DataFrame, columns, sentinels=()) -> DataFrame:
    """Turn NaN and the listed nodata values into NULL; done once, at ingest."""
    def clean(name):
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        return F.when(value.isin([float(s) for s in sentinels]), None).otherwise(value) \
            if sentinels else value
    return df.withColumns({name: clean(name) for name in columns})


def fill_missing(df: DataFrame, columns, value=0.0) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(value)) for n in columns})


def binarize(count) -> Column:
    """1 where the event count is positive, 0 elsewhere and where it is missing."""
    return F.coalesce((F.col(count) > 0).cast("int"), F.lit(0))


def drop_incomplete(df: DataFrame, columns) -> DataFrame:
    return df.dropna(subset=list(columns))


def crop_window(df: DataFrame, r0, r1, c0, c1) -> DataFrame:
    """Half-open row and column window."""
    return df.where(
        (F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1)
    )


def crop_bbox(df: DataFrame, lat_min, lat_max, lon_min, lon_max, lat="lat", lon="lon",
              shift=0.0) -> DataFrame:
    """Closed latitude/longitude box, moved east by ``shift``; edges included."""
    return df.where(
        F.col(lat).between(lat_min, lat_max)
        & F.col(lon).between(lon_min + shift, lon_max + shift)
    )


def clip_to_region(df: DataFrame, bounds, origin, resolution) -> DataFrame:
    """Window a world raster to a region's bounds and re-origin it.

    ``bounds`` = (left, bottom, right, top) in degrees, rounded to whole degrees;
    ``origin`` = (left, top) of the world raster.
    """
    left, bottom, right, top = [round(b) for b in bounds]
    c0, c1 = (round((x - origin[0]) / resolution) for x in (left, right))
    r0, r1 = (round((origin[1] - y) / resolution) for y in (top, bottom))
    part = crop_window(df, r0, r1, c0, c1)
    return part.withColumns({"r": F.col("r") - r0, "c": F.col("c") - c0})


def points_in_extent(df: DataFrame, left, bottom, right, top, x="x", y="y",
                     category=None, keep=None) -> DataFrame:
    """Points strictly inside the extent, of the category ``keep`` if one is named."""
    inside = df.where(
        (F.col(x) > left) & (F.col(x) < right) & (F.col(y) > bottom) & (F.col(y) < top)
    )
    return inside if category is None else inside.where(F.col(category) == keep)


def time_slice(df: DataFrame, first, last, date="date") -> DataFrame:
    """Observations from ``first`` to ``last``, both included."""
    day = lambda v: F.lit(v).cast("date")
    return df.where((F.col(date) >= day(first)) & (F.col(date) <= day(last)))


def mask_clip_layer(df: DataFrame, mask: DataFrame, value="v", cap=None, window=None,
                    key="cell") -> DataFrame:
    """Blank a layer outside the mask, raise negatives to 0, cap it, window it."""
    inside = mask.select(key, F.lit(True).alias("_in"))
    low = F.greatest(F.col(value), F.lit(0.0))
    if cap is not None:
        low = F.least(low, F.lit(float(cap)))
    # greatest/least skip NULL, which must stay missing
    kept = F.when(F.col("_in") & F.col(value).isNotNull(), low)
    out = df.join(inside, key, "left").withColumn(value, kept).drop("_in")
    return crop_window(out, *window) if window else out


def stride_downsample(df: DataFrame, step) -> DataFrame:
    """Every ``step``-th row and column."""
    return df.where((F.col("r") % step == 0) & (F.col("c") % step == 0))


def nan_indicator(name) -> Column:
    return F.col(name).isNull().cast("int")


def to_cell(r, c, width) -> Column:
    return F.col(r).cast("long") * F.lit(width) + F.col(c)


def with_row_col(df: DataFrame, width, cell="cell") -> DataFrame:
    row = F.floor(F.col(cell) / F.lit(width)).cast("long")
    return df.withColumns({"r": row, "c": (F.col(cell) % width).cast("long")})


def rotate_quarter(df: DataFrame, height, width, turns=1) -> DataFrame:
    """Turn the grid counter-clockwise by quarter turns."""
    r, c = F.col("r"), F.col("c")
    turns %= 4
    if turns == 1:
        new = (F.lit(width - 1) - c, r)
    elif turns == 2:
        new = (F.lit(height - 1) - r, F.lit(width - 1) - c)
    elif turns == 3:
        new = (c, F.lit(height - 1) - r)
    else:
        new = (r, c)
    return df.withColumns({"r": new[0], "c": new[1]})


def flip_rows(df: DataFrame, height) -> DataFrame:
    return df.withColumn("r", F.lit(height - 1) - F.col("r"))


def cap_value(name, limit) -> Column:
    """Values above the limit become the limit; missing stays missing."""
    return F.when(F.col(name) > limit, F.lit(limit)).otherwise(F.col(name))


def shake_class(name) -> Column:
    """Shaking intensity to classes 1..5 with breaks 20, 50, 100 and 150."""
    v = F.col(name)
    return (
        F.when(v < 20, 1).when(v < 50, 2).when(v < 100, 3).when(v < 150, 4)
        .when(v.isNotNull(), 5)
    )


def curvature_class(name) -> Column:
    """Negative and flat 0, positive 1; nodata (-9999) missing."""
    v = F.col(name)
    return F.when(v == -9999, None).when(v > 0, 1).when(v <= 0, 0)


def flux_class(name, limit=3) -> Column:
    """1 from ``limit`` on, 0 below; nodata (-9999) missing."""
    v = F.col(name)
    return F.when(v == -9999, None).when(v < limit, 0).when(v >= limit, 1)


def digitize(value: Column, inner_breaks) -> Column:
    """Number of inner breaks <= value; missing stays missing."""
    steps = [F.when(value >= F.lit(float(b)), 1).otherwise(0) for b in inner_breaks]
    total = F.lit(0)
    for step in steps:
        total = total + step
    return F.when(value.isNotNull(), total)
