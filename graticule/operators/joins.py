"""Joins of layers, lookups and point tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def align_layers(layers, key="cell", how="inner") -> DataFrame:
    """Join single-layer tables on the cell.

    Each layer is exchanged once, on the cell; tables of ``layers.save_bucketed`` with the
    same number of buckets are not exchanged at all.
    """
    return reduce(lambda a, b: a.join(b, key, how), layers)


def stack_features(long: DataFrame, names, key="cell", name="name", value="value") -> DataFrame:
    """Long layers to one row per cell: a single aggregation however many layers."""
    return long.groupBy(key).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names]
    )


def region_semi(df: DataFrame, regions: DataFrame, key) -> DataFrame:
    """Rows whose region is listed; a region listed often is reduced to one row first."""
    return df.join(regions.select(key).distinct(), key, "left_semi")


def lut_map(df: DataFrame, table: DataFrame, key, code, into="code", missing=0) -> DataFrame:
    """Replace an id by its class; ids without a class get ``missing``."""
    lut = table.select(F.col(key), F.col(code).alias("_code"))
    return df.join(lut, key, "left").withColumn(
        into, F.coalesce(F.col("_code"), F.lit(missing))
    ).drop("_code")


def match_first(start: DataFrame, end: DataFrame, keys, order, carry) -> DataFrame:
    """Give each start the first end (by ``order``) with the same keys.

    The ends are reduced to one per key before the join, so no pairs are made.
    """
    first = end.groupBy(*keys).agg(
        F.min_by(F.struct(*carry), F.struct(*order)).alias("_end")
    )
    return start.join(first, list(keys)).select(
        *start.columns, *[F.col(f"_end.{c}").alias(f"end_{c}") for c in carry]
    )


def anti_unmatched(start: DataFrame, end: DataFrame, keys, key) -> DataFrame:
    """Starts left over: a match on all keys removes every start of that one key."""
    pairs = end.select(*keys).distinct()
    matched = start.join(pairs, list(keys), "left_semi").select(key).distinct()
    return start.join(matched, key, "left_anti")


def union_by_key(cells: DataFrame, key, cell="cell") -> DataFrame:
    """Dissolve features in cell space: each (key, cell) once."""
    return cells.select(key, cell).distinct()


def union_tables(*tables) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def complement(everything: DataFrame, taken: DataFrame, key="cell") -> DataFrame:
    return everything.join(taken.select(key).distinct(), key, "left_anti")


def dedupe_geometry(df: DataFrame, geometry, order=None) -> DataFrame:
    """One row per geometry: the first by ``order`` (columns), else by all columns."""
    order = list(order or df.columns)
    first = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(F.col(geometry).alias("_g")).agg(first.alias("_row")).select("_row.*")


def full_grid(spark, height, width) -> DataFrame:
    return spark.range(height * width).select(
        F.col("id").alias("cell"),
        F.floor(F.col("id") / width).cast("long").alias("r"),
        (F.col("id") % width).cast("long").alias("c"),
    )


def scatter_to_grid(grid: DataFrame, scores: DataFrame, value="p", key="cell") -> DataFrame:
    """Scores back on the full grid, kept within [0, 1]; other cells missing."""
    kept = F.when(F.col(value).isNotNull(),
                  F.least(F.greatest(F.col(value), F.lit(0.0)), F.lit(1.0)))
    return grid.join(scores.select(key, value), key, "left").withColumn(value, kept)


def mosaic_tiles(tiles: DataFrame, order="tile_order") -> DataFrame:
    """Tiles with row and column offsets onto one grid; the first tile wins.

    Missing values do not hide a later tile's value.
    """
    placed = tiles.select(
        (F.col("r") + F.col("row_offset")).alias("r"),
        (F.col("c") + F.col("col_offset")).alias("c"),
        "value", order,
    ).where(F.col("value").isNotNull())
    return placed.groupBy("r", "c").agg(F.min_by("value", order).alias("value"))


def first_per_group(df: DataFrame, keys, order) -> DataFrame:
    """One row per group without sorting it: the smallest by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
