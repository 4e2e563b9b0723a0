"""Polygons, lines and points to grid cells.

Grid units: cell (r, c) covers [c, c+1] x [r, r+1].  A shape is first cut into its
edges, each edge goes to the rows that it crosses, the rows are spread over the
cluster, and only then do they become cells: a continental polygon is not one task's work.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.functions.geometry import edges
from graticule.functions.scalar import haversine_km


def _long(x):
    return F.floor(x).cast("long")


def _span(low, high):
    """Inclusive integer sequence, empty when low > high."""
    empty = F.array().cast("array<bigint>")
    return F.when(low <= high, F.sequence(low, high)).otherwise(empty)


def _limits(height, width):
    low = lambda x: F.greatest(x, F.lit(0).cast("long"))
    return low, (lambda r: F.least(r, F.lit(height - 1).cast("long"))), (
        lambda c: F.least(c, F.lit(width - 1).cast("long")))


def centre_cells(shapes: DataFrame, key, rings="rings", height=None, width=None) -> DataFrame:
    """(key, r, c): cells whose centre lies in the shape, even-odd over its rings.

    Each edge goes to the rows whose centre line it crosses; the crossings of a shape's
    row are sorted, and the cells between each odd one and the next are inside.  A
    group is one row of one shape, so a long outline is spread over the cluster.
    Shapes that repeat key and rings count once.
    """
    low, row_cap, col_cap = _limits(height, width)
    e = lambda f: F.col(f"e.{f}")
    # the hash is taken below the explosion, once for each shape
    lines = shapes.select(*key, F.col(rings).alias("_rings")).distinct().select(
        *key, F.xxhash64("_rings").alias("_shape"),
        F.flatten(F.transform("_rings", edges)).alias("_edges"),
    ).select(*key, "_shape", F.explode("_edges").alias("e"))
    y0, y1 = F.least(e("y1"), e("y2")), F.greatest(e("y1"), e("y2"))
    first_row = low(F.ceil(y0 - 0.5).cast("long"))
    last_row = row_cap((F.ceil(y1 - 0.5) - 1).cast("long"))
    y = F.col("r") + F.lit(0.5)
    x_at = e("x1") + (y - e("y1")) / (e("y2") - e("y1")) * (e("x2") - e("x1"))
    crossed = lines.where(y0 < y1).withColumn("r", F.explode(_span(first_row, last_row))).groupBy(
        *key, "_shape", "r").agg(F.sort_array(F.collect_list(x_at)).alias("_x"))
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("_x") / 2).cast("int") - 1),
        lambda i: F.struct(F.get("_x", 2 * i).alias("a"), F.get("_x", 2 * i + 1).alias("b")))
    spans = crossed.where(F.size("_x") >= 2).select(*key, "r", F.explode(pairs).alias("s"))
    first = low(F.ceil(F.col("s.a") - 0.5).cast("long"))
    last = col_cap((F.ceil(F.col("s.b") - 0.5) - 1).cast("long"))
    return spans.select(*key, "r", F.explode(_span(first, last)).alias("c"))


def edge_cells(shapes: DataFrame, key, rings="rings", height=None, width=None) -> DataFrame:
    """(key, r, c): cells that a ring or line passes through."""
    low, row_cap, col_cap = _limits(height, width)
    all_edges = F.flatten(F.transform(rings, edges))
    e = lambda f: F.col(f"e.{f}")
    y0, y1 = F.least(e("y1"), e("y2")), F.greatest(e("y1"), e("y2"))
    lines = shapes.select(*key, F.explode(all_edges).alias("e")).withColumn(
        "r", F.explode(_span(low(_long(y0)), row_cap(_long(y1)))))
    # the part of the edge inside the row's band [r, r + 1]
    dy = e("y2") - e("y1")
    x_at = lambda y: F.when(dy == 0, None).otherwise(e("x1") + (y - e("y1")) / dy * (e("x2") - e("x1")))
    top, bottom = F.greatest(y0, F.col("r").cast("double")), F.least(y1, F.col("r") + 1.0)
    xa = F.when(dy == 0, F.least(e("x1"), e("x2"))).otherwise(F.least(x_at(top), x_at(bottom)))
    xb = F.when(dy == 0, F.greatest(e("x1"), e("x2"))).otherwise(F.greatest(x_at(top), x_at(bottom)))
    bands = lines.select(*key, "r", low(_long(xa)).alias("_a"), col_cap(_long(xb)).alias("_b"))
    return bands.repartition(*key, "r").select(
        *key, "r", F.explode(_span(F.col("_a"), F.col("_b"))).alias("c"))


def shape_cells(shapes, key, rings="rings", height=None, width=None, all_touched=True) -> DataFrame:
    """(key, r, c), each once: touched cells, or those with their centre inside."""
    inside = centre_cells(shapes, key, rings, height, width)
    if all_touched:
        inside = inside.unionByName(edge_cells(shapes, key, rings, height, width))
    return inside.distinct()


def rasterize_mask(shapes, key, height, width, all_touched=True, rings="rings") -> DataFrame:
    """Cells covered by any shape (each cell once)."""
    inside = centre_cells(shapes, key, rings, height, width).select("r", "c")
    if all_touched:
        touched = edge_cells(shapes, key, rings, height, width).select("r", "c")
        inside = inside.unionByName(touched)
    return inside.distinct()


def rasterize_count(shapes, key, height, width, all_touched=False, rings="rings") -> DataFrame:
    """Number of shapes covering each cell."""
    return shape_cells(shapes, key, rings, height, width, all_touched).groupBy("r", "c").agg(
        F.count(F.lit(1)).alias("n"))


def rasterize_class(shapes, key, value, order, height, width, all_touched=False,
                    rings="rings") -> DataFrame:
    """Value of the last shape (by ``order``) covering each cell."""
    carry = list(dict.fromkeys([*key, value, order]))
    burnt = centre_cells(shapes, carry, rings, height, width)
    if all_touched:
        burnt = burnt.unionByName(edge_cells(shapes, carry, rings, height, width))
    return burnt.groupBy("r", "c").agg(F.max_by(value, order).alias(value))


def line_buffer(shapes: DataFrame, key, distance, height, width, rings="rings") -> DataFrame:
    """(key, r, c), each once: cells whose centre is within ``distance`` of a line.

    For each row only the columns within reach of the edge's box are tested.
    """
    low, row_cap, col_cap = _limits(height, width)
    flat = F.flatten(F.transform(rings, edges))
    e = lambda f: F.col(f"e.{f}")
    d = F.lit(float(distance))
    y0, y1 = F.least(e("y1"), e("y2")) - d, F.greatest(e("y1"), e("y2")) + d
    x0, x1 = F.least(e("x1"), e("x2")) - d, F.greatest(e("x1"), e("x2")) + d
    rows = shapes.select(*key, F.explode(flat).alias("e")).withColumn(
        "r", F.explode(_span(low(_long(y0)), row_cap(_long(y1)))))
    cells = rows.repartition(*key, "r").withColumn(
        "c", F.explode(_span(low(_long(x0)), col_cap(_long(x1)))))
    px, py = F.col("c") + 0.5, F.col("r") + 0.5
    dx, dy = e("x2") - e("x1"), e("y2") - e("y1")
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e("x1")) * dx + (py - e("y1")) * dy) / length)))
    ox, oy = px - (e("x1") + t * dx), py - (e("y1") + t * dy)
    return cells.where(ox * ox + oy * oy <= d * d).select(*key, "r", "c").distinct()


def buffer_count(points: DataFrame, key, lat, lon, radius_km, grid, height, width) -> DataFrame:
    """(r, c, n): number of points whose great-circle buffer covers the cell centre.

    ``grid`` = (left, top, resolution in degrees).  The radius gives the rows,
    each row its columns; only these cells are tested.  Near a pole, and across
    the date line, the column range is the whole row.
    """
    left, top, res = grid
    low, row_cap, col_cap = _limits(height, width)
    reach = F.col(radius_km) / F.lit(110.0)  # km per degree, rounded down to be safe
    rows = _span(low(_long((F.lit(top) - (F.col(lat) + reach)) / res - 0.5)),
                 row_cap(F.ceil((F.lit(top) - (F.col(lat) - reach)) / res).cast("long")))
    by_row = points.select(*key, lat, lon, radius_km).withColumn("r", F.explode(rows))
    y = F.lit(top) - (F.col("r") + 0.5) * res
    narrow = F.greatest(F.least(F.cos(F.radians(F.abs(F.col(lat)) + reach)), F.lit(1.0)), F.lit(0.0))
    wide = F.when(narrow > 0.01, reach / narrow).otherwise(F.lit(360.0))
    whole = (F.col(lon) - wide < -180) | (F.col(lon) + wide > 180)
    first = F.when(whole, F.lit(0).cast("long")).otherwise(
        low(_long((F.col(lon) - wide - left) / res - 0.5)))
    last = F.when(whole, F.lit(width - 1).cast("long")).otherwise(
        col_cap(F.ceil((F.col(lon) + wide - left) / res).cast("long")))
    cells = by_row.withColumns({"_a": first, "_b": last, "_y": y}).repartition(
        *key, "r").withColumn("c", F.explode(_span(F.col("_a"), F.col("_b"))))
    x = F.lit(left) + (F.col("c") + 0.5) * res
    near = haversine_km(lat, lon, F.col("_y"), x) <= F.col(radius_km)
    return cells.where(near).groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
