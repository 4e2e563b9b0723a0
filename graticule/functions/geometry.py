"""Shapes as arrays of corners: ARRAY<STRUCT<x, y>>, and their cells.

Grid units: cell (r, c) covers the square [c, c+1] x [r, r+1].
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x):
    return F.col(x) if isinstance(x, str) else x


def corner(x, y) -> Column:
    return F.struct(_col(x).cast("double").alias("x"), _col(y).cast("double").alias("y"))


def segment(x1, y1, x2, y2) -> Column:
    """The line from a start to an end point."""
    return F.array(corner(x1, y1), corner(x2, y2))


def edges(ring: Column) -> Column:
    """Consecutive corner pairs as ARRAY<STRUCT<x1, y1, x2, y2>>.

    A single point is an edge of no length.
    """
    def pair(i):
        a, b = F.get(ring, i), F.get(ring, F.least(i + 1, F.size(ring) - 1))
        return F.struct(a["x"].alias("x1"), a["y"].alias("y1"),
                        b["x"].alias("x2"), b["y"].alias("y2"))
    last = F.greatest(F.size(ring) - 2, F.lit(0))
    return F.when(F.size(ring) > 0, F.transform(F.sequence(F.lit(0), last), pair)).otherwise(F.array())


def centroid(ring: Column) -> Column:
    """Centroid STRUCT<x, y> of a closed ring by the shoelace sums.

    Without an area it is the mean of the corners.
    """
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, e):
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (s["a"] + cross).alias("a"),
            (s["x"] + (e["x1"] + e["x2"]) * cross).alias("x"),
            (s["y"] + (e["y1"] + e["y2"]) * cross).alias("y"),
        )

    def finish(s):
        return F.struct(F.try_divide(s["x"], 3 * s["a"]).alias("x"),
                        F.try_divide(s["y"], 3 * s["a"]).alias("y"))

    by_area = F.aggregate(edges(ring), zero, add, finish)
    mean = lambda axis: F.try_divide(
        F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[axis]), F.size(ring))
    return F.when(by_area["x"].isNotNull(), by_area).otherwise(
        F.struct(mean("x").alias("x"), mean("y").alias("y")))


def centroid_of_rings(rings: Column) -> Column:
    """Centroid of a shape of several closed rings, holes wound against the parts.

    The signed areas of the rings are summed; without an area in all it is the
    centroid of the first ring.
    """
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s, e):
        cross = e["x1"] * e["y2"] - e["x2"] * e["y1"]
        return F.struct(
            (s["a"] + cross).alias("a"),
            (s["x"] + (e["x1"] + e["x2"]) * cross).alias("x"),
            (s["y"] + (e["y1"] + e["y2"]) * cross).alias("y"),
        )

    all_edges = F.flatten(F.transform(rings, edges))
    whole = F.aggregate(all_edges, zero, add, lambda s: F.struct(
        F.try_divide(s["x"], 3 * s["a"]).alias("x"), F.try_divide(s["y"], 3 * s["a"]).alias("y")))
    return F.when(whole["x"].isNotNull(), whole).otherwise(centroid(F.get(rings, 0)))


def bounds(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"),
                    F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
