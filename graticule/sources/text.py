"""Text inputs: ESRI ASCII grids and event tables with WKT geometry."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators.ranks import ordered_rank

EVENTS = T.StructType([
    T.StructField("event", T.StringType()),
    T.StructField("hazard", T.StringType()),
    T.StructField("starttime", T.StringType()),
    T.StructField("endtime", T.StringType()),
    T.StructField("geometry", T.StringType()),
])

HEADER_LINES = 6


def scan_ascii_grid(spark, path) -> DataFrame:
    """ESRI ASCII grid: six header lines, then one line of numbers per row.

    ``path`` is a file or a folder of parts in name order.  Spark's text reader
    keeps no line numbers, but blocks are known by file and offset and lines come
    in order within a block, so numbering the sorted (file, block, line) triples
    gives true row numbers without reading the file in one task.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    ).where(F.length(F.trim("value")) > 0)
    numbered = ordered_rank(lines, ["_file", "_block", "_line"], "_row", start=0)
    header = (
        numbered.where(F.col("_row") < HEADER_LINES)
        .select(F.split(F.trim("value"), r"\s+").alias("w"))
        .select(F.lower(F.col("w")[0]).alias("k"), F.col("w")[1].cast("double").alias("v"))
    )
    head = {row["k"]: row["v"] for row in header.collect()}  # six lines
    nodata = head.get("nodata_value", -9999.0)
    width = int(head["ncols"])
    body = numbered.where(F.col("_row") >= HEADER_LINES).select(
        (F.col("_row") - HEADER_LINES).alias("r"),
        F.posexplode(F.split(F.trim("value"), r"\s+")).alias("c", "text"),
    )
    value = F.col("text").cast("double")
    return body.select(
        (F.col("r") * width + F.col("c")).cast("long").alias("cell"),
        "r", F.col("c").cast("long").alias("c"),
        F.when(value != F.lit(nodata), value).alias("value"),
    )


def wkt_rings(wkt):
    """Outer and inner rings (or lines, or the point) of a WKT text.

    Result: ARRAY<ARRAY<STRUCT<x, y>>>, one entry per parenthesised list.
    """
    parts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    point = lambda text: F.struct(
        F.split(F.trim(text), r"\s+")[0].cast("double").alias("x"),
        F.split(F.trim(text), r"\s+")[1].cast("double").alias("y"),
    )
    return F.transform(parts, lambda ring: F.transform(F.split(ring, ","), point))


def scan_events_csv(spark, path, schema=EVENTS, time_format="yyyy-MM-dd'T'HH:mm:ss") -> DataFrame:
    """Event table: times parsed (bad ones NULL), geometry as rings.

    Rows whose geometry has no ring with numeric corners are marked invalid and
    dropped, as they cover no cell.
    """
    raw = spark.read.csv(path, header=True, schema=schema, quote='"', escape='"')
    parsed = raw.withColumns({
        "starttime": F.try_to_timestamp("starttime", F.lit(time_format)),
        "endtime": F.try_to_timestamp("endtime", F.lit(time_format)),
        "rings": wkt_rings(F.col("geometry")),
    })
    broken = lambda ring: F.exists(ring, lambda p: p.x.isNull() | p.y.isNull())
    return parsed.where(
        (F.size("rings") > 0) & ~F.exists("rings", broken)
    )
