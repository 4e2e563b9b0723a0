"""Layers on disk: registry, scans, writes, and small reports."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The conditioning variables of each hazard and their kind
# (c continuous, k categorical).
HAZARD_VARIABLES = {
    "landslide": "elevation c, slope c, landcover k, aspect c, NDVI c, precipitation_daily c,"
                 " accuflux c, HWSD k, GEM c, curvature c, GLIM k",
    "flood": "elevation c, slope c, landcover k, aspect c, NDVI c, precipitation_daily c,"
             " accuflux c",
    "wildfire": "temperature_daily c, NDVI c, landcover k, elevation c, wind_speed_daily c,"
                " fire_weather c, soil_moisture_root c",
    "multi_hazard": "drought c, extreme_wind c, heatwave c, volcano c, wildfire c,"
                    " landslide c, flood c",
    "tsunami": "elevation c, coastlines c, GEM c",
}

LAYER = T.StructType([
    T.StructField("r", T.LongType()),
    T.StructField("c", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

REGISTRY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("role", T.StringType()),
])

METRICS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("model", "experiment")]
    + [T.StructField(n, T.DoubleType()) for n in (
        "accuracy", "precision", "recall", "f1", "auroc", "ap", "mae", "best_threshold")]
)


def hazard_variables(hazard):
    """[(variable, kind)] in the order the model expects."""
    if hazard not in HAZARD_VARIABLES:
        raise ValueError(f"unknown hazard: {hazard}")
    pairs = [p.split() for p in HAZARD_VARIABLES[hazard].split(",")]
    kinds = {"c": "continuous", "k": "categorical"}
    return [(name, kinds[k]) for name, k in pairs]


class Registry:
    """Names of layers with path, kind and role (feature, label, region)."""

    def __init__(self, entries):
        self.entries = {e[0]: tuple(e) for e in entries}

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(list(self.entries.values()), REGISTRY)

    def check(self, names):
        unknown = [n for n in names if n not in self.entries]
        if unknown:
            raise ValueError(f"unknown layers: {unknown}; known: {sorted(self.entries)}")
        return list(names)

    def read(self, spark, names) -> DataFrame:
        """Long table (name, r, c, value) of the named layers."""
        parts = [
            spark.read.schema(LAYER).parquet(self.entries[n][1]).withColumn("name", F.lit(n))
            for n in self.check(names)
        ]
        return reduce(DataFrame.unionByName, parts)

    def describe(self, long: DataFrame) -> DataFrame:
        """Attach kind and role to a long layer table; an unlisted name is an error."""
        known = self.frame(long.sparkSession)
        checked = long.join(known, "name", "left")
        unknown = F.raise_error(F.concat(F.lit("unknown layer: "), F.col("name")))
        return checked.withColumn("kind", F.when(F.col("kind").isNull(), unknown.cast("string"))
                                  .otherwise(F.col("kind")))


def scan_layer(spark, path, value="value", index=None, width=None, where=None) -> DataFrame:
    """Read one layer as (cell, r, c, value).

    Files hold either ``r, c`` or a flat ``index`` (with the grid's width).  The
    filter and the column choice reach the Parquet scan.
    """
    raw = spark.read.parquet(path)
    if where is not None:
        raw = raw.where(where)
    if index is None:
        return raw.select("r", "c", F.col(value).cast("double").alias("value"))
    return raw.select(
        F.col(index).alias("cell"),
        F.floor(F.col(index) / width).cast("long").alias("r"),
        (F.col(index) % width).cast("long").alias("c"),
        F.col(value).cast("double").alias("value"),
    )


def union_years(parts, first, last, year="year") -> DataFrame:
    """Stack per-year tables (columns may differ) and keep the year range."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.where(F.col(year).between(first, last))


def read_years(spark, path, first, last, schema=None) -> DataFrame:
    """One table laid out in ``year=`` folders; other years are not opened."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(F.col("year").between(first, last))


def write_layer(df: DataFrame, path, block=256, mode="overwrite"):
    """Write a grid in folders of ``block`` rows, sorted for row-group pruning.

    Range partitioning keeps file sizes even; a row block that is crowded is
    spread over several files by column.
    """
    blocked = df.withColumn("row_block", F.floor(F.col("r") / block).cast("long"))
    (
        blocked.repartitionByRange("row_block", "c")
        .sortWithinPartitions("row_block", "r", "c")
        .write.mode(mode).partitionBy("row_block").parquet(path)
    )


def save_bucketed(df: DataFrame, name, path, buckets, key="cell"):
    """Save one layer as table ``name`` under ``path``, bucketed and sorted by the cell.

    Layers with the same ``buckets`` join (``joins.align_layers``) without an exchange:
    the shuffle is paid here, once a layer, and not in every query.  Each bucket is one
    file; take as many buckets as keep a file within a few hundred MB.
    """
    (
        df.repartition(buckets, key).write.mode("overwrite")
        .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    )
    return df.sparkSession.table(name)


def append_metrics(df: DataFrame, path):
    """Add a run's metrics rows to the table of all runs."""
    df.select(*[F.col(f.name).cast(f.dataType) for f in METRICS.fields]).write.mode(
        "append"
    ).parquet(path)


def read_metrics(spark, path) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path)


def write_json_report(df: DataFrame, path, mode="overwrite"):
    """Breaks or region statistics as JSON lines."""
    df.write.mode(mode).json(path)


def read_json_report(spark, path, schema) -> DataFrame:
    return spark.read.schema(schema).json(path)
