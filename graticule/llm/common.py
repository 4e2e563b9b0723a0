"""Helpers shared by the training-data operators."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Rows in one Arrow batch: texts are whole, so batches are kept short.
BATCH_ROWS = 512

# White space by the contract: space, tab, line feed, vertical tab, form feed, return.
SPACE = r"[\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` has the name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for the row."""
    return F.transform(F.array(value), body)[0]


def short_batches(spark: SparkSession):
    """Keep Arrow batches of whole texts small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key written as text, modulo ``modulus``; null keys count as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


letters = re.compile(r"[^\W\d_]+")
