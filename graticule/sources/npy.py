"""Raw array files (.npy, two dimensions, C order) as a Spark data source."""

import ast
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK_ROWS = 64


def posix(path):
    """Array files are read by position, so they live on a mounted folder."""
    scheme, _, rest = path.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"array files need a mounted folder, not {path}")
    return "/" + rest.lstrip("/") if scheme else rest


def read_header(path):
    """(dtype, shape, byte offset of the data)."""
    with open(path, "rb") as f:
        if f.read(6) != b"\x93NUMPY":
            raise ValueError(f"not an array file: {path}")
        major = f.read(2)[0]
        size = int.from_bytes(f.read(2 if major == 1 else 4), "little")
        head = ast.literal_eval(f.read(size).decode("latin1"))
        if head["fortran_order"] or len(head["shape"]) != 2:
            raise ValueError("only C-ordered two-dimensional arrays are read")
        return np.dtype(head["descr"]), head["shape"], f.tell()


class RowRange(InputPartition):
    def __init__(self, first, last):
        super().__init__((first, last))
        self.first, self.last = first, last


class NpyGridSource(DataSource):
    """``spark.read.format("npy_grid").option("rows_per_task", n).load(path)``

    Each task seeks to its own rows; NaN and nodata become NULL.
    """

    @classmethod
    def name(cls):
        return "npy_grid"

    def schema(self):
        return "cell bigint, r bigint, c bigint, value double"

    def reader(self, schema):
        return NpyGridReader(self.options)


class NpyGridReader(DataSourceReader):
    def __init__(self, options):
        self.path = posix(options["path"])
        self.rows = int(options.get("rows_per_task", CHUNK_ROWS * 4))
        self.nodata = float(options.get("nodata", "nan"))

    def partitions(self):
        _, (height, _), _ = read_header(self.path)
        return [RowRange(a, min(a + self.rows, height)) for a in range(0, height, self.rows)]

    def read(self, partition):
        dtype, (_, width), offset = read_header(self.path)
        with open(self.path, "rb") as f:
            f.seek(offset + partition.first * width * dtype.itemsize, os.SEEK_SET)
            for first in range(partition.first, partition.last, CHUNK_ROWS):
                n = min(CHUNK_ROWS, partition.last - first)
                data = np.frombuffer(f.read(n * width * dtype.itemsize), dtype)
                values = data.astype("float64")
                cell = np.arange(first * width, (first + n) * width, dtype="int64")
                mask = np.isnan(values) | (values == self.nodata)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(cell // width), pa.array(cell % width),
                     pa.array(values, mask=mask)],
                    names=["cell", "r", "c", "value"],
                )


def scan_npy_grid(spark, path, **options):
    spark.dataSource.register(NpyGridSource)
    reader = spark.read.format("npy_grid")
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def write_npy_grid(df, path, height, width, value="value"):
    """Write a grid as one array file in a shared folder, each task its own rows.

    The driver writes the header and the size alone; every block of rows is written
    whole by one task, with missing values where the table has no cell, so doing it
    twice changes nothing.
    """
    path = posix(path)
    header = f"{{'descr': '<f8', 'fortran_order': False, 'shape': ({height}, {width}), }}"
    pad = -(len(header) + 11) % 64
    head = (header + " " * pad + "\n").encode("latin1")
    with open(path, "wb") as f:
        f.write(b"\x93NUMPY\x01\x00" + len(head).to_bytes(2, "little") + head)
        offset = f.tell()
        f.truncate(offset + height * width * 8)

    def store(block, cells):
        first = int(block.column("_b")[0].as_py()) * CHUNK_ROWS * width
        data = np.full(min(CHUNK_ROWS * width, height * width - first), np.nan, dtype="<f8")
        if cells.num_rows:
            values = cells.column("value").to_numpy(zero_copy_only=False).astype(float)
            data[cells.column("cell").to_numpy() - first] = values
        with open(path, "r+b") as f:
            f.seek(offset + first * 8)
            f.write(data.tobytes())
        return pa.table({"cell": pa.array([], pa.int64())})

    blocks = df.sparkSession.range(-(-height // CHUNK_ROWS)).select(F.col("id").alias("_b"))
    cells = df.selectExpr("cast(cell as bigint) as cell", f"cast({value} as double) as value").withColumn(
        "_at", F.floor(F.col("cell") / (CHUNK_ROWS * width)).cast("bigint"))
    blocks.groupBy("_b").cogroup(cells.groupBy("_at")).applyInArrow(
        store, "cell bigint").write.format("noop").mode("overwrite").save()
