"""Session defaults and lineage cuts."""

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app="graticule", cores="*", partitions=8):
    """A session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as named by the session.

    That is ``spark.checkpoint.dir``.  Only a session in one process without one gets
    a temporary folder; on a cluster, a local one too, that would not survive the
    loss of an executor, so it is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="graticule-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared scratch folder and drop its lineage.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` the files go once the
    result is no longer referenced, so a loop keeps its last round only.
    """
    scratch_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared scratch folder, read again.

    For loops with many joins: a checkpoint keeps the partitionings and constraints that
    its plan had, so they pile up from round to round and planning slows down; a table
    that is read again starts afresh.  ``discard`` deletes it.
    """
    path = f"{scratch_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._graticule_path = path
    return table


def discard(*tables: DataFrame):
    """Delete tables of ``stored`` that nothing will read any more; others are left alone."""
    for table in tables:
        path = getattr(table, "_graticule_path", None)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def ship_package(spark: SparkSession):
    """Make this package importable in Python workers on every executor.

    The same as submitting with ``--py-files``; done once per application.
    """
    context = spark.sparkContext
    if getattr(context, "_graticule_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="graticule-code-"), "graticule.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("graticule", os.path.relpath(full, root)))
    context.addPyFile(path)
    context._graticule_shipped = True
