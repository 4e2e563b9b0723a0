"""Exact ranks and running sums that never put one group into one task.

``row_number() over (partition by region order by ...)`` sorts a whole region in
one task, and a window without partition keys sorts the whole table in one.  A
region (or model, or class) may hold a third of all cells, so the helpers here
cut each group into buckets that are ordered among themselves, number the rows
inside each bucket, and add the size of the buckets before it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.session import durable

# Rows that one bucket should hold; groups below it stay in one piece.
BUCKET_ROWS = 250_000


def shuffle_key(seed, *keys) -> Column:
    """Reproducible random order: md5 of ``seed:key[:key...]``."""
    parts = [F.lit(f"{seed}")] + [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", *parts))


def hash_uniform(seed, *keys) -> Column:
    """Reproducible uniform number in [0, 1) from the same hash."""
    head = F.conv(F.substring(shuffle_key(seed, *keys), 1, 8), 16, 10)
    return head.cast("double") / F.lit(4294967296.0)


def _digits(rows: Column, bucket_rows) -> Column:
    """Hex digits of the hash needed so that a bucket holds ``bucket_rows``."""
    need = F.ceil(F.log(16.0, rows / F.lit(float(bucket_rows))))
    return F.greatest(F.lit(0), need).cast("int")


def join_back(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Attach per-key columns; a NULL key matches the NULL group.

    A hot key is no hazard here: the small side has one row per key, so the join
    is either a broadcast (Spark checks the size) or a sort-merge join whose
    oversized partitions adaptive execution splits.
    """
    keys = list(keys)
    renamed = small.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    return df.join(renamed, match).drop(*[f"_on_{k}" for k in keys])


def _bucketed(df, order, keys, bucket_rows, size=None):
    keys = list(keys)
    if size is not None:
        tagged = df.withColumn("_n", size)
    elif keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        tagged = join_back(df, sizes, keys)
    else:
        total = df.agg(F.count(F.lit(1)).alias("_n")).scalar()
        tagged = df.withColumn("_n", total)
    tagged = tagged.withColumn(
        "_bucket", F.substring(order, F.lit(1), _digits(F.col("_n"), bucket_rows))
    )
    by = keys + ["_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        tagged.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return join_back(tagged, offsets, by), by


def hash_rank(df: DataFrame, seed, key, keys=(), into="rank",
              bucket_rows=BUCKET_ROWS, size=None) -> DataFrame:
    """1-based rank of each row within ``keys`` in random but repeatable order.

    ``key`` names the row (unique within its group); its md5 gives the order.
    Hash prefixes are evenly filled, so a bucket never exceeds its share however
    large the group is.
    """
    key = [key] if isinstance(key, str) else list(key)
    work = df.withColumn("_h", shuffle_key(seed, *key))
    placed, by = _bucketed(work, F.col("_h"), keys, bucket_rows, size)
    inner = Window.partitionBy(*by).orderBy("_h", *key)
    rank = (F.col("_before") + F.row_number().over(inner)).cast("long")
    return placed.withColumn(into, rank).drop("_h", "_n", "_bucket", "_before")


def hash_take(df: DataFrame, seed, key, quota, keys=(), bucket_rows=BUCKET_ROWS,
              size=None) -> DataFrame:
    """Keep exactly ``quota`` random rows per group (all when it has fewer).

    ``quota`` is a number or a column that is constant within the group.  Buckets
    entirely past the quota are dropped before anything is sorted.  A caller that
    knows the groups' sizes passes them as a column and saves a pass.
    """
    key = [key] if isinstance(key, str) else list(key)
    quota = quota if isinstance(quota, Column) else F.lit(quota)
    work = df.withColumn("_h", shuffle_key(seed, *key)).withColumn("_quota", quota)
    placed, by = _bucketed(work, F.col("_h"), keys, bucket_rows, size)
    placed = placed.where(F.col("_before") < F.col("_quota"))
    inner = Window.partitionBy(*by).orderBy("_h", *key)
    return (
        placed.withColumn("_rank", F.row_number().over(inner))
        .where(F.col("_before") + F.col("_rank") <= F.col("_quota"))
        .drop("_h", "_n", "_bucket", "_before", "_rank", "_quota")
    )


def _between(value: Column, bounds) -> Column:
    """How many of the sorted literal ``bounds`` are <= value (binary search)."""
    if not bounds:
        return F.lit(0)
    steps = []
    step = 1
    while step * 2 <= len(bounds):
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    table = F.array(*[F.lit(float(b)) for b in bounds])
    jump = lambda at, s: F.when(
        (at + s <= len(bounds)) & (F.get(table, at + s - 1) <= value), at + s
    ).otherwise(at)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), jump)


def prefix_sums(df: DataFrame, order, sums, keys=(), descending=False,
                buckets=None) -> DataFrame:
    """Running sums (inclusive) along ``order`` within ``keys``.

    ``df`` has one row per (keys, order), ``order`` being numeric; ``sums`` maps
    each new column to the column it accumulates.  The bucket limits are
    quantiles over the whole table: at most ``buckets`` numbers, the only thing
    that reaches the driver.  They enter the plan as literals, so a task that is
    run again buckets its rows as before.
    """
    keys = list(keys)
    if buckets is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(16, min(1024, 2 * parts))
    points = [i / buckets for i in range(1, buckets)]
    found = df.agg(F.percentile_approx(order, points, 10 * buckets)).first()[0]
    bounds = sorted({b for b in (found or [])})
    tagged = df.withColumn("_bucket", _between(F.col(order).cast("double"), bounds))
    along = F.col(order).desc() if descending else F.col(order).asc()
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*keys).orderBy(bucket_order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    totals = tagged.groupBy(*keys, "_bucket").agg(
        *[F.sum(src).alias(f"_sum_{out}") for out, src in sums.items()]
    )
    offsets = totals.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_sum_{out}").over(before), F.lit(0)).alias(f"_off_{out}")
          for out in sums],
    )
    inner = Window.partitionBy(*keys, "_bucket").orderBy(along).rowsBetween(
        Window.unboundedPreceding, 0
    )
    placed = join_back(tagged, offsets, keys + ["_bucket"])
    for out, src in sums.items():
        placed = placed.withColumn(
            out, F.col(f"_off_{out}") + F.sum(src).over(inner)
        )
    return placed.drop("_bucket", *[f"_off_{out}" for out in sums])


def ordered_rank(df: DataFrame, order, into="rank", start=1) -> DataFrame:
    """Consecutive numbers along a total order of any type.

    A range-partitioned sort puts the rows in order; position = rows in the
    partitions before + position inside the partition.  The sorted table is
    checkpointed first because its partition numbers must not change between the
    counting pass and the numbering pass.
    """
    tag = F.monotonically_increasing_id()
    placed = durable(df.orderBy(*order).withColumn("_at", tag))
    part = F.shiftrightunsigned("_at", 33)
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .drop("_rows")
    )
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(into, (F.col("_before") + local + F.lit(start)).cast("long"))
        .drop("_at", "_part", "_before")
    )
