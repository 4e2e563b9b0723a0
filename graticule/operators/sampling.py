"""Splits, balancing and sampling of cells, all in repeatable hash order."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.ranks import hash_rank, hash_take, hash_uniform, join_back


def distinct_regions_hit(df: DataFrame, region="rid", label="y") -> DataFrame:
    """Regions (other than 0, 'none') with at least one hazard cell."""
    return df.where((F.col(label) > 0) & (F.col(region) != 0)).select(region).distinct()


def spatial_split(df: DataFrame, region="rid", label="y", mask=None, seed=42,
                  train=0.8, validation=0.1, exclude=None) -> DataFrame:
    """Add ``split``: whole regions go to train 1, validation 2 or test 3.

    Only regions with hazards take part; cells elsewhere get 0, as do cells where
    ``mask`` is NULL or the condition ``exclude`` holds.
    """
    regions = distinct_regions_hit(df, region, label)
    n = regions.agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(regions, seed, region, into="_rank", size=n)
    code = (
        F.when(F.col("_rank") <= F.floor(F.lit(train) * n), 1)
        .when(F.col("_rank") <= F.floor(F.lit(train + validation) * n), 2)
        .otherwise(3)
    )
    coded = ranked.select(region, code.alias("_code"))
    value = F.coalesce(F.col("_code"), F.lit(0))
    if mask is not None:
        value = F.when(F.col(mask).isNull(), 0).otherwise(value)
    if exclude is not None:
        value = F.when(exclude, 0).otherwise(value)
    return df.join(coded, region, "left").withColumn("split", value.cast("int")).drop("_code")


def fixed_split(df: DataFrame, region, train, validation, test) -> DataFrame:
    """Split by explicit lists of regions."""
    code = (
        F.when(F.col(region).isin(train), 1)
        .when(F.col(region).isin(validation), 2)
        .when(F.col(region).isin(test), 3)
        .otherwise(0)
    )
    return df.withColumn("split", code)


def random_split(df: DataFrame, key="cell", train=0.8, test=0.15, seed=42) -> DataFrame:
    """80 % of all rows train, 15 % of all rows from the rest test (3), others 0."""
    n = df.agg(F.count(F.lit(1))).scalar()
    ranked = hash_rank(df, seed, key, into="_rank", size=n)
    cut = F.floor(F.lit(train) * n)
    code = (
        F.when(F.col("_rank") <= cut, 1)
        .when(F.col("_rank") <= cut + F.floor(F.lit(test) * n), 3)
        .otherwise(0)
    )
    return ranked.withColumn("split", code).drop("_rank")


def weighted_assign(df: DataFrame, key, first=0.7, seed=42) -> DataFrame:
    """Set 1 with probability ``first``, else set 2, independently per feature."""
    return df.withColumn(
        "part", F.when(hash_uniform(seed, key) < F.lit(first), 1).otherwise(2)
    )


def sample_n(df: DataFrame, n, key="cell", seed=42, split="split") -> DataFrame:
    """Exactly ``n`` of the rows that belong to a split; all rows when n is larger."""
    rows = df.where(F.col(split).isin(1, 2, 3))
    if n <= 0:
        return rows.limit(0)
    return hash_take(rows, seed, key, n)


def sample_fraction(df: DataFrame, fraction, key="cell", seed=42) -> DataFrame:
    """The given fraction of the rows, rounded down, without replacement."""
    n = df.agg(F.count(F.lit(1))).scalar()
    return hash_take(df, seed, key, F.floor(F.lit(fraction) * n), size=n)


def balance_by_region(df: DataFrame, split="split", region="rid", label="y",
                      key="cell", seed=42) -> DataFrame:
    """Thin the negatives of each (split, region) to its number of positives.

    Rows of split 0 are dropped; a group without positives loses all its
    negatives.  Rows whose label is neither 0 nor 1 keep their place.
    """
    groups = [split, region]
    rows = df.where(F.col(split).isin(1, 2, 3))
    sizes = rows.groupBy(*groups).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count(F.lit(1)).alias("_all"))
    quota = F.when(F.col(label) == 0, F.col("_pos")).otherwise(F.col("_all"))
    kept = hash_take(join_back(rows, sizes, groups), seed, key, quota, [*groups, label],
                     size=F.col("_all"))
    return kept.drop("_pos", "_all")


def balance_classes(df: DataFrame, ratio=1.0, label="y", key="cell", seed=42) -> DataFrame:
    """Undersample the larger class.

    Fewer positives: int(n_pos / ratio) negatives stay.  Otherwise int(n_neg *
    ratio) positives stay.  With a class missing nothing changes.
    """
    pos, neg = _class_sizes(df, label)
    no_class = (pos == 0) | (neg == 0)
    quota = (
        F.when(no_class, pos + neg)
        .when((F.col(label) == 0) & (pos < neg), F.floor(pos / F.lit(ratio)))
        .when((F.col(label) == 1) & (pos >= neg), F.floor(neg * F.lit(ratio)))
        .otherwise(pos + neg)
    )
    return hash_take(df, seed, key, quota, [label], size=pos + neg)


def _class_sizes(df, label):
    """Number of positives and of negatives, from one pass."""
    sizes = F.struct(F.count_if(F.col(label) == 1).alias("pos"),
                     F.count_if(F.col(label) == 0).alias("neg"))
    both = df.agg(sizes.alias("_sizes")).scalar()
    return both["pos"], both["neg"]


def class_weight(df: DataFrame, ratio, label="y", into="weight") -> DataFrame:
    """``ratio`` for positive rows, 1 for others."""
    y = F.col(label)
    return df.withColumn(into, (y * F.lit(float(ratio)) + (1 - y)).cast("double"))


def balanced_batches(df: DataFrame, batch_size, neg_ratio=1.0, label="y", key="cell",
                     seed=42, replacement=False) -> DataFrame:
    """Assign rows to batches with fixed shares of positives and negatives.

    Incomplete batches are left out.  With replacement each of the n draws of a
    class picks a random member, so a row may appear several times.
    """
    pos_per = int(batch_size / (1 + neg_ratio))
    neg_per = batch_size - pos_per
    if pos_per == 0:
        raise ValueError("batch size too small for the given ratio of negatives")
    rows = df.where(F.col(label).isin(0, 1))
    pos, neg = _class_sizes(rows, label)
    ranked = hash_rank(rows, seed, key, [label], into="_rank", size=pos + neg)
    if replacement:
        ranked = _redraw(ranked, label, seed)
    batches = F.least(F.floor(pos / pos_per), F.floor(neg / max(neg_per, 1)))
    per = F.when(F.col(label) == 1, pos_per).otherwise(max(neg_per, 1))
    return (
        ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / per).cast("long"))
        .where(F.col("batch") < batches)
        .drop("_rank")
    )


def _redraw(ranked, label, seed):
    """Replace each rank's row by the row at a random rank of the same class."""
    sizes = ranked.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    draws = join_back(ranked.select(label, F.col("_rank").alias("_draw")), sizes, [label])
    pick = F.floor(hash_uniform(f"{seed}:draw", label, "_draw") * F.col("_n")) + 1
    draws = draws.select(label, "_draw", pick.cast("long").alias("_rank"))
    return ranked.join(draws, [label, "_rank"]).drop("_rank").withColumnRenamed("_draw", "_rank")


def ensemble_slice(df: DataFrame, member, ratio=0.8, stride=None, key="cell",
                   seed=42) -> DataFrame:
    """The member's contiguous slice of the shuffled rows.

    The slice has ``ratio * n`` rows from ``stride * n * member`` on; the stride
    defaults to the ratio, so member 1 gets the last 20 % and later ones none.
    """
    stride = ratio if stride is None else stride
    n = df.agg(F.count(F.lit(1))).scalar()
    start = F.floor(F.lit(stride) * n * F.lit(member))
    end = F.floor(F.lit(stride) * n * F.lit(member) + F.lit(ratio) * n)
    ranked = hash_rank(df, seed, key, into="_rank", size=n)
    return ranked.where((F.col("_rank") > start) & (F.col("_rank") <= end)).drop("_rank")


def exclude_regions(df: DataFrame, region, names, split="split") -> DataFrame:
    """Set the split of the listed regions to 0 (``names``: one-column table)."""
    listed = names.select(F.col(names.columns[0]).alias(region)).distinct()
    flagged = df.join(listed.withColumn("_out", F.lit(True)), region, "left")
    value = F.when(F.col("_out"), 0).otherwise(F.col(split))
    return flagged.withColumn(split, value).drop("_out")


def exclude_water(df: DataFrame, landcover, classes=(210,), split="split") -> DataFrame:
    """Set the split of cells with the listed land-cover classes to 0."""
    value = F.when(F.col(landcover).isin(list(classes)), 0).otherwise(F.col(split))
    return df.withColumn(split, value)


def valid_margin(df: DataFrame, split_code, height, width, patch=5, split="split"):
    """Cells of a split whose whole patch lies on the raster."""
    margin = patch // 2
    return df.where(
        (F.col(split) == split_code)
        & F.col("r").between(margin, height - margin - 1)
        & F.col("c").between(margin, width - margin - 1)
    )


def assemble_split_map(grid: DataFrame, train, validation, test, key="cell") -> DataFrame:
    """Three id tables onto one grid as 1/2/3, 0 elsewhere; the last list wins."""
    tag = lambda ids, code: ids.select(key, F.lit(code).alias("_code"))
    tagged = tag(train, 1).unionAll(tag(validation, 2)).unionAll(tag(test, 3))
    coded = tagged.groupBy(key).agg(F.max("_code").alias("_code"))
    return grid.join(coded, key, "left").withColumn(
        "split", F.coalesce("_code", F.lit(0))
    ).drop("_code")
