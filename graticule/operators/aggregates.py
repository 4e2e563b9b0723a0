"""Statistics of layers, hazards and regions.

All are partial-then-final aggregations: what is shuffled is one partial row per
task and group, so a crowded group costs no more than a small one.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.operators.ranks import join_back, prefix_sums


def _n():
    return F.count(F.lit(1))


def hazard_stats(df: DataFrame, hazard="hazard", region="region_id", n="n") -> DataFrame:
    """Per hazard: hazard cells, cells in a region, coverage in % (two decimals).

    The coverage of a hazard without a region cell is NULL.
    """
    hit = F.count_if((F.col(n) > 0) & (F.col(region) > 0))
    return df.groupBy(hazard).agg(
        hit.alias("n_hazard_pixels"), F.count_if(F.col(region) > 0).alias("n_pixels")
    ).withColumn(
        "hazard_coverage",
        F.round(F.try_divide("n_hazard_pixels", "n_pixels") * 100, 2),
    )


def region_stats(df: DataFrame, keys=("hazard",), region="region_id", n="n") -> DataFrame:
    """Per region other than 0: hazard cells, cells, coverage in %."""
    return df.where(F.col(region) != 0).groupBy(*keys, region).agg(
        F.count_if(F.col(n) > 0).alias("n_hazard_pixels"), _n().alias("n_pixel")
    ).withColumn("hazard_coverage", F.col("n_hazard_pixels") / F.col("n_pixel") * 100)


def region_spread(stats: DataFrame, hazard="hazard") -> DataFrame:
    """Spread of the regions' hazard counts per hazard (population deviation)."""
    c = F.col("n_hazard_pixels")
    return stats.groupBy(hazard).agg(
        F.avg(c).alias("avg_hazard_count"), F.min(c).alias("min_hazard_count"),
        F.max(c).alias("max_hazard_count"), F.stddev_pop(c).alias("std_hazard_count"),
    )


def layer_profile(df: DataFrame, value="value", keys=("name",), exact=True) -> DataFrame:
    """Extent, range, distinct values, missing and non-zero counts per layer.

    The exact distinct count goes through one row per distinct value; the
    approximate one needs a single pass.
    """
    v = F.col(value)
    nonzero = F.count_if(v.isNull() | (v != 0))
    distinct = F.count_distinct(v) if exact else F.approx_count_distinct(v)
    return df.groupBy(*keys).agg(
        _n().alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
        distinct.alias("n_distinct"), F.count_if(v.isNull()).alias("n_missing"),
        nonzero.alias("n_nonzero"),
    ).withColumn("nonzero_ratio", F.col("n_nonzero") / F.col("n"))


def class_balance(df: DataFrame, split="split", label="y") -> DataFrame:
    return df.groupBy(split, label).agg(_n().alias("n"))


def split_counts(df: DataFrame, split="split") -> DataFrame:
    return df.groupBy(split).agg(_n().alias("n"))


def value_counts(df: DataFrame, code) -> DataFrame:
    return df.groupBy(code).agg(_n().alias("n")).orderBy(F.desc("n"), code)


def multi_hazard_index(events: DataFrame, event="event", cell="cell") -> DataFrame:
    """Per cell the number of hazards beyond the first, summed over events."""
    per_event = events.groupBy(event, cell).agg(_n().alias("_n")).where(F.col("_n") > 1)
    return per_event.groupBy(cell).agg(F.sum(F.col("_n") - 1).alias("mh_index"))


def union_layers_cap(a, b, cap=1) -> Column:
    """Sum of two binary layers, at most ``cap``; missing if either is."""
    total = F.col(a) + F.col(b)
    return F.when(total > cap, F.lit(cap)).otherwise(total)


def yearly(df: DataFrame, how, value, date="date", cell="cell", into="value") -> DataFrame:
    """Yearly max, mean or sum per cell; missing days are skipped."""
    fn = {"max": F.max, "mean": F.avg, "sum": F.sum}[how]
    return df.groupBy(cell, F.year(date).alias("year")).agg(fn(value).alias(into))


def mean_over_years(df: DataFrame, value="value", cell="cell", into="value") -> DataFrame:
    """Mean over yearly layers; a cell with a missing year is missing."""
    mean = F.when(F.count_if(F.col(value).isNull()) == 0, F.avg(value))
    return df.groupBy(cell).agg(mean.alias(into))


def latest_year(df: DataFrame, value="value", cell="cell", year="year") -> DataFrame:
    """Value of the last year, whether missing or not."""
    last = F.max_by(F.struct(F.col(value).alias("v")), year)
    return df.groupBy(cell).agg(last.alias("_l")).select(cell, F.col("_l.v").alias(value))


def corr_matrix(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of all pairs of layers, over rows where both exist."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"c{i}").alias("corr"))
             for i, p in enumerate(pairs) for x, y in (p, p[::-1])]
    cells += [F.struct(F.lit(a).alias("a"), F.lit(a).alias("b"), F.lit(1.0).alias("corr"))
              for a in columns]
    return one.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def bin_index(value: Column, low, high, bins) -> Column:
    """Equal-width bin 0..bins-1 on [low, high]; the last bin includes ``high``."""
    at = F.floor((value - F.lit(float(low))) / F.lit(float(high - low)) * bins)
    return F.when(value == high, bins - 1).when(
        (value >= low) & (value < high), F.least(at, F.lit(bins - 1))
    ).cast("int")


def histogram(df: DataFrame, value, low, high, bins, keys=()) -> DataFrame:
    """Rows per bin (and key); values outside the range are not counted."""
    return df.withColumn("bin", bin_index(F.col(value), low, high, bins)).where(
        F.col("bin").isNotNull()
    ).groupBy(*keys, "bin").agg(_n().alias("n"))


def quantiles(df: DataFrame, value, at, keys=()) -> DataFrame:
    """Exact linear-interpolation quantiles of a value within groups of any size.

    Values are first counted, then accumulated along their order, so no task
    holds a group's values; each quantile needs the two values around its rank.
    """
    keys = list(keys)
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(_n().alias("_n"))
    running = prefix_sums(counts, value, {"_upto": "_n"}, keys)
    totals = known.groupBy(*keys).agg(_n().alias("_total"))
    spots = F.explode(F.array(*[
        F.struct(F.lit(float(q)).alias("q"), F.lit(i).alias("i")) for i, q in enumerate(at)
    ]))
    want = totals.select(*keys, "_total", spots.alias("s")).select(
        *keys, F.col("s.q").alias("q"), (F.col("s.q") * (F.col("_total") - 1)).alias("_pos")
    )
    # the group's wanted ranks travel as one small array next to its values
    packed = want.groupBy(*keys).agg(F.collect_list(F.struct("q", "_pos")).alias("_want"))
    near = (
        join_back(running, packed, keys) if keys
        else running.withColumn("_want", packed.select("_want").scalar())
    ).withColumn("_from", F.col("_upto") - F.col("_n"))
    holds = lambda k: (F.col("_from") <= k) & (k < F.col("_upto"))
    around = lambda w: holds(F.floor(w["_pos"])) | holds(F.ceil(w["_pos"]))
    # only the values next to a wanted rank leave this step
    near = near.select(*keys, F.col(value).alias("_v"), "_from", "_upto",
                       F.explode(F.filter("_want", around)).alias("w"))
    lo, hi = F.floor("w._pos"), F.ceil("w._pos")
    picked = near.groupBy(
        *keys, F.col("w.q").alias("q"), F.col("w._pos").alias("_pos")
    ).agg(
        F.max(F.when(holds(lo), F.col("_v"))).alias("_a"),
        F.max(F.when(holds(hi), F.col("_v"))).alias("_b"),
    )
    part = F.col("_pos") - F.floor("_pos")
    return picked.select(
        *keys, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * part).alias("value")
    )


def kde_1d(df: DataFrame, value, low, high, points=50, bins=512, keys=()) -> DataFrame:
    """Gaussian density at ``points`` places of [low, high], Scott bandwidth.

    Every value counts, inside the range or not: values are reduced to the mean and
    number of each of the bins of the range's width / ``bins`` that they fall into,
    on either side of the range too.  A key with one value, or equal ones, has no
    bandwidth and a NULL density.
    """
    keys = list(keys)
    width = (high - low) / bins
    counts = df.where(F.col(value).isNotNull()).groupBy(
        *keys, F.floor((F.col(value) - F.lit(float(low))) / width).alias("bin")
    ).agg(_n().alias("n"), F.avg(value).alias("_x"))
    w, x = F.col("n"), F.col("_x")
    # moments of the binned sample; sample variance as in Scott's rule
    total, mean = F.sum(w), F.sum(w * x) / F.sum(w)
    stats = counts.groupBy(*keys).agg(
        total.alias("_n"), mean.alias("_mean"), F.sum(w * x * x).alias("_xx"))
    var = F.try_divide(F.col("_xx") - F.col("_n") * F.col("_mean") * F.col("_mean"), F.col("_n") - 1)
    # what is left of equal values after rounding is no spread
    var = F.when(var > 1e-12 * F.col("_mean") * F.col("_mean"), var)
    bandwidth = F.sqrt(var) * F.pow(F.col("_n"), F.lit(-0.2))
    stats = stats.select(*keys, "_n", bandwidth.alias("_h"))
    step = (high - low) / (points - 1)
    place = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)),
                                  lambda i: F.lit(low) + i * step))
    joined = join_back(counts, stats, keys) if keys else counts.withColumn(
        "_s", stats.select(F.struct("_n", "_h")).scalar()
    ).withColumns({"_n": F.col("_s._n"), "_h": F.col("_s._h")})
    z = (F.col("x") - F.col("_x")) / F.col("_h")
    weight = F.col("n") / (F.col("_n") * F.col("_h") * F.sqrt(2 * F.pi()))
    return joined.withColumn("x", place).groupBy(*keys, "x").agg(
        F.sum(weight * F.exp(-0.5 * z * z)).alias("density"))


def kde_1d_within(df: DataFrame, value, low, high, points=50, tolerance=1e-9, keys=()) -> DataFrame:
    """Gaussian density at ``points`` places of [low, high], Scott bandwidth h, with a bound.

    No density differs from the sum over all values by more than ``tolerance`` times the
    height of one kernel, ``1 / (h sqrt(2 pi))``.  Values are reduced to power sums in bins
    of width h, as many as the expansion of the kernel in Hermite polynomials needs: its
    remainder after p terms is at most ``1.0865 * 0.5**p / sqrt(p!)`` by Cramer's
    inequality.  A bin meets only the places within the kernel's reach, so there are at
    most some 20 rows per place and key, however far the values spread; far values count
    in n and h.  NULL values do not count; a key with one value, or equal ones, has no
    bandwidth and a NULL density.
    """
    keys = list(keys)
    terms = next(p for p in range(1, 100)
                 if 1.0865 * 0.5 ** p / math.sqrt(math.factorial(p)) <= tolerance / 2)
    reach = math.sqrt(2 * math.log(2 / tolerance)) + 0.5
    step, low = (high - low) / (points - 1), float(low)
    v = F.col(value).cast("double")
    sample = df.where(F.col(value).isNotNull()).select(*keys, v.alias("_v"))
    spread = F.stddev_samp("_v")
    stats = sample.groupBy(*keys).agg(
        _n().alias("_n"), F.when(spread > 1e-12 * F.abs(F.avg("_v")), spread).alias("_s")
    ).select(*keys, "_n", (F.col("_s") * F.pow("_n", F.lit(-0.2))).alias("_h"))

    def with_stats(rows):
        if keys:
            return join_back(rows, stats, keys)
        return rows.withColumn("_t", stats.select(F.struct("_n", "_h")).scalar()).select(
            *rows.columns, "_t._n", "_t._h")

    h = F.col("_h")
    near = with_stats(sample).where(
        (F.col("_v") >= low - (reach + 1) * h) & (F.col("_v") <= high + (reach + 1) * h)
    ).withColumn("_bin", F.floor((F.col("_v") - low) / h))
    off = (F.col("_v") - low) / h - F.col("_bin") - 0.5
    sums = near.groupBy(*keys, "_bin", "_n", "_h").agg(F.array(*[
        F.sum(F.pow(off, F.lit(k)) / math.factorial(k)) for k in range(terms)]).alias("_m"))
    centre = low + (F.col("_bin") + 0.5) * h
    first = F.greatest(F.ceil((centre - reach * h - low) / step), F.lit(0))
    last = F.least(F.floor((centre + reach * h - low) / step), F.lit(points - 1))
    met = sums.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("_i"))
    t = (low + F.col("_i") * step - centre) / h
    # He(k+1) = t He(k) - k He(k-1), along the power sums
    series = F.aggregate(
        F.col("_m"),
        F.struct(F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("k"), F.lit(0.0).alias("sum")),
        lambda a, m: F.struct(
            a["he"].alias("before"), (t * a["he"] - a["k"] * a["before"]).alias("he"),
            (a["k"] + 1.0).alias("k"), (a["sum"] + m * a["he"]).alias("sum")),
        lambda a: a["sum"])
    part = met.select(*keys, "_i", (
        F.exp(-0.5 * t * t) * series / (F.col("_n") * h * math.sqrt(2 * math.pi))).alias("_d"))
    # places out of every bin's reach have density 0, keys without a bandwidth none
    every = stats.select(
        *keys, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("_i"),
        F.when(h.isNotNull(), 0.0).alias("_d"))
    return part.unionByName(every).groupBy(*keys, "_i").agg(F.sum("_d").alias("density")).select(
        *keys, (low + F.col("_i") * step).alias("x"), "density")


def kde_2d(df: DataFrame, x, y, points=100, bins=100) -> DataFrame:
    """Bivariate Gaussian density on a points x points grid, Scott bandwidth.

    The sample is reduced to ``bins`` squared weighted centres over its range;
    the covariance of the unbinned sample gives the kernel.  A task adds up the grid
    of the centres that it holds, so what is shuffled is one grid per task.  Without
    spread in both directions there is no density and no row.
    """
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = both.agg(
        _n().alias("n"), F.var_samp(x).alias("xx"), F.var_samp(y).alias("yy"),
        F.covar_samp(x, y).alias("xy"), F.min(x).alias("x0"), F.max(x).alias("x1"),
        F.min(y).alias("y0"), F.max(y).alias("y1"),
    ).first()
    if s["n"] < 2 or not s["xx"] or not s["yy"]:  # no spread, no density
        return df.sparkSession.createDataFrame([], "x double, y double, density double")
    scott = s["n"] ** (-1.0 / 6)
    a, b, c = (v * scott ** 2 for v in (s["xx"], s["xy"], s["yy"]))
    det = a * c - b * b
    if det <= 1e-12 * a * c:  # all points on one line
        return df.sparkSession.createDataFrame([], "x double, y double, density double")
    binned = both.select(
        bin_index(F.col(x), s["x0"], s["x1"], bins).alias("i"),
        bin_index(F.col(y), s["y0"], s["y1"], bins).alias("j"),
    ).groupBy("i", "j").agg(_n().alias("w"))
    dx, dy = (s["x1"] - s["x0"]) / bins, (s["y1"] - s["y0"]) / bins
    centre = binned.select(
        (F.lit(s["x0"]) + (F.col("i") + 0.5) * dx).alias("px"),
        (F.lit(s["y0"]) + (F.col("j") + 0.5) * dy).alias("py"), "w",
    )
    xs = s["x0"] + np.arange(points) * ((s["x1"] - s["x0"]) / (points - 1))
    ys = s["y0"] + np.arange(points) * ((s["y1"] - s["y0"]) / (points - 1))
    scale = 1.0 / (2 * np.pi * det ** 0.5 * s["n"])

    def add_up(batches):
        grid = np.zeros((points, points))
        for batch in batches:
            px, py, w = (np.asarray(batch.column(n), dtype=float) for n in ("px", "py", "w"))
            for k in range(len(px)):
                u, v = xs[:, None] - px[k], ys[None, :] - py[k]
                grid += w[k] * np.exp(-0.5 * (c * u * u - 2 * b * u * v + a * v * v) / det)
        if grid.any():
            i, j = np.indices(grid.shape)
            yield pa.RecordBatch.from_arrays(
                [pa.array(xs[i.ravel()]), pa.array(ys[j.ravel()]), pa.array(grid.ravel() * scale)],
                names=["x", "y", "density"])

    return centre.mapInArrow(add_up, "x double, y double, density double").groupBy("x", "y").agg(
        F.sum("density").alias("density"))


def land_share(df: DataFrame, limits) -> DataFrame:
    """Share of rows in % at or above each layer's limit, and with 0, 1, >1 hits."""
    hits = {n: F.when(F.col(n) >= limit, 1).otherwise(0) for n, limit in limits.items()}
    total = F.lit(0)
    for h in hits.values():
        total = total + h
    share = lambda cond, name: F.round(F.avg(cond.cast("double")) * 100, 2).alias(name)
    return df.withColumn("_hits", total).agg(
        *[share(hits[n] == 1, n) for n in limits],
        share(F.col("_hits") == 0, "none"), share(F.col("_hits") == 1, "single"),
        share(F.col("_hits") > 1, "multiple"),
    )


def best_run(runs: DataFrame, by="val_loss") -> DataFrame:
    return runs.orderBy(by).limit(1)


def rolling_mean(df: DataFrame, value, order="date", keys=("cell",), size=3, into="rolling"):
    """Mean of the last ``size`` rows (fewer at the start).

    The table has one row per cell and step, so a partition is as long as the
    calendar, whatever the number of raw records.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - size, 0)
    return df.withColumn(into, F.avg(value).over(w))


def consecutive_runs(df: DataFrame, hot: Column, window=5, date="date", keys=("cell",)):
    """Days inside runs of at least ``window`` consecutive days with ``hot`` true.

    One row per (cell, day); a run has a constant difference between the day and
    its number among the hot days of the cell.
    """
    days = df.where(hot)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    anchored = days.withColumn("_run", F.date_sub(F.col(date), number))
    runs = anchored.groupBy(*keys, "_run").agg(_n().alias("days"))
    return runs.where(F.col("days") >= window).groupBy(*keys).agg(
        F.sum("days").alias("run_days"), _n().alias("n_runs"))
