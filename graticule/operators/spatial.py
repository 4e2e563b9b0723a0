"""Spatial autocorrelation and natural breaks."""

import hashlib
import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.operators.ranks import _between, hash_rank, hash_take


# Links of cells that one task sorts and adds up.
LINKS = 1_000_000


@F.pandas_udf(T.DoubleType())
def two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: math.erfc(abs(v) / math.sqrt(2)))


def _lagged(values, weights, x):
    """(cell, z, lag): deviation of each cell and the weighted one of its neighbours."""
    mean = values.agg(F.avg(x)).scalar()
    z = values.select("cell", (F.col(x) - mean).alias("z"))
    # adaptive execution sizes tasks by compressed bytes, and links compress well
    tasks = math.ceil(weights.count() / LINKS)
    dealt = lambda df, by: df.repartition(tasks, by) if tasks > 1 else df
    near = dealt(weights.select("cell", "nbr", "w"), "nbr").join(
        z.withColumnRenamed("cell", "nbr").withColumnRenamed("z", "zn"), "nbr")
    lag = dealt(near.select("cell", "w", "zn"), "cell").groupBy("cell").agg(
        F.sum(F.col("w") * F.col("zn")).alias("lag"))
    return z.join(lag, "cell", "left").withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def _pair_sums(weights):
    """(s0, s1): sums of w and of w * (w + wb), wb being the weight the other way.

    Both ways of a pair meet in one group, so the weights are shuffled once and not once
    for each side of a join.  Repeated weights meet each other as they would in that join.
    """
    ahead = F.col("cell") < F.col("nbr")
    lower = F.when(ahead, F.col("cell")).otherwise(F.col("nbr"))
    upper = F.when(ahead, F.col("nbr")).otherwise(F.col("cell"))
    side = lambda on, e: F.coalesce(F.sum(F.when(on, e)), F.lit(0.0))
    w, one = F.col("w").cast("double"), F.lit(1.0)
    behind = ~F.coalesce(ahead, F.lit(False))
    met = weights.groupBy(lower.alias("lo"), upper.alias("hi")).agg(
        *[f(on, e).alias(f"{n}{i}") for i, on in enumerate((ahead, behind))
          for n, f, e in (("n", side, one), ("w", side, w), ("q", side, w * w))])
    own, known = F.col("lo") == F.col("hi"), F.col("lo").isNotNull() & F.col("hi").isNotNull()
    other = lambda n, i: F.when(own, F.col(f"{n}1")).when(known, F.col(f"{n}{1 - i}")).otherwise(0.0)
    times = lambda i: F.greatest(other("n", i), F.lit(1.0))
    return met.agg(
        F.sum(sum(F.col(f"w{i}") * times(i) for i in (0, 1))).alias("s0"),
        # (w + wb)^2 / 2 over both directions of each pair
        F.sum(sum(F.col(f"q{i}") * times(i) + F.col(f"w{i}") * other("w", i) for i in (0, 1))).alias("s1"))


def morans_i(values: DataFrame, weights: DataFrame, x="x") -> DataFrame:
    """Global Moran's I with its expectation, z and two-sided p under normality.

    ``weights`` (cell, nbr, w) are row-standardised.
    """
    both = _lagged(values, weights, x).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col("z") * F.col("lag")).alias("zl"),
        F.sum(F.col("z") * F.col("z")).alias("zz"))
    pair = _pair_sums(weights)
    ends = weights.select("cell", "w").unionAll(weights.select(F.col("nbr").alias("cell"), "w"))
    s2 = ends.groupBy("cell").agg(F.sum("w").alias("t")).agg(
        F.sum(F.col("t") * F.col("t")).alias("s2"))
    one = both.select(
        "*", pair.select("s0").scalar().alias("s0"), pair.select("s1").scalar().alias("s1"),
        s2.scalar().alias("s2"))
    n, s0 = F.col("n"), F.col("s0")
    # without variation, neighbours or a second cell the statistics are NULL
    expected = F.try_divide(F.lit(-1.0), n - 1)
    variance = F.try_divide(
        n * n * F.col("s1") - n * F.col("s2") + 3 * s0 * s0, s0 * s0 * (n * n - 1)
    ) - expected * expected
    index = F.try_divide(F.try_divide(n, s0) * F.col("zl"), F.col("zz"))
    out = one.select(index.alias("morans_i"), expected.alias("expected"),
                     F.try_divide(index - expected, F.sqrt(variance)).alias("z_norm"))
    return out.withColumn("p_norm", two_sided_p("z_norm"))


def _draws(size, permutations, k, seed):
    """Places in the pool: k neighbours and one spare per permutation.

    The places of a permutation are the first different ones among the hashes of
    ``seed:permutation:attempt`` modulo the pool's size, whatever that size; only a
    pool with fewer places than that repeats them.
    """
    out = np.empty((permutations, k + 1), dtype=int)
    for p in range(permutations):
        places, attempt = {}, 0
        while len(places) < min(k + 1, size):
            digest = hashlib.md5(f"{seed}:{p}:{attempt}".encode()).hexdigest()
            places.setdefault(int(digest[:8], 16) % size)
            attempt += 1
        out[p] = list(itertools.islice(itertools.cycle(places), k + 1))
    return out


def local_morans_i(values: DataFrame, weights: DataFrame, x="x", k=8, permutations=999,
                   seed=42, level=0.05) -> DataFrame:
    """Local Moran's I per cell with a permutation p-value, flags and quadrant.

    As in the usual conditional permutation, one set of random neighbours per
    permutation serves all cells: a cell's simulated value is its deviation times
    the mean deviation of k random cells.  These means are at most
    ``permutations`` numbers; each cell counts by binary search how many are at
    least as extreme.  The few cells that are themselves among the random ones
    have that draw replaced by the permutation's spare cell.
    """
    stats = values.agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")).first()
    n, mean = stats["n"], stats["m"]
    if not stats["v"]:  # nothing varies: no statistic is defined
        none = lambda kind: F.lit(None).cast(kind)
        return values.select(
            "cell", none("double").alias("local_i"), none("double").alias("p_sim"),
            none("string").alias("quadrant"), none("int").alias("hotspot"),
            none("int").alias("coldspot"))
    zz = stats["v"] * n
    take = hash_take(values.select("cell", x), seed, "cell", min(n, permutations * (k + 1)))
    pool = hash_rank(take, seed, "cell", into="_k").toPandas().sort_values("_k")
    z, ids = pool[x].to_numpy(float) - mean, pool["cell"].to_numpy()
    picks = _draws(len(pool), permutations, k, seed)
    # equal means must compare equal however they were added up
    means = z[picks[:, :k]].mean(axis=1).round(12)
    members = picks[:, :k].ravel()
    swap = pd.DataFrame({
        "cell": ids[members], "old": np.repeat(means, k),
        "new": (np.repeat(means, k) + (np.repeat(z[picks[:, k]], k) - z[members]) / k).round(12)})
    changes = values.sparkSession.createDataFrame(
        swap.astype({"cell": "int64"}), "cell bigint, old double, new double"
    ).groupBy("cell").agg(F.collect_list(F.struct("old", "new")).alias("_swap"))
    work = _lagged(values, weights, x).join(changes, "cell", "left")
    bounds = sorted(float(v) for v in means)
    # simulated value at least the observed: for z < 0 the mean is at most the lag
    sign = F.when(F.col("z") > 0, 1).when(F.col("z") < 0, -1).otherwise(0)
    lag = F.round("lag", 12)
    at_most = _between(lag, bounds)
    at_least = F.lit(permutations) - at_most_below(lag, bounds)
    larger = F.when(sign > 0, at_least).when(sign < 0, at_most).otherwise(permutations)
    reaches = lambda v: F.when(sign > 0, v >= lag).when(sign < 0, v <= lag).otherwise(True).cast("int")
    fix = F.aggregate(
        F.coalesce("_swap", F.array().cast("array<struct<old:double,new:double>>")), F.lit(0),
        lambda s, c: s + reaches(c["new"]) - reaches(c["old"]))
    count = (larger + fix).cast("int")
    extreme = F.least(F.col("_larger"), F.lit(permutations) - F.col("_larger"))
    out = work.select("cell", "z", "lag", count.alias("_larger")).select(
        "cell", (F.lit(float(n - 1) / zz) * F.col("z") * F.col("lag")).alias("local_i"),
        ((extreme + 1) / F.lit(permutations + 1.0)).alias("p_sim"),
        F.when((F.col("z") > 0) & (lag > 0), "HH").when((F.col("z") <= 0) & (lag > 0), "LH")
        .when((F.col("z") <= 0) & (lag <= 0), "LL").otherwise("HL").alias("quadrant"))
    strong = F.col("p_sim") < level
    return out.withColumns({
        "hotspot": (strong & (F.col("local_i") > 0)).cast("int"),
        # the flag follows the sign of I, so it marks outliers; see the quadrant
        "coldspot": (strong & (F.col("local_i") < 0)).cast("int")})


def at_most_below(value, bounds):
    """Number of bounds strictly below the value."""
    return F.lit(len(bounds)) - _between(-value, [-b for b in reversed(bounds)])


# --- natural breaks -----------------------------------------------------------------

def jenks_breaks(df: DataFrame, value, classes=5, bins=2048) -> DataFrame:
    """Natural breaks of all values: one row with ``classes + 1`` break values.

    The partition has the least squared deviation that there is, for any number of
    distinct values.  Up to ``bins`` of them are partitioned as they are.  More are put
    into that many groups of neighbouring values, of which the driver sees count, sums
    and range.  The best partition at the groups' ends is one that exists; a lower bound
    of all partitions with a break inside a group shows which groups cannot hold one
    (``_narrow``).  The others are cut into about ``bins`` finer ones together, until none
    of them holds different values.  Usually that takes three or four passes.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    spark = df.sparkSession
    schema = "n_classes int, breaks array<double>"
    few = known.distinct().limit(bins + 1).toPandas()["v"].tolist()
    if not few:
        return spark.createDataFrame([], schema)
    if len(few) <= bins:
        table = _group_sums(known, few, 0.0)
        table["open"] = False
    else:
        at = [i / bins for i in range(1, bins)]
        row = known.agg(F.percentile_approx("v", at, 20 * bins).alias("p"), F.avg("v").alias("m")).first()
        centre = row["m"]  # sums around the mean lose fewer digits
        table = _group_sums(known, row["p"], centre)
        table["open"] = table["low"] < table["top"]
    while table["open"].any():
        table = _narrow(table, classes, centre)
        number = table.index[table["open"]].tolist()
        if not number:
            break
        # values of closed groups are not read into the finer sums again
        inside = known.withColumn("b", _between(F.col("v"), table["low"].tolist()[1:])).where(
            F.col("b").isin(number))
        pieces = max(2, bins // len(number))
        cuts = inside.groupBy("b").agg(F.percentile_approx(
            "v", [i / pieces for i in range(1, pieces)], 20 * pieces).alias("p")).collect()
        # the largest value of a group becomes one of its own, so every pass goes on
        starts = {*table["low"][number], *table["top"][number], *(v for r in cuts for v in r["p"])}
        finer = _group_sums(inside, starts, centre)
        finer["open"] = finer["low"] < finer["top"]
        table = pd.concat([table.drop(number), finer]).sort_values("low", ignore_index=True)
    breaks, _ = _best_partition(table, classes)
    return spark.createDataFrame([(classes, [float(table["low"][0])] + breaks)], schema)


def _group_sums(known, starts, centre):
    """Count, sums around ``centre`` and range of the values from each start to the next."""
    x = F.col("v") - F.lit(float(centre))
    return known.groupBy(_between(F.col("v"), sorted(set(starts))).alias("_g")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"),
        F.min("v").alias("low"), F.max("v").alias("top"),
    ).drop("_g").toPandas().sort_values("low", ignore_index=True)


def _narrow(table, classes, centre):
    """The groups, those that provably hold no break closed and merged where possible.

    A break inside a group splits its values between the classes on both sides.  A class
    pays for such a value at least its squared distance from the group's nearer end, and
    the least sum of these is concave in the numbers on each side, so it is smallest when
    the whole group is on one side (or in a class of its own, which is free).  Each open
    group therefore gives two places for a break: one after its values, which then weigh
    on the class to the left at the group's lower end, and one before them, where they
    weigh on the class to the right at the upper end.  The best partition through a place
    bounds all those with a break there; places above the best one known are given up.
    """
    n, s, q, low, top = (table[c].to_numpy(float) for c in ("n", "s", "q", "low", "top"))
    opened, m = table["open"].to_numpy(bool), len(table)
    sums = [np.concatenate([[0.0], a.cumsum()]) for a in (n, s, q)]
    # places in order: (first whole group after, first group not whole before,
    # open group that weighs on the right, on the left), -1 for none
    places = [(0, 0, -1, -1)]
    for g in range(m):
        if opened[g]:
            places += [(g + 1, g, g, -1), (g + 1, g, -1, g)]
        places.append((g + 1, g + 1, -1, -1))
    after, before, right, left = np.array(places).T

    def weights(groups, ends):
        x, w = ends - centre, np.where(groups < 0, 0.0, n[groups])
        return w, w * x[groups], w * x[groups] ** 2

    begin = [w - a[after] for w, a in zip(weights(right, top), sums)]
    end = [w + a[before] for w, a in zip(weights(left, low), sums)]

    def cost(i, j):
        count, total, square = (b[i] + e[j] for b, e in zip(begin, end))
        # a class inside one group is free
        some = (count > 0) & ((right[i] < 0) | (right[i] != left[j]))
        with np.errstate(all="ignore"):
            return np.where(some, np.maximum(square - total * total / count, 0.0), 0.0)

    p = len(places)
    # least cost of at most c classes from the first place, and to the last one
    upto, onward = np.full((classes + 1, p), np.inf), np.full((classes + 1, p), np.inf)
    upto[:, 0] = onward[:, p - 1] = 0.0
    for j in range(1, p):
        i = np.arange(j)
        upto[1:, j] = np.minimum.accumulate((upto[:-1, :j] + cost(i, j)).min(axis=1))
    for i in range(p - 2, -1, -1):
        j = np.arange(i + 1, p)
        onward[1:, i] = np.minimum.accumulate((onward[:-1, i + 1:] + cost(i, j)).min(axis=1))
    bound = (upto + onward[::-1]).min(axis=0)
    _, best = _best_partition(table, classes)
    # rounding must not give up a place
    keep = bound <= best + 1e-12 * (q.sum() - s.sum() ** 2 / n.sum())
    kept = np.zeros(m, bool)
    for at in (right, left):
        kept[at[(at >= 0) & keep]] = True
    opened &= kept
    fixed = keep[(right < 0) & (left < 0)][:-1]  # the place before each group
    fixed[0] = True
    fixed |= opened
    fixed[1:] |= opened[:-1]
    return table.assign(open=opened).groupby(fixed.cumsum()).agg(
        {"n": "sum", "s": "sum", "q": "sum", "low": "min", "top": "max", "open": "max"}
    ).reset_index(drop=True)


def _best_partition(table, classes):
    """Upper ends of the classes with the least squared deviation, and that deviation."""
    n, s, q = (np.concatenate([[0.0], table[c].to_numpy(float).cumsum()]) for c in "nsq")
    top, m = table["top"].to_numpy(float), len(table)
    classes = min(classes, m)
    cost = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i])
    best = np.full(m + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(classes):
        new, cut = np.full(m + 1, np.inf), np.zeros(m + 1, int)
        for j in range(1, m + 1):
            i = np.arange(j)
            total = best[:j] + cost(i, j)
            cut[j] = total.argmin()
            new[j] = total[cut[j]]
        best = new
        cuts.append(cut)
    ends, j = [], m
    for cut in reversed(cuts):
        ends.append(top[j - 1])
        j = cut[j]
    return [float(e) for e in reversed(ends)], float(best[m])
