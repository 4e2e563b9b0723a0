"""Layer scaling and category codes."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.ranks import join_back, ordered_rank


def minmax_scale(df: DataFrame, columns) -> DataFrame:
    """(x - min) / (max - min); missing stays missing, a constant layer is 0."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                     for n, f in (("lo", F.min), ("hi", F.max))])
    return _rescale(df, stats, columns, "lo", lambda c: F.col(f"_s.hi_{c}") - F.col(f"_s.lo_{c}"))


def standard_scale(df: DataFrame, columns) -> DataFrame:
    """(x - mean) / population standard deviation; a constant layer is 0."""
    stats = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns
                     for n, f in (("mid", F.avg), ("sd", F.stddev_pop))])
    return _rescale(df, stats, columns, "mid", lambda c: F.col(f"_s.sd_{c}"))


def _rescale(df, stats, columns, base, span):
    one = stats.select(F.struct(*stats.columns)).scalar()
    work = df.withColumn("_s", one)
    def scaled(c):
        width = span(c)
        value = (F.col(c) - F.col(f"_s.{base}_{c}")) / width
        return F.when(F.col(c).isNotNull(), F.when(width == 0, 0.0).otherwise(value))
    return work.withColumns({c: scaled(c) for c in columns}).drop("_s")


def minmax_scale_long(df: DataFrame, value="value", keys=("name",)) -> DataFrame:
    """The same per layer of a long table."""
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    scaled = F.when(width == 0, 0.0).otherwise((F.col(value) - F.col("_lo")) / width)
    return join_back(df, stats, keys).withColumn(
        value, F.when(F.col(value).isNotNull(), scaled)
    ).drop("_lo", "_hi")


def target_scale(df: DataFrame, value, into="scaled") -> DataFrame:
    """y / (max + 1e-5)."""
    top = df.agg(F.max(value)).scalar()
    return df.withColumn(into, F.col(value) / (top + F.lit(1e-5)))


def code_sorted(df: DataFrame, column, into="code", start=1) -> DataFrame:
    """Distinct values in sorted order to start..k; missing values stay missing."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct()
    codes = ordered_rank(values, [F.col(column)], "_code", start)
    return df.join(codes, column, "left").withColumn(into, F.col("_code").cast("int")).drop("_code")


def label_encode(df: DataFrame, column, into="code") -> DataFrame:
    """Sorted distinct values to 0..k-1."""
    return code_sorted(df, column, into, start=0)


def code_first_seen(df: DataFrame, column, order, into="code") -> DataFrame:
    """Distinct values to 1..k in order of their first appearance."""
    values = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("_first"))
    codes = ordered_rank(values, [F.col("_first"), F.col(column)], "_code").drop("_first")
    return df.join(codes, column, "left").withColumn(into, F.col("_code").cast("int")).drop("_code")


def _yeo_johnson(x, lam):
    """The transform for a column ``x`` and an exponent column ``lam``."""
    up = F.when(lam == 0, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    down = F.when(lam == 2, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - lam) - 1) / (2 - lam))
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson(df: DataFrame, column, into="transformed", tolerance=1e-4, points=17) -> DataFrame:
    """Yeo-Johnson power transform with the exponent of the highest likelihood.

    One aggregation gives the likelihoods of ``points`` exponents.  The bracket moves
    on, and doubles, while the best exponent lies on its edge, then shrinks to the
    neighbours of the best until it is narrower than ``tolerance``.  Without two
    different values the likelihood has no maximum and both columns are NULL.
    """
    x = F.col(column).cast("double")
    term = F.when(x >= 0, F.log1p(x)).otherwise(-F.log1p(-x))
    known = df.where(x.isNotNull())
    if known.select(F.min(x) == F.max(x)).first()[0] in (None, True):
        none = F.lit(None).cast("double")
        return df.withColumns({into: none, "lambda": none})

    def scores(exponents):
        row = known.agg(
            F.count(F.lit(1)).alias("n"), F.sum(term).alias("t"),
            *[F.var_pop(_yeo_johnson(x, F.lit(v))).alias(f"v{i}") for i, v in enumerate(exponents)],
        ).first()
        return [(-row["n"] / 2 * math.log(row[f"v{i}"]) + (v - 1) * row["t"]
                 if row[f"v{i}"] and math.isfinite(row[f"v{i}"]) else -math.inf)
                for i, v in enumerate(exponents)]

    low, high = -2.0, 2.0
    while True:
        step = (high - low) / (points - 1)
        exponents = [low + step * i for i in range(points)]
        found = scores(exponents)
        best = max(range(points), key=lambda i: (found[i], -i))
        if best in (0, points - 1) and step > tolerance and math.isfinite(found[best]):
            width = high - low
            low, high = (low - 2 * width, low + step) if best == 0 else (high - step, high + 2 * width)
            continue
        if step <= tolerance:
            break
        low, high = exponents[max(0, best - 1)], exponents[min(points - 1, best + 1)]
    chosen = F.lit(float(exponents[best]))
    return df.withColumns({into: _yeo_johnson(x, chosen), "lambda": chosen})
