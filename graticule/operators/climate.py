"""Climate indices over daily series.

Series tables have one row per (cell, day); ``one_per_day`` makes them so with a
map-side combined aggregation.  After it a cell is as long as the calendar
whatever the number of raw records, which bounds every per-cell window below.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graticule.functions.scalar import wind_cardinal, wind_direction, wind_speed
from graticule.functions.special import gamma_cdf, normal_quantile


def _n():
    return F.count(F.lit(1))


def one_per_day(df: DataFrame, how, time="ts", cell="cell") -> DataFrame:
    """Reduce records to one row per cell and day; ``how``: name -> aggregate."""
    return df.groupBy(cell, F.col(time).cast("date").alias("date")).agg(
        *[agg.alias(name) for name, agg in how.items()])


def daily_wind(hourly: DataFrame, u="u", v="v", calm=0.3) -> DataFrame:
    """Per cell and day: largest speed, speed at noon, direction at the largest.

    A missing speed counts as 0 when the hour of the largest is looked up; the
    first such hour is taken.
    """
    df = hourly.withColumns({"_s": wind_speed(u, v), "_d": wind_direction(u, v, calm)})
    rank = F.struct(F.coalesce("_s", F.lit(0.0)).alias("s"), (-F.col("hour")).alias("h"))
    return df.groupBy("cell", "date").agg(
        F.max("_s").alias("max_speed"),
        F.max(F.when(F.col("hour") == 12, F.col("_s"))).alias("noon_speed"),
        F.max_by("_d", rank).alias("direction"))


def windy_days(daily: DataFrame, wind="wind", limit=10.8) -> DataFrame:
    """Days with a largest wind of at least ``limit`` m/s."""
    return daily.groupBy("cell").agg(F.count_if(F.col(wind) >= limit).alias("windy_days"))


def heatwave_index(daily: DataFrame, t="t", limit=25.0, quantile=0.95, window=5) -> DataFrame:
    """Days in heat waves, per cell.

    A hot day reaches the cell's own quantile and exceeds ``limit``; a wave is a
    run of at least ``window`` hot days.  Runs end with the year.
    """
    cells = Window.partitionBy("cell")
    level = F.percentile(t, F.lit(quantile)).over(cells)
    hot = daily.withColumn("_level", level).where(
        (F.col(t) >= F.col("_level")) & (F.col(t) > limit))
    year = F.year("date")
    number = F.row_number().over(Window.partitionBy("cell").orderBy("date"))
    runs = hot.select("cell", year.alias("_y"), F.date_sub("date", number).alias("_run")).groupBy(
        "cell", "_y", "_run").agg(_n().alias("_days"))
    waves = runs.groupBy("cell").agg(
        F.sum(F.when(F.col("_days") >= window, F.col("_days")).otherwise(0)).alias("_w"))
    return daily.select("cell").distinct().join(waves, "cell", "left").select(
        "cell", F.coalesce("_w", F.lit(0)).cast("long").alias("heatwave_days"))


def month_of(date="date"):
    return F.trunc(date, "month").alias("month")


def water_balance(daily: DataFrame, prec="tp", pet="pev", scale=1000.0) -> DataFrame:
    """Monthly precipitation minus potential evaporation."""
    return daily.groupBy("cell", month_of()).agg(
        ((F.sum(prec) - F.sum(pet)) * scale).alias("wb"))


@F.pandas_udf(T.DoubleType())
def _standard_index(x: pd.Series, zero: pd.Series, shape: pd.Series, scale: pd.Series) -> pd.Series:
    p = gamma_cdf(x.to_numpy() / scale.to_numpy(), shape.to_numpy())
    p = zero.to_numpy() + (1 - zero.to_numpy()) * p
    return pd.Series(np.clip(normal_quantile(p), -8.21, 8.21))


def spei(balance: DataFrame, value="wb", offset=1.0) -> DataFrame:
    """Monthly balance as a standard normal index per cell and calendar month.

    A gamma distribution is fitted to the positive values of ``value + offset``
    by Thom's approximation, from sums alone; values not above 0 take the
    probability of such values.
    """
    x = F.col(value) + F.lit(offset)
    work = balance.withColumns({"_x": x, "_m": F.month("month")})
    positive = F.col("_x") > 0
    pos = F.when(positive, F.col("_x"))
    fit = work.groupBy("cell", "_m").agg(
        F.avg(pos).alias("_mean"), F.avg(F.log(pos)).alias("_logs"),
        F.avg(F.when(positive, 0.0).otherwise(1.0)).alias("_zero"))
    a = F.log("_mean") - F.col("_logs")
    shape = F.when(a > 0, (1 + F.sqrt(1 + 4 * a / 3)) / (4 * a))
    fit = fit.withColumn("_shape", shape).withColumn("_scale", F.col("_mean") / F.col("_shape"))
    return work.join(fit, ["cell", "_m"]).withColumn(
        "spei", _standard_index("_x", "_zero", "_shape", "_scale")
    ).select("cell", "month", value, F.nanvl("spei", F.lit(None).cast("double")).alias("spei"))


def drought_index(index: DataFrame, limit=-2.0, months=3) -> DataFrame:
    """Months whose ``months``-month mean of the index lies below ``limit``.

    The mean is over the calendar months of the window that are present.
    """
    number = F.year("month") * 12 + F.month("month")
    w = Window.partitionBy("cell").orderBy(number).rangeBetween(1 - months, 0)
    return index.withColumn("_mean", F.avg("spei").over(w)).groupBy("cell").agg(
        F.count_if(F.col("_mean") < limit).alias("drought_months"))


def yearly_sum_mean(daily: DataFrame, value, into, divide=1.0) -> DataFrame:
    """Mean over the years of the yearly sums, divided by ``divide``."""
    sums = daily.groupBy("cell", F.year("date").alias("_y")).agg(F.sum(value).alias("_s"))
    return sums.groupBy("cell").agg((F.avg("_s") / divide).alias(into))


def mean_yearly_temp(daily: DataFrame, kelvin="t2m") -> DataFrame:
    """Yearly sums of Celsius over 365 (leap years too), averaged."""
    celsius = daily.withColumn("_c", F.col(kelvin) - 273.15)
    return yearly_sum_mean(celsius, "_c", "mean_yearly_temperature", 365.0)


def mean_yearly_wind(daily: DataFrame, wind="wind") -> DataFrame:
    return yearly_sum_mean(daily, wind, "mean_wind_speed", 365.0)


def mean_yearly_prec(daily: DataFrame, prec="tp") -> DataFrame:
    return yearly_sum_mean(daily, prec, "mean_yearly_precipitation")


def modal_direction(daily: DataFrame, direction="direction") -> DataFrame:
    """Most frequent wind class; 0 degrees is missing (class 8); ties: the smallest."""
    code = wind_cardinal(F.nullif(F.col(direction), F.lit(0.0)))
    counts = daily.groupBy("cell", code.alias("_k")).agg(_n().alias("_n"))
    return counts.groupBy("cell").agg(
        F.max_by("_k", F.struct("_n", -F.col("_k"))).alias("mode_direction"))


# --- fire weather ---------------------------------------------------------------
# Fixed values of the published Canadian system: effective day lengths by
# latitude band (from south to north: below -30, to -15, to 15, to 30, above)
# and month, drought code day length factors (below -15, to 15, above), and the
# codes at the start of a season.
DAY_LENGTHS = [
    [11.5, 10.5, 9.2, 7.9, 6.8, 6.2, 6.5, 7.4, 8.7, 10.0, 11.2, 11.8],
    [10.1, 9.6, 9.1, 8.5, 8.1, 7.8, 7.9, 8.3, 8.9, 9.4, 9.9, 10.2],
    [9.0] * 12,
    [7.9, 8.4, 8.9, 9.5, 9.9, 10.2, 10.1, 9.7, 9.1, 8.6, 8.1, 7.8],
    [6.5, 7.5, 9.0, 12.8, 13.9, 13.9, 12.4, 10.9, 9.4, 8.0, 7.0, 6.0],
]
DAY_FACTORS = [
    [6.4, 5.0, 2.4, 0.4, -1.6, -1.6, -1.6, -1.6, -1.6, 0.9, 3.8, 5.8],
    [1.39] * 12,
    [-1.6, -1.6, -1.6, 0.9, 3.8, 5.8, 6.4, 5.0, 2.4, 0.4, -1.6, -1.6],
]
START = (85.0, 6.0, 15.0)

FIRE_COLUMNS = ["ffmc", "dmc", "dc", "isi", "bui", "fwi"]


def _ffmc(t, h, w, rain, before):
    m = 147.2 * (101 - before) / (59.5 + before)
    rf = np.maximum(rain - 0.5, 1e-12)
    wet = m + 42.5 * rf * np.exp(-100 / (251 - m)) * (1 - np.exp(-6.93 / rf))
    wet = wet + np.where(m > 150, 0.0015 * (m - 150) ** 2 * np.sqrt(rf), 0.0)
    m = np.where(rain > 0.5, np.minimum(wet, 250.0), m)
    warm = 0.18 * (21.1 - t) * (1 - np.exp(-0.115 * h))
    dry = 0.942 * h ** 0.679 + 11 * np.exp((h - 100) / 10) + warm
    moist = 0.618 * h ** 0.753 + 10 * np.exp((h - 100) / 10) + warm
    speed = lambda x: (0.424 * (1 - x ** 1.7) + 0.0694 * np.sqrt(w) * (1 - x ** 8)) * (
        0.581 * np.exp(0.0365 * t))
    drying = dry + (m - dry) * 10.0 ** -speed(h / 100)
    wetting = moist - (moist - m) * 10.0 ** -speed((100 - h) / 100)
    m = np.where(m > dry, drying, np.where(m < np.minimum(moist, dry), wetting, m))
    return np.clip(59.5 * (250 - m) / (147.2 + m), 0.0, 101.0)


def _dmc(t, h, rain, length, before):
    re = 0.92 * rain - 1.27
    m = 20 + 280 / np.exp(0.023 * before)
    logs = np.log(np.maximum(before, 1e-12))
    b = np.where(before <= 33, 100 / (0.5 + 0.3 * before),
                 np.where(before <= 65, 14 - 1.3 * logs, 6.2 * logs - 17.2))
    wet = m + 1000 * re / (48.77 + b * re)
    rained = np.maximum(43.43 * (5.6348 - np.log(np.maximum(wet - 20, 1e-12))), 0.0)
    p = np.where(rain > 1.5, rained, before)
    return p + 1.894 * (np.maximum(t, -1.1) + 1.1) * (100 - h) * length * 1e-4


def _dc(t, rain, factor, before):
    rd = 0.83 * rain - 1.27
    q = 800 * np.exp(-before / 400) + 3.937 * rd
    d = np.where(rain > 2.8, np.maximum(400 * np.log(800 / np.maximum(q, 1e-12)), 0.0), before)
    return d + 0.5 * np.maximum(0.36 * (np.maximum(t, -2.8) + 2.8) + factor, 0.0)


def _behaviour(ffmc, dmc, dc, w):
    m = 147.2 * (101 - ffmc) / (59.5 + ffmc)
    isi = 0.208 * np.exp(0.05039 * w) * 91.9 * np.exp(-0.1386 * m) * (1 + m ** 5.31 / 4.93e7)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = dmc + 0.4 * dc
        small = 0.8 * dmc * dc / share
        large = dmc - (1 - 0.8 * dc / share) * (0.92 + (0.0114 * dmc) ** 1.7)
        bui = np.where(share == 0, 0.0, np.where(dmc <= 0.4 * dc, small, np.maximum(large, 0.0)))
        fd = np.where(bui <= 80, 0.626 * bui ** 0.809 + 2,
                      1000 / (25 + 108.64 * np.exp(-0.023 * bui)))
        b = 0.1 * isi * fd
        fwi = np.where(b > 1, np.exp(2.72 * (0.434 * np.log(np.maximum(b, 1.0))) ** 0.647), b)
    return isi, bui, fwi


def fire_weather(daily: DataFrame, t="t", h="h", w="w", rain="rain", lat="lat",
                 start=START, block=64) -> DataFrame:
    """Canadian fire weather codes per cell and day, noon values in C, %, km/h, mm.

    The codes carry over from day to day, so each cell is walked through in
    order; blocks of ``block`` cells are walked together as one vector.  On a day
    with a missing input the codes stay and the indices are NULL.
    """
    schema = "cell bigint, date date, " + ", ".join(f"{c} double" for c in FIRE_COLUMNS)
    work = daily.select(
        F.col("cell").cast("long"), "date", F.month("date").alias("_month"),
        *[F.col(n).cast("double").alias(a) for n, a in
          ((t, "_t"), (h, "_h"), (w, "_w"), (rain, "_rain"), (lat, "_lat"))],
        F.floor(F.col("cell") / block).alias("_block"))

    def run(table):
        df = table.to_pandas().sort_values(["date", "cell"], kind="stable")
        cells, at = np.unique(df["cell"].to_numpy(), return_inverse=True)
        codes = np.tile(np.array(start, float)[:, None], (1, len(cells)))
        out = np.full((len(df), 6), np.nan)
        values = df[["_t", "_h", "_w", "_rain", "_lat"]].to_numpy(float)
        months = df["_month"].to_numpy() - 1
        days = df["date"].to_numpy()
        cuts = np.flatnonzero(days[1:] != days[:-1]) + 1
        for rows in np.split(np.arange(len(df)), cuts):
            tt, hh, ww, rr, ll = values[rows].T
            hh = np.clip(hh, 0.0, 100.0)
            month, who = months[rows[0]], at[rows]
            length = np.array([m[month] for m in DAY_LENGTHS])[np.searchsorted([-30, -15, 15, 30], ll)]
            factor = np.array([m[month] for m in DAY_FACTORS])[np.searchsorted([-15, 15], ll)]
            ok = ~np.isnan(values[rows]).any(axis=1)
            old = codes[:, who]
            new = np.stack([
                _ffmc(tt, hh, ww, rr, old[0]), _dmc(tt, hh, rr, length, old[1]),
                _dc(tt, rr, factor, old[2])])
            codes[:, who] = np.where(ok, new, old)
            result = np.stack([*codes[:, who], *_behaviour(*codes[:, who], ww)]).T
            out[rows] = np.where(ok[:, None], result, np.nan)
        columns = {"cell": df["cell"].to_numpy(), "date": pa.array(df["date"])}
        for i, name in enumerate(FIRE_COLUMNS):
            columns[name] = pa.array(out[:, i], mask=np.isnan(out[:, i]))
        return pa.table(columns)

    return work.groupBy("_block").applyInArrow(run, schema)


def fwi_exceedance(fire: DataFrame, fwi="fwi", humidity=None) -> DataFrame:
    """Days above 20, 30 and 40 added up, mean index, and mean humidity."""
    over = sum((F.count_if(F.col(fwi) > k) for k in (30, 40)), F.count_if(F.col(fwi) > 20))
    extra = [F.avg(humidity).alias("relative_humidity")] if humidity else []
    return fire.groupBy("cell").agg(
        over.alias("fire_weather_index"), F.avg(fwi).alias("fire_weather_mean"), *extra)
