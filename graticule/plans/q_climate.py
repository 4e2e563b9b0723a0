"""Queries: climate indices."""

from pyspark.sql import functions as F

from graticule.operators import climate as C
from graticule.plans import fixtures as X
from graticule.plans.catalog import query, view
from graticule.plans.q_cells import DIRECTION


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


view("daily", f"""
select cell, date, max(speed) as max_speed, max(case when hour = 12 then speed end) as noon_speed,
  arg_max(direction, {{'s': coalesce(speed, 0.0), 'h': -hour}}) as direction
from ({DIRECTION}) group by 1, 2""", ["obs_hourly"])


@query("daily_wind", """
select cell, date, round(max_speed, 6) as max_speed, round(noon_speed, 6) as noon_speed,
  round(direction, 6) as direction from daily""", ["daily"])
def daily_wind(spark, d):
    return rounded(C.daily_wind(X.obs_hourly(spark, d)), "max_speed", "noon_speed", "direction")


@query("windy_days", """
select cell, count(*) filter (max_speed >= 10.8) as windy_days from daily group by 1""", ["daily"])
def windy_days(spark, d):
    return C.windy_days(C.daily_wind(X.obs_hourly(spark, d)), "max_speed")


def heatwave_sql(quantile, window):
    return f"""(
with h as (select o.cell, o.date, row_number() over (partition by o.cell order by o.date) as k
  from obs o join (select cell, quantile_cont(t, {quantile}) as q from obs group by 1) p
  on o.cell = p.cell where o.t >= p.q and o.t > 25),
r as (select cell, year(date) as y, date - cast(k as integer) as run, count(*) as days
  from h group by 1, 2, 3),
w as (select cell, cast(sum(days) as bigint) as days from r where days >= {window} group by 1)
select c.cell, coalesce(w.days, 0) as heatwave_days from (select distinct cell from obs) c
left join w on c.cell = w.cell)"""


@query("heatwave_index", f"""
select a.cell, a.heatwave_days, b.heatwave_days as warm_days
from {heatwave_sql(0.95, 5)} a join {heatwave_sql(0.5, 3)} b on a.cell = b.cell""", ["obs"])
def heatwave_index(spark, d):
    # the published setting, and a lower one that 30 days of data can reach
    obs = X.obs(spark, d)
    low = C.heatwave_index(obs, "t", quantile=0.5, window=3)
    return C.heatwave_index(obs, "t").join(
        low.withColumnRenamed("heatwave_days", "warm_days"), "cell")


@query("water_balance", """
select cell, cast(date_trunc('month', date) as date) as month,
  round((sum(tp) - sum(pev)) * 1000, 4) as wb from obs_long group by 1, 2""", ["obs_long"])
def water_balance(spark, d):
    return rounded(C.water_balance(X.obs_long(spark, d)), "wb", digits=4)


@query("spei")
def spei(spark, d):
    return C.spei(C.water_balance(X.obs_long(spark, d)), offset=500.0)


@query("drought_index", """
with b as (select cell, date_trunc('month', date) as month, (sum(tp) - sum(pev)) * 1000 as wb
  from obs_long group by 1, 2),
z as (select cell, month, (wb - avg(wb) over m) / stddev_pop(wb) over m as spei from b
  window m as (partition by cell, month(month))),
r as (select cell, avg(spei) over (partition by cell order by month
  rows between 2 preceding and current row) as s from z)
select cell, count(*) filter (s < -2) as drought_months, count(*) filter (s < -0.8) as dry_months
from r group by 1""", ["obs_long"])
def drought_index(spark, d):
    # a plain standard score stands in for the fitted index, so that SQL can follow
    balance = C.water_balance(X.obs_long(spark, d)).withColumn("m", F.month("month"))
    moments = balance.groupBy("cell", "m").agg(
        F.avg("wb").alias("mean"), F.stddev_pop("wb").alias("sd"))
    index = balance.join(moments, ["cell", "m"]).withColumn(
        "spei", F.try_divide(F.col("wb") - F.col("mean"), F.col("sd")))
    dry = C.drought_index(index, limit=-0.8)
    return C.drought_index(index).join(dry.withColumnRenamed("drought_months", "dry_months"), "cell")


@query("drought_index_spei")
def drought_index_spei(spark, d):
    return C.drought_index(C.spei(C.water_balance(X.obs_long(spark, d)), offset=500.0))


def yearly_mean_sql(value, name, divide):
    return f"""
select cell, round(avg(s) / {divide}, 6) as {name} from (
  select cell, year(date) as y, sum({value}) as s from obs_long group by 1, 2) group by 1"""


@query("mean_yearly_temp", yearly_mean_sql("t2m - 273.15", "mean_yearly_temperature", 365),
       ["obs_long"])
def mean_yearly_temp(spark, d):
    return rounded(C.mean_yearly_temp(X.obs_long(spark, d)), "mean_yearly_temperature")


@query("mean_yearly_wind", yearly_mean_sql("wind", "mean_wind_speed", 365), ["obs_long"])
def mean_yearly_wind(spark, d):
    return rounded(C.mean_yearly_wind(X.obs_long(spark, d)), "mean_wind_speed")


@query("mean_yearly_prec", yearly_mean_sql("tp", "mean_yearly_precipitation", 1), ["obs_long"])
def mean_yearly_prec(spark, d):
    return rounded(C.mean_yearly_prec(X.obs_long(spark, d)), "mean_yearly_precipitation")


@query("modal_direction", """
with k as (select cell, case when direction = 0 or direction is null then 8
  when direction <= 22.5 or direction > 337.5 then 0 when direction <= 67.5 then 1
  when direction <= 112.5 then 2 when direction <= 157.5 then 3 when direction <= 202.5 then 4
  when direction <= 247.5 then 5 when direction <= 292.5 then 6 else 7 end as k from daily)
select cell, k as mode_direction from (select cell, k, row_number() over
  (partition by cell order by count(*) desc, k) as rn from k group by 1, 2) where rn = 1""",
       ["daily"])
def modal_direction(spark, d):
    return C.modal_direction(C.daily_wind(X.obs_hourly(spark, d)))


def fire_obs(spark, d):
    """Noon weather per cell and day, made from the event values."""
    return X.obs(spark, d).select(
        "cell", "date", (F.log1p("t") * 8 - 10).alias("t"), (30 + F.col("mx") % 65).alias("h"),
        (F.col("mx") % 31).alias("w"),
        F.when(F.col("n") > 1, F.col("mx") % 9).otherwise(0.0).alias("rain"),
        (F.col("cell") % 120 - 60.0).alias("lat"))


view("fire_obs", """
select cell, date, ln(1 + t) * 8 - 10 as t, 30 + mx % 65 as h, mx % 31 as w,
  case when n > 1 then mx % 9 else 0.0 end as rain, cell % 120 - 60.0 as lat,
  row_number() over (partition by cell order by date) as k
from obs""", ["obs"])


def table_sql(rows, limits, month="month(date)"):
    whens = []
    for i, row in enumerate(rows):
        values = "[" + ", ".join(str(x) for x in row) + f"][{month}]"
        whens.append(f"when lat <= {limits[i]} then {values}" if i < len(limits) else f"else {values}")
    return "case " + " ".join(whens) + " end"


FIRE = f"""
with recursive days as materialized (select *,
  cast({table_sql(C.DAY_LENGTHS, [-30, -15, 15, 30])} as double) as len,
  cast({table_sql(C.DAY_FACTORS, [-15, 15])} as double) as fac from fire_obs),
walk(cell, k, date, w, ffmc, dmc, dc) as (
  select distinct cell, cast(0 as bigint), cast(null as date), cast(0 as double),
    cast(85 as double), cast(6 as double), cast(15 as double) from days
  union all
  select cell, k, date, w,
    greatest(0.0, least(101.0, 59.5 * (250 - m) / (147.2 + m))),
    p + 1.894 * (greatest(t, -1.1) + 1.1) * (100 - h) * len * 1e-4,
    q + 0.5 * greatest(0.36 * (greatest(t, -2.8) + 2.8) + fac, 0.0)
  from (select *, case
      when m1 > ed then ed + (m1 - ed) * pow(10.0, -(0.424 * (1 - pow(h / 100, 1.7))
        + 0.0694 * sqrt(w) * (1 - pow(h / 100, 8))) * 0.581 * exp(0.0365 * t))
      when m1 < least(ew, ed) then ew - (ew - m1) * pow(10.0, -(0.424 * (1 - pow((100 - h) / 100, 1.7))
        + 0.0694 * sqrt(w) * (1 - pow((100 - h) / 100, 8))) * 0.581 * exp(0.0365 * t))
      else m1 end as m
    from (select *, 0.942 * pow(h, 0.679) + 11 * exp((h - 100) / 10)
        + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) as ed,
      0.618 * pow(h, 0.753) + 10 * exp((h - 100) / 10)
        + 0.18 * (21.1 - t) * (1 - exp(-0.115 * h)) as ew,
      case when rain > 0.5 then least(250.0, m0 + 42.5 * (rain - 0.5) * exp(-100 / (251 - m0))
        * (1 - exp(-6.93 / (rain - 0.5)))
        + case when m0 > 150 then 0.0015 * (m0 - 150) * (m0 - 150) * sqrt(rain - 0.5) else 0 end)
        else m0 end as m1,
      case when rain > 1.5 then greatest(0.0, 43.43 * (5.6348 - ln(280 / exp(0.023 * dmc0)
        + 1000 * (0.92 * rain - 1.27) / (48.77 + (case when dmc0 <= 33 then 100 / (0.5 + 0.3 * dmc0)
          when dmc0 <= 65 then 14 - 1.3 * ln(dmc0) else 6.2 * ln(dmc0) - 17.2 end)
          * (0.92 * rain - 1.27))))) else dmc0 end as p,
      case when rain > 2.8 then greatest(0.0, 400 * ln(800 / (800 * exp(-dc0 / 400)
        + 3.937 * (0.83 * rain - 1.27)))) else dc0 end as q
      from (select o.*, 147.2 * (101 - s.ffmc) / (59.5 + s.ffmc) as m0, s.dmc as dmc0, s.dc as dc0
        from walk s join days o on o.cell = s.cell and o.k = s.k + 1)))),
b as (select *, 147.2 * (101 - ffmc) / (59.5 + ffmc) as m, dmc + 0.4 * dc as share from walk
  where k > 0),
i as (select *, 0.208 * exp(0.05039 * w) * 91.9 * exp(-0.1386 * m) * (1 + pow(m, 5.31) / 4.93e7)
    as isi,
  case when share = 0 then 0 when dmc <= 0.4 * dc then 0.8 * dmc * dc / share
    else greatest(0.0, dmc - (1 - 0.8 * dc / share) * (0.92 + pow(0.0114 * dmc, 1.7))) end as bui
  from b),
f as (select *, 0.1 * isi * case when bui <= 80 then 0.626 * pow(bui, 0.809) + 2
  else 1000 / (25 + 108.64 * exp(-0.023 * bui)) end as b0 from i)
select cell, date, ffmc, dmc, dc, isi, bui,
  case when b0 > 1 then exp(2.72 * pow(0.434 * ln(b0), 0.647)) else b0 end as fwi from f"""
view("fire", FIRE, ["fire_obs"])


@query("fire_weather", """
select cell, date, round(ffmc, 4) as ffmc, round(dmc, 4) as dmc, round(dc, 4) as dc,
  round(isi, 4) as isi, round(bui, 4) as bui, round(fwi, 4) as fwi from fire""", ["fire"])
def fire_weather(spark, d):
    return rounded(C.fire_weather(fire_obs(spark, d)), *C.FIRE_COLUMNS, digits=4)


@query("fwi_exceedance", """
select f.cell, count(*) filter (fwi > 20) + count(*) filter (fwi > 30) + count(*) filter (fwi > 40)
  as fire_weather_index, round(avg(fwi), 4) as fire_weather_mean,
  round(avg(h), 4) as relative_humidity
from fire f join fire_obs o on f.cell = o.cell and f.date = o.date group by 1""",
       ["fire", "fire_obs"])
def fwi_exceedance(spark, d):
    obs = fire_obs(spark, d)
    both = C.fire_weather(obs).join(obs.select("cell", "date", "h"), ["cell", "date"])
    out = C.fwi_exceedance(both, humidity="h")
    return rounded(out, "fire_weather_mean", "relative_humidity", digits=4)
