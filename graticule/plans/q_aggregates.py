"""Queries: statistics of layers, hazards and regions; windows over time."""

from pyspark.sql import functions as F

from graticule.operators import aggregates as A
from graticule.operators import cells
from graticule.plans import fixtures as X
from graticule.plans.catalog import query


@query("hazard_stats", """
select hazard, count(*) filter (n > 0 and region_id > 0) as n_hazard_pixels,
  count(*) filter (region_id > 0) as n_pixels,
  round(count(*) filter (n > 0 and region_id > 0) / count(*) filter (region_id > 0) * 100, 2)
    as hazard_coverage
from hazards group by 1""", ["hazards"])
def hazard_stats(spark, d):
    return A.hazard_stats(X.hazards(spark, d))


@query("region_stats", """
select hazard, region_id, count(*) filter (n > 0) as n_hazard_pixels, count(*) as n_pixel,
  count(*) filter (n > 0) / count(*) * 100 as hazard_coverage
from hazards where region_id <> 0 group by 1, 2""", ["hazards"])
def region_stats(spark, d):
    return A.region_stats(X.hazards(spark, d))


@query("region_spread", """
select hazard, round(avg(k), 6) as avg_hazard_count, min(k) as min_hazard_count,
  max(k) as max_hazard_count, round(stddev_pop(k), 6) as std_hazard_count
from (select hazard, region_id, count(*) filter (n > 0) as k from hazards
      where region_id <> 0 group by 1, 2) group by 1""", ["hazards"])
def region_spread(spark, d):
    out = A.region_spread(A.region_stats(X.hazards(spark, d)))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_hazard_count", "std_hazard_count")})


@query("layer_profile", """
select name, count(*) as n, min(value) as min, max(value) as max,
  count(distinct value) as n_distinct, count(*) filter (value is null) as n_missing,
  count(*) filter (value is null or value <> 0) as n_nonzero,
  count(*) filter (value is null or value <> 0) / count(*) as nonzero_ratio
from (select cell, 'v' as name, v as value from g_missing
      union all select cell, 'n', cast(n as double) from g_missing) group by 1""", ["g_missing"])
def layer_profile(spark, d):
    long = X.g_missing(spark, d).select("cell", "v", F.col("n").cast("double").alias("n"))
    return A.layer_profile(long.unpivot("cell", ["v", "n"], "name", "value"))


@query("class_balance", "select split, y, count(*) as n from split group by 1, 2", ["split"])
def class_balance(spark, d):
    return A.class_balance(X.split(spark, d))


@query("split_counts", "select split, count(*) as n from split group by 1", ["split"])
def split_counts(spark, d):
    return A.split_counts(X.split(spark, d))


@query("value_counts", "select o_orderpriority, count(*) as n from orders group by 1")
def value_counts(spark, d):
    return A.value_counts(X.table(spark, d, "orders"), "o_orderpriority")


@query("multi_hazard_index", """
select cell, cast(sum(n - 1) as bigint) as mh_index
from (select event, cell, count(*) as n from hazard_events group by 1, 2)
where n > 1 group by 1""", ["hazard_events"])
def multi_hazard_index(spark, d):
    return A.multi_hazard_index(X.hazard_events(spark, d))


@query("union_layers_cap", """
select cell, case when y + n > 1 then 1 else y + n end as both from (
  select a.cell, a.y, cast(b.n > 0 as integer) as n from g a join g_missing b on a.cell = b.cell)
""", ["g", "g_missing"])
def union_layers_cap(spark, d):
    other = X.g_missing(spark, d).select("cell", (F.col("n") > 0).cast("int").alias("n"))
    both = X.g(spark, d).select("cell", "y").join(other, "cell")
    return both.select("cell", A.union_layers_cap("y", "n").alias("both"))


def yearly_sql(fn, column, digits=6):
    return f"""
select cell, cast(year(date) as integer) as year, round({fn}({column}), {digits}) as value
from obs_long group by 1, 2"""


def yearly(spark, d, how, column):
    return A.yearly(X.obs_long(spark, d), how, column).withColumn("value", F.round("value", 6))


@query("yearly_max", yearly_sql("max", "mx"), ["obs_long"])
def yearly_max(spark, d):
    return yearly(spark, d, "max", "mx")


@query("yearly_mean", yearly_sql("avg", "t2m"), ["obs_long"])
def yearly_mean(spark, d):
    return yearly(spark, d, "mean", "t2m")


@query("yearly_sum", yearly_sql("sum", "tp"), ["obs_long"])
def yearly_sum(spark, d):
    return yearly(spark, d, "sum", "tp")


YEARLY_GAPS = """
select cell, year(date) as year, max(case when wind < 10 then mx end) as value
from obs_long group by 1, 2"""


def yearly_with_gaps(spark, d):
    daily = X.obs_long(spark, d).withColumn("m", F.when(F.col("wind") < 10, F.col("mx")))
    return A.yearly(daily, "max", "m")


@query("mean_over_years", f"""
select cell, case when count(*) = count(value) then round(avg(value), 6) end as value
from ({YEARLY_GAPS}) group by 1""", ["obs_long"])
def mean_over_years(spark, d):
    return A.mean_over_years(yearly_with_gaps(spark, d)).withColumn("value", F.round("value", 6))


@query("latest_year", f"""
select cell, value from (select *, row_number() over (partition by cell order by year desc) as rn
from ({YEARLY_GAPS})) where rn = 1""", ["obs_long"])
def latest_year(spark, d):
    return A.latest_year(yearly_with_gaps(spark, d))


CORR = ["price", "cust", "age", "prio"]


@query("corr_matrix", " union all ".join(
    f"select '{a}' as a, '{b}' as b, " + ("cast(1 as double)" if a == b else
                                          f"round(corr({a}, {b}), 6)") + " as corr from gaps"
    + (" group by 1" if a == b else "")
    for a in CORR for b in CORR).replace("select", "with gaps as (select cell, "
    "case when prio > 1 then price end as price, cust, case when prio < 5 then age end as age,"
    " prio from features) select", 1), ["features"])
def corr_matrix(spark, d):
    f = X.features(spark, d)
    gaps = f.withColumns({"price": F.when(F.col("prio") > 1, F.col("price")),
                          "age": F.when(F.col("prio") < 5, F.col("age"))})
    return A.corr_matrix(gaps, CORR).withColumn("corr", F.round("corr", 6))


@query("histogram", """
select y, cast(case when p = 1 then 19 else floor(p / 1.0 * 20) end as integer) as bin,
  count(*) as n from scores group by 1, 2""", ["scores"])
def histogram(spark, d):
    return A.histogram(X.scores(spark, d), "p", 0, 1, 20, ["y"])


@query("box_summary", " union all ".join(
    f"select name, cast({q} as double) as q, round(quantile_cont(value, {q}), 6) as value "
    "from layers group by 1" for q in (0, 0.25, 0.5, 0.75, 1)), ["layers"])
def box_summary(spark, d):
    out = A.quantiles(X.layers(spark, d), "value", [0, 0.25, 0.5, 0.75, 1], ["name"])
    return out.withColumn("value", F.round("value", 6))


@query("kde_1d", """
with c as (select y, floor(p * 512) as bin, count(*) as n, avg(p) as px
           from scores group by 1, 2),
s as (select y, sum(n) as t, sqrt((sum(n * px * px) - sum(n) * (sum(n * px) / sum(n))
        * (sum(n * px) / sum(n))) / (sum(n) - 1)) * pow(sum(n), -0.2) as h from c group by 1),
e as (select i / 49.0 as x, i from range(50) t(i))
select c.y, e.i, round(sum(n / (t * h * sqrt(2 * pi())) * exp(-0.5 * ((x - px) / h)
  * ((x - px) / h))), 6) as density
from c join s on c.y = s.y cross join e group by 1, 2""", ["scores"])
def kde_1d(spark, d):
    out = A.kde_1d(X.scores(spark, d), "p", 0.0, 1.0, 50, 512, ["y"])
    place = F.round(F.col("x") * 49).cast("long").alias("i")
    return out.select("y", place, F.round("density", 6).alias("density"))


@query("kde_1d_within", """
with s as (select y, count(*) as n, stddev_samp(p) * pow(count(*), -0.2) as h from scores group by 1)
select s.y, i, round(sum(exp(-0.5 * ((i / 49.0 - p) / h) * ((i / 49.0 - p) / h)))
  / (max(n) * max(h) * sqrt(2 * pi())), 6) as density
from scores join s on scores.y = s.y cross join range(50) t(i) group by 1, 2""", ["scores"])
def kde_1d_within(spark, d):
    out = A.kde_1d_within(X.scores(spark, d), "p", 0.0, 1.0, 50, 1e-10, ["y"])
    place = F.round(F.col("x") * 49).cast("long").alias("i")
    return out.select("y", place, F.round("density", 6).alias("density"))


@query("kde_2d", """
with s as (select count(*) as n, var_samp(price) as sxx, var_samp(age) as syy,
  covar_samp(price, age) as sxy, min(price) as x0, max(price) as x1, min(age) as y0,
  max(age) as y1, pow(count(*), -1.0 / 6) as k from features),
h as (select *, sxx * k * k as a, sxy * k * k as b, syy * k * k as c,
  sxx * k * k * syy * k * k - sxy * k * k * sxy * k * k as det from s),
p as (select cast(least(floor((price - x0) / (x1 - x0) * 100), 99) as integer) as i,
  cast(least(floor((age - y0) / (y1 - y0) * 100), 99) as integer) as j, count(*) as w
  from features, s group by 1, 2),
t as (select gi, gj, w, x0 + gi * (x1 - x0) / 99 - (x0 + (i + 0.5) * (x1 - x0) / 100) as u,
  y0 + gj * (y1 - y0) / 99 - (y0 + (j + 0.5) * (y1 - y0) / 100) as v, a, b, c, det, n
  from p, h, range(100) g1(gi), range(100) g2(gj))
select gi as i, gj as j, round(sum(w * exp(-0.5 * (c * u * u - 2 * b * u * v + a * v * v) / det))
  / (2 * pi() * sqrt(max(det)) * max(n)) * 1e9, 4) as density from t group by 1, 2""",
       ["features"])
def kde_2d(spark, d):
    f = X.features(spark, d)
    out = A.kde_2d(f, "price", "age", points=100, bins=100)
    step = lambda v, name: F.round(
        (F.col(v) - f.agg(F.min(name)).scalar())
        / (f.agg(F.max(name)).scalar() - f.agg(F.min(name)).scalar()) * 99).cast("long")
    return out.select(step("x", "price").alias("i"), step("y", "age").alias("j"),
                      F.round(F.col("density") * 1e9, 4).alias("density"))


@query("land_share", """
select round(avg(cast(price >= 0.5 as double)) * 100, 2) as price,
  round(avg(cast(cust >= 0.3 as double)) * 100, 2) as cust,
  round(avg(cast(k = 0 as double)) * 100, 2) as none,
  round(avg(cast(k = 1 as double)) * 100, 2) as single,
  round(avg(cast(k > 1 as double)) * 100, 2) as multiple
from (select price / 500000 as price, cust / 1500 as cust,
  cast(price / 500000 >= 0.5 as integer) + cast(cust / 1500 >= 0.3 as integer) as k
  from features)""", ["features"])
def land_share(spark, d):
    f = X.features(spark, d).select(
        (F.col("price") / 500000).alias("price"), (F.col("cust") / 1500).alias("cust"))
    return A.land_share(f, {"price": 0.5, "cust": 0.3})


@query("distinct_regions_hit", "select distinct rid from g where y > 0 and rid <> 0", ["g"])
def distinct_regions_hit(spark, d):
    from graticule.operators.sampling import distinct_regions_hit as hit
    return hit(X.g(spark, d))


# --- 2.5 windows over time ------------------------------------------------------

@query("rolling_mean", """
select cell, date, round(avg(t) over (partition by cell order by date
  rows between 2 preceding and current row), 6) as rolling from obs""", ["obs"])
def rolling_mean(spark, d):
    return A.rolling_mean(X.obs(spark, d), "t").select(
        "cell", "date", F.round("rolling", 6).alias("rolling"))


@query("consecutive_runs", """
with h as (select cell, date, row_number() over (partition by cell order by date) as k
           from obs where mx > 20),
r as (select cell, date - cast(k as integer) as run, count(*) as days from h group by 1, 2)
select cell, cast(sum(days) as bigint) as run_days, count(*) as n_runs from r
where days >= 5 group by 1""", ["obs"])
def consecutive_runs(spark, d):
    return A.consecutive_runs(X.obs(spark, d), F.col("mx") > 20, 5)


# --- 2.6 sort and top -------------------------------------------------------------

@query("sort_axis", "select cell, lon from (select cell, ((c * 3 + 180) % 360) - cast(180 as double) as lon from g)",
       ["g"])
def sort_axis(spark, d):
    from graticule.functions.scalar import lon_wrap
    return X.g(spark, d).select("cell", lon_wrap(F.col("c") * 3).alias("lon")).orderBy("lon", "cell")


@query("best_run", """
select o_orderkey, o_totalprice as val_loss from orders order by 2, 1 limit 1""")
def best_run(spark, d):
    runs = X.table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("val_loss"))
    return A.best_run(runs)


@query("mask_missing", "select cell, case when v < 0 then null else v end as v from g_missing",
       ["g_missing"])
def mask_missing(spark, d):
    df = X.g_missing(spark, d).withColumn(
        "v", F.when(F.col("v") < 0, F.lit(float("nan"))).otherwise(F.col("v")))
    return cells.nan_to_null(df, ["v"], [-9999]).select("cell", "v")
