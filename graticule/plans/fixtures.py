"""Stand-in inputs: the study's tables derived from the provided parquet tables.

Each function has a twin among the SQL views, so a query and its check start
from the same rows.
"""

from pyspark.sql import functions as F

from graticule.operators import focal, sampling
from graticule.plans.catalog import view

WIDTH = 150
SEED = 42


def table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def g(spark, d):
    """The cell table: ``orders`` laid out row by row on a grid 150 wide."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("cell"),
        F.expr(f"o_orderkey div {WIDTH}").alias("r"),
        (k % WIDTH).alias("c"),
        F.when(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 250000), 1
        ).otherwise(0).alias("y"),
        F.col("o_totalprice").alias("v"),
        F.expr(
            f"(o_orderkey div {WIDTH * 10}) * {WIDTH // 10} + (o_orderkey % {WIDTH}) div 10"
        ).alias("rid"),
    )


view("g", """
select o_orderkey as cell, o_orderkey // 150 as r, o_orderkey % 150 as c,
       case when o_orderpriority = '1-URGENT' and o_totalprice > 250000
            then 1 else 0 end as y,
       o_totalprice as v,
       (o_orderkey // 1500) * 15 + (o_orderkey % 150) // 10 as rid
from orders""")


def g_missing(spark, d):
    """Elevation ``v`` is missing at sea (status 'P'); counts ``n`` too at status 'F'."""
    k = F.col("o_orderkey")
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        k.alias("cell"),
        F.expr(f"o_orderkey div {WIDTH}").alias("r"),
        (k % WIDTH).alias("c"),
        F.when(status != "P", F.col("o_totalprice") - 50000.0).alias("v"),
        F.when(status != "F", F.col("o_custkey") % 3).alias("n"),
    )


view("g_missing", """
select o_orderkey as cell, o_orderkey // 150 as r, o_orderkey % 150 as c,
       case when o_orderstatus <> 'P' then o_totalprice - 50000.0 end as v,
       case when o_orderstatus <> 'F' then o_custkey % 3 end as n
from orders""")


def features(spark, d):
    """Wide form: four layers side by side plus the label."""
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cell"),
        F.when(
            (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 250000), 1
        ).otherwise(0).alias("y"),
        F.col("o_totalprice").alias("price"),
        F.col("o_custkey").cast("double").alias("cust"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        .cast("double").alias("age"),
        F.substring("o_orderpriority", 1, 1).cast("double").alias("prio"),
    )


view("features", """
select o_orderkey as cell,
       case when o_orderpriority = '1-URGENT' and o_totalprice > 250000
            then 1 else 0 end as y,
       o_totalprice as price, cast(o_custkey as double) as cust,
       cast(cast(o_orderdate as date) - date '1995-01-01' as double) as age,
       cast(substring(o_orderpriority, 1, 1) as double) as prio
from orders""")

LAYERS = ["price", "cust", "age", "prio"]


def layers(spark, d):
    """Long form: (cell, name, value)."""
    return features(spark, d).unpivot("cell", LAYERS, "name", "value")


view("layers", """
select cell, 'price' as name, price as value from features
union all select cell, 'cust', cust from features
union all select cell, 'age', age from features
union all select cell, 'prio', prio from features""", ["features"])


def split(spark, d):
    """``g`` with its train/validation/test code."""
    return sampling.spatial_split(g(spark, d), region="rid", label="y", seed=SEED)


view("split", """
select g.*, coalesce(k.split, 0) as split from g left join (
  select rid, case when rk <= floor(0.8 * n) then 1
                   when rk <= floor(0.9 * n) then 2 else 3 end as split
  from (select rid, row_number() over (order by md5(concat('42:', rid)), rid) as rk,
               count(*) over () as n
        from (select distinct rid from g where y > 0 and rid <> 0))) k
on g.rid = k.rid""", ["g"])


def obs(spark, d):
    """Daily series per cell from ``events`` (30 days)."""
    return table(spark, d, "events").groupBy(
        F.col("user_id").alias("cell"), F.col("ts").cast("date").alias("date")
    ).agg(
        F.round(F.avg("value"), 6).alias("t"), F.max("value").alias("mx"),
        F.count(F.lit(1)).alias("n"),
    )


view("obs", """
select user_id as cell, cast(ts as date) as date, round(avg(value), 6) as t,
       max(value) as mx, count(*) as n
from events group by 1, 2""")


def obs_long(spark, d):
    """Daily series per cell over several years from ``lineitem``."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").alias("cell"), F.col("l_shipdate").cast("date").alias("date")
    ).agg(
        (F.sum("l_quantity") / 1000).alias("tp"),
        (F.sum(F.lit(50.0) - F.col("l_quantity")) / 1000).alias("pev"),
        F.max("l_extendedprice").alias("mx"),
        (F.lit(273.15) + F.max("l_quantity")).alias("t2m"),
        F.round(F.max("l_discount") * 100, 0).alias("wind"),
    )


view("obs_long", """
select l_suppkey as cell, cast(l_shipdate as date) as date,
       sum(l_quantity) / 1000 as tp, sum(50.0 - l_quantity) / 1000 as pev,
       max(l_extendedprice) as mx, 273.15 + max(l_quantity) as t2m,
       round(max(l_discount) * 100, 0) as wind
from lineitem group by 1, 2""")


def obs_hourly(spark, d):
    """Hourly wind components from ``events``."""
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").groupBy(
        F.col("user_id").alias("cell"),
        F.col("ts").cast("date").alias("date"),
        F.hour("ts").cast("int").alias("hour"),
    ).agg(
        F.max(F.col("value") - 245).alias("u"), F.max(k - 50).alias("v"),
    )


view("obs_hourly", """
select user_id as cell, cast(ts as date) as date, cast(hour(ts) as integer) as hour,
       max(value - 245) as u,
       max(cast(json_extract_string(props, '$.k') as double) - 50) as v
from events group by 1, 2, 3""")


def hazard_events(spark, d):
    """Event records: several hazards may strike one cell in one event."""
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("event"),
        F.expr("o_orderkey % 40").alias("cell"),
        F.col("o_orderpriority").alias("hazard"),
    )


view("hazard_events", """
select o_custkey as event, o_orderkey % 40 as cell, o_orderpriority as hazard
from orders""")


def scores(spark, d):
    """Label and predicted probability per cell, with ties on purpose."""
    return g(spark, d).select(
        "cell", "y", (F.floor(F.col("v") / 1000) / 500).alias("p")
    )


view("scores", "select cell, y, floor(v / 1000) / 500 as p from g", ["g"])


def scores_multi(spark, d):
    """The same cells scored by three models."""
    s = scores(spark, d)
    p = F.col("p")
    return s.select(
        "cell", "y",
        F.explode(F.array(
            F.struct(F.lit("direct").alias("model"), p.alias("p")),
            F.struct(F.lit("square").alias("model"), (p * p).alias("p")),
            F.struct(F.lit("reverse").alias("model"), (1 - p).alias("p")),
        )).alias("m"),
    ).select("cell", "y", "m.model", "m.p")


view("scores_multi", """
select cell, y, 'direct' as model, p from scores
union all select cell, y, 'square', p * p from scores
union all select cell, y, 'reverse', 1 - p from scores""", ["scores"])


def hazards(spark, d):
    """Long (cell, hazard, n): the hazard inventories of all cells with regions."""
    base = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("cell"), "o_custkey", "o_orderpriority", "o_totalprice",
        F.expr(
            f"(o_orderkey div {WIDTH * 10}) * {WIDTH // 10} + (o_orderkey % {WIDTH}) div 10"
        ).alias("region_id"),
    )
    kind = lambda name, n: F.struct(F.lit(name).alias("hazard"), n.cast("long").alias("n"))
    one = lambda cond: F.when(cond, F.lit(1))
    return base.select(
        "cell", "region_id",
        F.explode(F.array(
            kind("landslide", F.when(F.col("o_totalprice") > 480000, 2).otherwise(0)),
            kind("flood", one(F.col("o_custkey") % 7 == 0)),
            kind("wildfire", F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)),
        )).alias("h"),
    ).select("cell", "region_id", "h.hazard", "h.n")


view("hazards", """
with b as (select o_orderkey as cell, o_custkey, o_orderpriority, o_totalprice,
  (o_orderkey // 1500) * 15 + (o_orderkey % 150) // 10 as region_id from orders)
select cell, region_id, 'landslide' as hazard,
       case when o_totalprice > 480000 then 2 else 0 end as n from b
union all select cell, region_id, 'flood', case when o_custkey % 7 = 0 then 1 end from b
union all select cell, region_id, 'wildfire',
       case when o_orderpriority = '1-URGENT' then 1 else 0 end from b""")


def dem(spark, d):
    """Elevation: ``v`` smoothed over 3 x 3 cells, in whole thousandths."""
    cents = g(spark, d).select(
        "cell", "r", "c", F.round(F.col("v") * 100).cast("double").alias("cents")
    )
    mean = focal.focal_sum_count(cents, "cents", radius=1)
    return mean.select(
        "cell", "r", "c",
        (F.floor(F.col("total") / (F.col("n") * 10)) / 1000.0).alias("z"),
    )


view("dem", """
select a.cell, a.r, a.c,
       (sum(cast(round(b.v * 100) as bigint)) // (count(*) * 10)) / 1000.0 as z
from g a, unnest([-1, 0, 1]) as x(dr), unnest([-1, 0, 1]) as w(dc), g b
where b.r = a.r + x.dr and b.c = a.c + w.dc
group by 1, 2, 3""", ["g"])
