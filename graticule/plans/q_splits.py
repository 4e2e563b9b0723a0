"""Queries: splits, balance and sampling."""

from pyspark.sql import functions as F

from graticule.operators import focal, partition, sampling
from graticule.plans import fixtures as X
from graticule.plans.catalog import query, view

ORDER = "order by md5(concat('42:', cell)), cell"


@query("spatial_split", "select cell, split from split", ["split"])
def spatial_split(spark, d):
    return X.split(spark, d).select("cell", "split")


@query("fixed_split", """
select cell, case when v_key in ('F') then 1 when v_key in ('O') then 2 else 3 end as split
from (select o_orderkey as cell, o_orderstatus as v_key from orders)""")
def fixed_split(spark, d):
    t = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), "o_orderstatus")
    return sampling.fixed_split(t, "o_orderstatus", ["F"], ["O"], ["P"]).select("cell", "split")


@query("random_split", f"""
select cell, case when rk <= floor(0.8 * n) then 1
  when rk <= floor(0.8 * n) + floor(0.15 * n) then 3 else 0 end as split
from (select cell, row_number() over ({ORDER}) as rk, count(*) over () as n from g)""", ["g"])
def random_split(spark, d):
    return sampling.random_split(X.g(spark, d)).select("cell", "split")


@query("weighted_assign", """
select s_suppkey, case when cast(('0x' || substring(md5(concat('42:', s_suppkey)), 1, 8)) as bigint)
  / 4294967296.0 < 0.7 then 1 else 2 end as part from supplier""")
def weighted_assign(spark, d):
    return sampling.weighted_assign(X.table(spark, d, "supplier"), "s_suppkey").select(
        "s_suppkey", "part")


@query("sample_n", f"""
select cell, split from (select cell, split, row_number() over ({ORDER}) as rk
from split where split > 0) where rk <= 900""", ["split"])
def sample_n(spark, d):
    return sampling.sample_n(X.split(spark, d), 900).select("cell", "split")


@query("sample_fraction", f"""
select cell from (select cell, row_number() over ({ORDER}) as rk, count(*) over () as n
from split where split = 1) where rk <= floor(0.25 * n)""", ["split"])
def sample_fraction(spark, d):
    rows = X.split(spark, d).where(F.col("split") == 1)
    return sampling.sample_fraction(rows, 0.25).select("cell")


@query("balance_by_region", f"""
select cell, split from (select *, row_number() over (partition by split, rid, y {ORDER}) as rk,
  sum(y) over (partition by split, rid) as pos from split where split > 0)
where y = 1 or rk <= pos""", ["split"])
def balance_by_region(spark, d):
    return sampling.balance_by_region(X.split(spark, d)).select("cell", "split")


@query("balance_classes", f"""
select cell, y from (select cell, y, row_number() over (partition by y {ORDER}) as rk,
  sum(y) over () as pos from g) where y = 1 or rk <= floor(pos / 0.5)""", ["g"])
def balance_classes(spark, d):
    return sampling.balance_classes(X.g(spark, d), ratio=0.5).select("cell", "y")


@query("balanced_batches", f"""
select cell, y, batch from (
  select cell, y, cast((rk - 1) // (case when y = 1 then 8 else 24 end) as bigint) as batch
  from (select cell, y, row_number() over (partition by y {ORDER}) as rk from g))
where batch < (select least(sum(y) // 8, sum(1 - y) // 24) from g)""", ["g"])
def balanced_batches(spark, d):
    return sampling.balanced_batches(X.g(spark, d), 32, 3).select("cell", "y", "batch")


@query("scaled_sample", f"""
select cell, v from (select cell, v, row_number() over ({ORDER}) as rk from g_missing
where v is not null) where rk <= 5000""", ["g_missing"])
def scaled_sample(spark, d):
    from graticule.operators.ranks import hash_take
    rows = X.g_missing(spark, d).where(F.col("v").isNotNull()).select("cell", "v")
    return hash_take(rows, 42, "cell", 5000)


@query("ensemble_slice", f"""
select cell from (select cell, row_number() over ({ORDER}) as rk, count(*) over () as n from g)
where rk > floor(0.8 * n * 1) and rk <= floor(0.8 * n * 1 + 0.8 * n)""", ["g"])
def ensemble_slice(spark, d):
    return sampling.ensemble_slice(X.g(spark, d), member=1).select("cell")


view("eroded", """
with edge as (select max(r) as top from g),
clash as (select distinct a.cell from split a, unnest([-2, -1, 0, 1, 2]) as x(dr),
  unnest([-2, -1, 0, 1, 2]) as w(dc), split b
  where b.r = a.r + x.dr and b.c = a.c + w.dc and b.split <> 0 and b.split <> a.split)
select cell, rid, y, case when split > 1 and (cell in (select cell from clash) or r < 2 or c < 2
  or c > 147 or r > (select top from edge) - 2) then 0 else cast(split as bigint) end as split
from split""", ["split"])


def height(spark, d):
    return X.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // X.WIDTH + 1


@query("erode_borders", "select cell, split from eroded", ["eroded"])
def erode_borders(spark, d):
    s = X.split(spark, d)
    return focal.erode_borders(s, "split", 5, height(spark, d), X.WIDTH).select("cell", "split")


@query("partition_map", f"""
select cell, rid, y, split from (select *, row_number() over ({ORDER}) as rk from (
  select * from (select *, row_number() over (partition by split, rid, y {ORDER}) as k,
    sum(y) over (partition by split, rid) as pos from eroded where split > 0)
  where y = 1 or k <= pos)) where rk <= 1500""", ["eroded"])
def split_map(spark, d):
    out = partition.partition_map(X.g(spark, d), height(spark, d), X.WIDTH, n=1500)
    return out.select("cell", "rid", "y", "split")


@query("patch_extract", """
select a.cell, list(coalesce(b.v, 0.0) order by x.dr, w.dc) as v
from g a cross join unnest([-2, -1, 0, 1, 2]) as x(dr)
cross join unnest([-2, -1, 0, 1, 2]) as w(dc)
left join g b on b.r = a.r + x.dr and b.c = a.c + w.dc group by 1""", ["g"])
def patch_extract(spark, d):
    return focal.patch_extract(X.g(spark, d), ["v"], 5).select("cell", "v")
