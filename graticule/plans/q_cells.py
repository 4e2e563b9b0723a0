"""Queries: sources, filters, projections, joins of layers, set operations, scalars."""


from pyspark.sql import functions as F

from graticule.functions import scalar as S
from graticule.functions import scaling
from graticule.operators import cells, joins, sampling
from graticule.operators.ranks import ordered_rank
from graticule.plans import fixtures as X
from graticule.plans.catalog import query
from graticule.sources import layers as L


def count(name="n"):
    return F.count(F.lit(1)).alias(name)


def rnd(x, n=6):
    return F.round(x, n)


# --- 2.1 scans -------------------------------------------------------------

@query("scan_layer", """
select o_orderkey // 150 as r, o_orderkey % 150 as c, o_totalprice as value
from orders""")
def scan_layer(spark, d):
    raw = L.scan_layer(spark, f"{d}/orders.parquet", value="o_totalprice", index="o_orderkey",
                       width=X.WIDTH)
    return raw.select("r", "c", "value")


@query("scan_yearly_union", """
select cast(year(o_orderdate) as integer) as year, count(*) as n,
       round(sum(o_totalprice), 2) as total
from orders where year(o_orderdate) between 1996 and 1999 group by 1""")
def scan_yearly_union(spark, d):
    base = X.table(spark, d, "orders").select(
        F.year("o_orderdate").alias("year"), "o_totalprice")
    parts = [base.where(F.col("year") == y) for y in range(1995, 2002)]
    return L.union_years(parts, 1996, 1999).groupBy("year").agg(
        count(), F.round(F.sum("o_totalprice"), 2).alias("total"))


REGISTRY = L.Registry([
    ("price", "layers/price", "continuous", "feature"),
    ("cust", "layers/cust", "categorical", "feature"),
    ("age", "layers/age", "continuous", "feature"),
    ("prio", "layers/prio", "categorical", "feature"),
])


@query("layer_registry", """
select name, case when name in ('price', 'age') then 'continuous' else 'categorical' end as kind,
       'feature' as role, count(*) as n from layers group by 1""", ["layers"])
def layer_registry(spark, d):
    REGISTRY.check(X.LAYERS)
    counts = X.layers(spark, d).groupBy("name").agg(count())
    return REGISTRY.describe(counts).select("name", "kind", "role", "n")


# --- 2.2 filters and projections --------------------------------------------

@query("valid_mask", "select cell, v from g_missing where v is not null", ["g_missing"])
def valid_mask(spark, d):
    return cells.valid_mask(X.g_missing(spark, d)).select("cell", "v")


@query("map_domain", "select cell from g_missing where v > 0", ["g_missing"])
def map_domain(spark, d):
    return cells.map_domain(X.g_missing(spark, d)).select("cell")


@query("mask_clip_layer", """
select a.cell, case when m.cell is not null and a.v is not null
                    then least(greatest(a.v, 0.0), 300000.0) end as v
from g_missing a left join (select cell from g where y = 0) m on a.cell = m.cell
where a.r >= 2 and a.r < 1000000 and a.c >= 5 and a.c < 140""", ["g_missing", "g"])
def mask_clip_layer(spark, d):
    mask = X.g(spark, d).where(F.col("y") == 0)
    out = cells.mask_clip_layer(X.g_missing(spark, d), mask, "v", cap=300000,
                                window=(2, 1000000, 5, 140))
    return out.select("cell", "v")


@query("fill_missing", "select cell, coalesce(v, 0.0) as v from g_missing", ["g_missing"])
def fill_missing(spark, d):
    return cells.fill_missing(X.g_missing(spark, d), ["v"]).select("cell", "v")


@query("binarize_label", """
select cell, coalesce(cast(n > 0 as integer), 0) as y from g_missing""", ["g_missing"])
def binarize_label(spark, d):
    return X.g_missing(spark, d).select("cell", cells.binarize("n").alias("y"))


@query("drop_incomplete", """
select cell from g_missing where v is not null and n is not null""", ["g_missing"])
def drop_incomplete(spark, d):
    return cells.drop_incomplete(X.g_missing(spark, d), ["v", "n"]).select("cell")


@query("crop_window", """
select cell, v from g where r >= 3 and r < 9 and c >= 20 and c < 130""", ["g"])
def crop_window(spark, d):
    return cells.crop_window(X.g(spark, d), 3, 9, 20, 130).select("cell", "v")


POSITIONED = """
select cell, r, c, 72.0 - (r + 0.5) / 4 as lat, -25.0 + (c + 0.5) / 4 as lon from g"""


def positioned(spark, d):
    return X.g(spark, d).select(
        "cell", "r", "c",
        (F.lit(72.0) - (F.col("r") + 0.5) / 4).alias("lat"),
        (F.lit(-25.0) + (F.col("c") + 0.5) / 4).alias("lon"),
    )


@query("crop_bbox", f"""
select cell, lat, lon from ({POSITIONED})
where lat between 50.125 and 71 and lon between -20 + 0.25 and 10 + 0.25""", ["g"])
def crop_bbox(spark, d):
    return cells.crop_bbox(positioned(spark, d), 50.125, 71, -20, 10, shift=0.25).select(
        "cell", "lat", "lon")


@query("clip_to_region", """
select cell, r - 4 as r, c - 20 as c from g where r >= 4 and r < 1000 and c >= 20 and c < 140
""", ["g"])
def clip_to_region(spark, d):
    bounds = (-20.2, -178.4, 10.3, 70.9)
    return cells.clip_to_region(
        X.g(spark, d), bounds, (-25.0, 72.0), 0.25).select("cell", "r", "c")


@query("points_in_extent", """
select s_suppkey from supplier
where s_nationkey > 3 and s_nationkey < 20 and s_acctbal > 0 and s_acctbal < 9000
  and s_suppkey % 3 = 0
""")
def points_in_extent(spark, d):
    kind = F.when(F.col("s_suppkey") % 3 == 0, "confirmed").otherwise("uncertain")
    points = X.table(spark, d, "supplier").withColumn("kind", kind)
    return cells.points_in_extent(
        points, 3, 0, 20, 9000, x="s_nationkey", y="s_acctbal", category="kind",
        keep="confirmed").select("s_suppkey")


@query("time_slice", """
select cell, date, mx from obs_long where date between date '1996-03-01' and date '2000-02-29'
""", ["obs_long"])
def time_slice(spark, d):
    # the range is applied to the scan, below the daily aggregation
    return cells.time_slice(X.obs_long(spark, d), "1996-03-01", "2000-02-29").select(
        "cell", "date", "mx")


@query("exclude_regions", """
select cell, case when rid in (select n_nationkey from nation) then 0 else split end as split
from split""", ["split"])
def exclude_regions(spark, d):
    names = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("long"))
    return sampling.exclude_regions(X.split(spark, d), "rid", names).select("cell", "split")


@query("exclude_water", """
select cell, case when cust in (1, 7, 21) then 0 else 1 end as split from features
""", ["features"])
def exclude_water(spark, d):
    coded = X.features(spark, d).withColumn("split", F.lit(1))
    return sampling.exclude_water(coded, "cust", (1.0, 7.0, 21.0)).select("cell", "split")


@query("valid_margin", """
select cell from split where split = 1 and c between 2 and 147
  and r between 2 and (select max(r) from g) - 2""", ["split"])
def valid_margin(spark, d):
    s = X.split(spark, d)
    height = X.g(spark, d).agg(F.max("r") + 1).scalar()
    return sampling.valid_margin(s, 1, height, X.WIDTH).select("cell")


@query("stride_downsample", "select r, c, v from g where r % 3 = 0 and c % 3 = 0", ["g"])
def stride_downsample(spark, d):
    return cells.stride_downsample(X.g(spark, d), 3).select("r", "c", "v")


@query("clamp_reclass", """
select cell, case when v > 200000.0 then 200000.0 else v end as capped,
  case when v / 2000 < 20 then 1 when v / 2000 < 50 then 2 when v / 2000 < 100 then 3
       when v / 2000 < 150 then 4 when v is not null then 5 end as shake,
  case when v > 0 then 1 when v <= 0 then 0 end as curvature,
  case when n < 2 then 0 when n >= 2 then 1 end as flux
from g_missing""", ["g_missing"])
def clamp_reclass(spark, d):
    df = X.g_missing(spark, d).withColumn("half", F.col("v") / 2000)
    return df.select(
        "cell", cells.cap_value("v", 200000.0).alias("capped"),
        cells.shake_class("half").alias("shake"),
        cells.curvature_class("v").alias("curvature"),
        cells.flux_class("n", 2).alias("flux"),
    )


@query("nan_indicator", """
select cell, cast(v is null as integer) as missing from g_missing""", ["g_missing"])
def nan_indicator(spark, d):
    return X.g_missing(spark, d).select("cell", cells.nan_indicator("v").alias("missing"))


@query("cell_index", """
select r * 150 + c as cell, cell // 150 as r, cell % 150 as c from g""", ["g"])
def cell_index(spark, d):
    flat = X.g(spark, d).select(cells.to_cell("r", "c", X.WIDTH).alias("cell"))
    return cells.with_row_col(flat, X.WIDTH)


@query("rotate_flip", """
select 'turn' as kind, 149 - c as r, r as c, v from g
union all select 'flip', (select max(r) from g) - r, c, v from g""", ["g"])
def rotate_flip(spark, d):
    grid = X.g(spark, d).select("r", "c", "v")
    top = grid.agg(F.max("r") + 1).scalar()
    turned = cells.rotate_quarter(grid, None, X.WIDTH, 1)
    flipped = grid.withColumn("r", top - 1 - F.col("r"))
    return turned.withColumn("kind", F.lit("turn")).unionByName(
        flipped.withColumn("kind", F.lit("flip")))


@query("class_weight", """
select cell, cast(y * 5.0 + (1 - y) as double) as weight from g""", ["g"])
def class_weight(spark, d):
    return sampling.class_weight(X.g(spark, d), 5).select("cell", "weight")


@query("stack_features", "select cell, price, cust, age, prio from features", ["features"])
def stack_features(spark, d):
    return joins.stack_features(X.layers(spark, d), X.LAYERS)


# --- 2.3 joins ---------------------------------------------------------------

@query("align_layers", "select cell, price, age, prio from features", ["features"])
def align_layers(spark, d):
    f = X.features(spark, d)
    return joins.align_layers([f.select("cell", n) for n in ("price", "age", "prio")])


@query("region_semi", """
select cell from g where rid in (select o_custkey from orders where o_totalprice > 400000)
""", ["g"])
def region_semi(spark, d):
    ids = X.table(spark, d, "orders").where(F.col("o_totalprice") > 400000).select(
        F.col("o_custkey").alias("rid"))
    return joins.region_semi(X.g(spark, d), ids, "rid").select("cell")


@query("lut_map", """
select g.cell, coalesce(n.n_regionkey, 0) as code from g left join nation n
on g.rid = n.n_nationkey""", ["g"])
def lut_map(spark, d):
    lut = X.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("rid"), "n_regionkey")
    return joins.lut_map(X.g(spark, d), lut, "rid", "n_regionkey").select("cell", "code")


STARTS = "select o_orderkey as k1, o_custkey % 7 as k2, o_totalprice as x from orders"
ENDS = """
select l_orderkey as k1, l_linenumber as k2, l_partkey as pos, l_extendedprice as y
from lineitem"""


def starts_ends(spark, d):
    start = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("k1"), (F.col("o_custkey") % 7).alias("k2"),
        F.col("o_totalprice").alias("x"))
    end = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("long").alias("k2"),
        F.col("l_partkey").alias("pos"), F.col("l_extendedprice").alias("y"))
    return start, end


@query("match_first", f"""
with s as ({STARTS}), e as ({ENDS}),
f as (select k1, k2, pos, y, row_number() over (partition by k1, k2 order by pos, y) as rn from e)
select s.k1, s.k2, s.x, f.pos as end_pos, f.y as end_y from s join f
on s.k1 = f.k1 and s.k2 = f.k2 and f.rn = 1""")
def match_first(spark, d):
    start, end = starts_ends(spark, d)
    return joins.match_first(start, end, ["k1", "k2"], ["pos", "y"], ["pos", "y"])


@query("anti_unmatched", f"""
with s as ({STARTS}), e as ({ENDS})
select k1, k2, x from s where k1 not in
  (select s.k1 from s join e on s.k1 = e.k1 and s.k2 = e.k2)""")
def anti_unmatched(spark, d):
    start, end = starts_ends(spark, d)
    return joins.anti_unmatched(start, end, ["k1", "k2"], "k1")


@query("union_by_key", "select distinct hazard, cell from hazard_events", ["hazard_events"])
def union_by_key(spark, d):
    return joins.union_by_key(X.hazard_events(spark, d), "hazard")


@query("scatter_to_grid", """
select g.cell, case when s.p is not null then least(greatest(s.p, 0.0), 1.0) end as p
from g left join (select cell, p * 1.2 - 0.1 as p from scores where y = 0 or p > 0.7) s
on g.cell = s.cell""", ["g", "scores"])
def scatter_to_grid(spark, d):
    part = X.scores(spark, d).where((F.col("y") == 0) | (F.col("p") > 0.7)).select(
        "cell", (F.col("p") * 1.2 - 0.1).alias("p"))
    return joins.scatter_to_grid(X.g(spark, d), part).select("cell", "p")


@query("mosaic_tiles", """
with t as (select r + (rid % 2) * 3 as r, c, v as value, rid as tile_order
           from g where v > 100000)
select r, c, value from (select *, row_number() over (partition by r, c order by tile_order) as rn
from t) where rn = 1""", ["g"])
def mosaic_tiles(spark, d):
    tiles = X.g(spark, d).select(
        "r", "c", ((F.col("rid") % 2) * 3).alias("row_offset"),
        F.lit(0).cast("long").alias("col_offset"),
        F.when(F.col("v") > 100000, F.col("v")).alias("value"),
        F.col("rid").alias("tile_order"))
    return joins.mosaic_tiles(tiles)


# --- 2.7 set operations --------------------------------------------------------

@query("union_tables", """
select l_orderkey as id, l_extendedprice as x, null as y, 'line' as kind from lineitem
union all select o_orderkey, null, o_totalprice, 'order' from orders""")
def union_tables(spark, d):
    a = X.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("x"),
        F.lit("line").alias("kind"))
    b = X.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"),
        F.lit("order").alias("kind"))
    return joins.union_tables(a, b)


@query("complement", """
select cell from g where cell not in (select cell from split where split = 1)""", ["g", "split"])
def complement(spark, d):
    taken = X.split(spark, d).where(F.col("split") == 1)
    return joins.complement(X.g(spark, d), taken).select("cell")


@query("assemble_split_map", """
select g.cell, case when s.split is null then 0 else s.split end as split
from g left join (select cell, split from split where split > 0) s
on g.cell = s.cell""", ["g", "split"])
def assemble_split_map(spark, d):
    s = X.split(spark, d)
    part = lambda k: s.where(F.col("split") == k).select("cell")
    return sampling.assemble_split_map(
        X.g(spark, d), part(1), part(2), part(3)).select("cell", "split")


@query("dedupe_geometry", """
select distinct l_partkey as x, l_suppkey as y from lineitem""")
def dedupe_geometry(spark, d):
    points = X.table(spark, d, "lineitem").select(
        F.struct(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y")).alias("geometry"))
    return joins.dedupe_geometry(points, "geometry").select("geometry.x", "geometry.y")


# --- 2.8 scalar functions --------------------------------------------------------

@query("lon_wrap", """
select l_orderkey, l_linenumber, l_extendedprice,
       (l_extendedprice / 100 + 180.0) % 360.0 - 180.0 as lon from lineitem""")
def lon_wrap(spark, d):
    return X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        S.lon_wrap(F.col("l_extendedprice") / 100).alias("lon"))


@query("tile_name", """
select c_custkey, (case when c_custkey % 140 >= 70 then 'N' else 'S' end)
  || lpad(cast(abs(c_custkey % 140 - 70) as varchar), 2, '0')
  || (case when c_custkey % 360 >= 180 then 'E' else 'W' end)
  || lpad(cast(abs(c_custkey % 360 - 180) as varchar), 3, '0') as tile from customer""")
def tile_name(spark, d):
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(
        "c_custkey", S.tile_name(k % 140 - 70, k % 360 - 180).alias("tile"))


DIRECTION = """
select cell, date, hour, u, v, sqrt(u * u + v * v) as speed,
  case when sqrt(u * u + v * v) < 0.3 then 0.0
       when degrees(atan2(u, v)) + 180.0 <= 0 then 360.0
       else degrees(atan2(u, v)) + 180.0 end as direction from obs_hourly"""


@query("wind_from_uv", f"""
select cell, date, hour, round(speed, 6) as speed, round(direction, 6) as direction
from ({DIRECTION})""", ["obs_hourly"])
def wind_from_uv(spark, d):
    return X.obs_hourly(spark, d).select(
        "cell", "date", "hour", rnd(S.wind_speed("u", "v")).alias("speed"),
        rnd(S.wind_direction("u", "v")).alias("direction"))


@query("wind_cardinal", f"""
select cell, date, hour, case when direction = 0 then 8
  when direction <= 22.5 or direction > 337.5 then 0 when direction <= 67.5 then 1
  when direction <= 112.5 then 2 when direction <= 157.5 then 3 when direction <= 202.5 then 4
  when direction <= 247.5 then 5 when direction <= 292.5 then 6 else 7 end as code
from ({DIRECTION})""", ["obs_hourly"])
def wind_cardinal(spark, d):
    direction = F.nullif(S.wind_direction("u", "v"), F.lit(0.0))
    return X.obs_hourly(spark, d).select(
        "cell", "date", "hour", S.wind_cardinal(direction).alias("code"))


@query("unit_convert", """
select cell, date, round(t2m - 273.15, 6) as celsius, round(tp * 1000.0, 6) as mm,
  round(wind * 3.6, 6) as kmh, round(mx / 10.0, 6) as pga from obs_long""", ["obs_long"])
def unit_convert(spark, d):
    return X.obs_long(spark, d).select(
        "cell", "date", rnd(S.kelvin_to_celsius("t2m")).alias("celsius"),
        rnd(S.m_to_mm("tp")).alias("mm"), rnd(S.ms_to_kmh("wind")).alias("kmh"),
        rnd(S.tenth("mx")).alias("pga"))


def es_sql(t):
    return (f"(100.0 * exp(-6096.9385 / {t} + 16.635794 + -2.711193e-2 * {t}"
            f" + 1.673952e-5 * {t} * {t} + 2.433502 * ln({t})))")


@query("rel_humidity", f"""
select cell, date, round(least(greatest({es_sql('dew')} / {es_sql('t2m')} * 100.0, 0.0), 100.0), 4)
  as hurs from (select *, t2m - wind as dew from obs_long)""", ["obs_long"])
def rel_humidity(spark, d):
    df = X.obs_long(spark, d).withColumn("dew", F.col("t2m") - F.col("wind"))
    return df.select("cell", "date", rnd(S.rel_humidity("t2m", "dew"), 4).alias("hurs"))


@query("date_parts", """
select event_id, cast(year(ts) as integer) as year, cast(ts as date) as day,
  cast(strptime(strftime(ts, '%d-%m-%Y'), '%d-%m-%Y') as date) as parsed from events""")
def date_parts(spark, d):
    text = F.date_format("ts", "dd-MM-yyyy")
    return X.table(spark, d, "events").select(
        "event_id", F.year("ts").alias("year"), F.to_date(F.date_trunc("day", "ts")).alias("day"),
        F.to_date(text, "dd-MM-yyyy").alias("parsed"))


@query("vei_radius", """
select s_suppkey, round(coalesce(3.0408 * exp(0.6956 * nullif(s_nationkey % 7, 0)), 0.01), 6)
  as km from supplier""")
def vei_radius(spark, d):
    vei = F.nullif(F.col("s_nationkey") % 7, F.lit(0))
    return X.table(spark, d, "supplier").select(
        "s_suppkey", rnd(S.vei_radius(vei)).alias("km"))


@query("log1p", "select cell, round(ln(1 + v), 9) as v from g", ["g"])
def log1p(spark, d):
    return X.g(spark, d).select("cell", rnd(F.log1p("v"), 9).alias("v"))


@query("minmax_scale", """
select cell, (v - (select min(v) from g_missing)) /
  ((select max(v) from g_missing) - (select min(v) from g_missing)) as v,
  case when n is null then null else cast(0 as double) end as flat
from g_missing""", ["g_missing"])
def minmax_scale(spark, d):
    df = X.g_missing(spark, d).withColumn("flat", F.when(F.col("n").isNotNull(), 3.0))
    return scaling.minmax_scale(df, ["v", "flat"]).select("cell", "v", "flat")


@query("standard_scale", """
select cell, round((v - (select avg(v) from g_missing)) / (select stddev_pop(v) from g_missing), 6)
  as v from g_missing""", ["g_missing"])
def standard_scale(spark, d):
    return scaling.standard_scale(X.g_missing(spark, d), ["v"]).select(
        "cell", rnd("v").alias("v"))


@query("label_encode", """
select o_orderkey, cast(dense_rank() over (order by o_orderpriority) - 1 as integer) as code
from orders""")
def label_encode(spark, d):
    return scaling.label_encode(X.table(spark, d, "orders"), "o_orderpriority").select(
        "o_orderkey", "code")


@query("code_first_seen", """
select o.o_orderkey, k.code from orders o join (
  select o_custkey, cast(row_number() over (order by first, o_custkey) as integer) as code
  from (select o_custkey, min(o_orderkey) as first from orders group by 1)) k
on o.o_custkey = k.o_custkey""")
def code_first_seen(spark, d):
    return scaling.code_first_seen(
        X.table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "code")


@query("code_sorted", """
select c_custkey, cast(dense_rank() over (order by c_mktsegment) as integer) as code
from customer""")
def code_sorted(spark, d):
    return scaling.code_sorted(X.table(spark, d, "customer"), "c_mktsegment").select(
        "c_custkey", "code")


YJ = """case when x >= 0 then case when l = 0 then ln(1 + x) else (pow(x + 1, l) - 1) / l end
  else case when l = 2 then -ln(1 - x) else -(pow(1 - x, 2 - l) - 1) / (2 - l) end end"""


def yeo_johnson_sql(passes=5):
    """The bracket of 17 exponents, narrowed to the neighbours of the best in each pass."""
    sql = "with x as (select cell, v / 1000 as x from g_missing),\ns0 as (select -2.0::double as lo, 2.0::double as hi),"
    for k in range(passes):
        sql += f"""
e{k} as (select i, lo + (hi - lo) / 16 * i as l from s{k}, range(17) r(i)),
b{k} as (select i from (select i, l, -count(*) / 2 * ln(var_pop({YJ})) + (l - 1)
  * sum(case when x >= 0 then ln(1 + x) else -ln(1 - x) end) as score
  from x, e{k} where x is not null group by 1, 2) order by score desc, i limit 1),
s{k + 1} as (select (select l from e{k} where i = greatest(0, b.i - 1)) as lo,
  (select l from e{k} where i = least(16, b.i + 1)) as hi,
  (select l from e{k} where i = b.i) as l from b{k} b),"""
    return sql.rstrip(",") + f"""
select cell, round({YJ}, 6) as transformed, round(l, 6) as lambda from x, s{passes}"""


@query("yeo_johnson", yeo_johnson_sql(), ["g_missing"])
def yeo_johnson(spark, d):
    df = X.g_missing(spark, d).withColumn("v", F.col("v") / 1000)
    return scaling.yeo_johnson(df, "v").select(
        "cell", rnd("transformed").alias("transformed"), rnd("lambda").alias("lambda"))


@query("target_scale", """
select cell, n / ((select max(n) from g_missing) + 1e-5) as scaled from g_missing
""", ["g_missing"])
def target_scale(spark, d):
    return scaling.target_scale(X.g_missing(spark, d), "n").select("cell", "scaled")


@query("segment_from_points", f"""
with s as ({STARTS}), e as ({ENDS}),
f as (select k1, k2, pos, y, row_number() over (partition by k1, k2 order by pos, y) as rn from e)
select s.k1, s.x as x1, s.k2 as y1, f.pos as x2, f.y as y2, 0 as intensity, 'm/s' as unit
from s join f on s.k1 = f.k1 and s.k2 = f.k2 and f.rn = 1""")
def segment_from_points(spark, d):
    from graticule.functions.geometry import segment
    start, end = starts_ends(spark, d)
    pairs = joins.match_first(start, end, ["k1", "k2"], ["pos", "y"], ["pos", "y"])
    lines = pairs.select(
        "k1", segment("x", "k2", "end_pos", "end_y").alias("line"),
        F.lit(0).alias("intensity"), F.lit("m/s").alias("unit"))
    at = F.col("line")
    return lines.select(
        "k1", at[0]["x"].alias("x1"), at[0]["y"].cast("long").alias("y1"),
        at[1]["x"].cast("long").alias("x2"), at[1]["y"].alias("y2"), "intensity", "unit")


@query("seq_id", """
select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) + 1324007 as id
from orders""")
def seq_id(spark, d):
    orders = X.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return ordered_rank(orders, ["o_orderdate", "o_orderkey"], "id", 1324008).select(
        "o_orderkey", "id")
