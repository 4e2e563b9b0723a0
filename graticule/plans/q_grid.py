"""Queries: neighbourhoods, resampling, distance, rasterising, terrain, drainage."""

from pyspark.sql import functions as F

from graticule.functions import geometry as G
from graticule.functions.scalar import vei_radius
from graticule.operators import distance, hydrology, rasterize, resample, terrain
from graticule.plans import fixtures as X
from graticule.plans.catalog import query, view


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def height(spark, d):
    return X.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0] // X.WIDTH + 1


# --- resolution -----------------------------------------------------------------

@query("upsample_repeat", """
select r * 3 + i as r, c * 3 + j as c, v from g, range(3) a(i), range(3) b(j)""", ["g"])
def upsample_repeat(spark, d):
    return resample.upsample_repeat(X.g(spark, d), 3, "v")


@query("downsample_bilinear", """
with s as (select (r + 0.5) / 10 - 0.5 as ra, (c + 0.5) / 10 - 0.5 as ca, v from g),
t as (select ra, ca, v, cast(floor(ra) as bigint) + i as r, cast(floor(ca) as bigint) + j as c
      from s, range(2) a(i), range(2) b(j)),
w as (select r, c, v, greatest(0, 1 - abs(ra - r)) * greatest(0, 1 - abs(ca - c)) as w from t)
select r, c, round(sum(w * v) / sum(w), 4) as v from w
where w > 0 and r >= 0 and c >= 0 and c < 15 and r < ((select max(r) from g) + 1) // 10
group by 1, 2""", ["g"])
def downsample_bilinear(spark, d):
    out = resample.downsample_bilinear(X.g(spark, d), 10, "v", height(spark, d), X.WIDTH)
    return rounded(out, "v", digits=4)


SOURCE_GRID, TARGET_GRID = (0.0, 0.0, 1.0), (3.3141592, -2.7182818, 0.7071067)

CUBIC = """case when {t} <= 1 then (1.5 * {t} - 2.5) * {t} * {t} + 1
 when {t} < 2 then ((-0.5 * {t} + 2.5) * {t} - 4) * {t} + 2 else 0.0 end"""
SPLINE = """case when {t} < 1 then (4 + {t} * {t} * (3 * {t} - 6)) / 6
 when {t} < 2 then (2 - {t}) * (2 - {t}) * (2 - {t}) / 6 else 0.0 end"""


def resample_sql(method, taps, weight):
    wx, wy = weight.format(t="abs(t.x - b.c)"), weight.format(t="abs(t.y - b.r)")
    lo = 1 - taps // 2 if taps > 1 else 0
    x, y = (f"floor(t.{v})" if taps > 1 else f"floor(t.{v} + 0.5)" for v in "xy")
    return f"""
select t.cell, '{method}' as method, round(sum({wx} * {wy} * b.v) / sum({wx} * {wy}), 3) as v
from t, range({taps}) p(i), range({taps}) q(j), g b
where b.r = cast({y} as bigint) + i + {lo}
  and b.c = cast({x} as bigint) + j + {lo}
group by 1, 2 having max(cast(b.r = floor(t.y + 0.5) and b.c = floor(t.x + 0.5) as int)) = 1"""


@query("resample_grid", """
with t as (select cell, (3.3141592::double + (c + 0.5::double) * 0.7071067::double - 0.0) / 1.0 - 0.5 as x,
  (0.0::double - (-2.7182818::double - (r + 0.5::double) * 0.7071067::double)) / 1.0 - 0.5 as y from g)""" + " union all ".join([
    resample_sql("nearest", 1, "1.0"),
    resample_sql("bilinear", 2, "greatest(0.0, 1 - {t})"),
    resample_sql("cubic", 4, CUBIC),
    resample_sql("cubic_spline", 4, SPLINE)]), ["g"])
def resample_grid(spark, d):
    g = X.g(spark, d)
    parts = [
        resample.resample_grid(g, g, m, SOURCE_GRID, TARGET_GRID, "v").select(
            "cell", F.lit(m).alias("method"), F.round("v", 3).alias("v"))
        for m in resample.KERNELS]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("resample_coarse", """
with t as (select r as tr, c as tc, 4 * c + 1.8137 as x, 4 * r + 1.7291 as y from g
  where r <= (select max(r) from g) // 4 and c < 37),
n as (select tr, tc, b.v, greatest(0.0, 1 - abs(t.x - b.c) / 4) * greatest(0.0, 1 - abs(t.y - b.r) / 4) as w,
  b.c = floor(t.x + 0.5) and b.r = floor(t.y + 0.5) as own
  from t join g b on b.c > t.x - 4 and b.c < t.x + 4 and b.r > t.y - 4 and b.r < t.y + 4)
select tr as r, tc as c, round(sum(w * v) / sum(w), 3) as v from n group by 1, 2
having max(cast(own as int)) = 1""", ["g"])
def resample_coarse(spark, d):
    # a target four times as coarse: the kernel is widened, so all source cells count
    g = X.g(spark, d)
    target = g.where((F.col("r") <= F.floor(F.lit(height(spark, d) - 1) / 4)) & (F.col("c") < 37))
    out = resample.resample_grid(g, target, "bilinear", (0.0, 0.0, 1.0), (0.3137, -0.2291, 4.0), "v")
    return out.select("r", "c", F.round("v", 3).alias("v"))


# --- distance --------------------------------------------------------------------

@query("nearest_distance", """
select a.cell, round(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))), 6)
  as distance
from g a, (select r, c from g where y = 1) b group by 1""", ["g"])
def nearest_distance(spark, d):
    grid = X.g(spark, d).withColumn("hit", F.col("y") == 1)
    return rounded(distance.nearest_distance(grid, "hit"), "distance").select("cell", "distance")


@query("nearest_distance_gaps", """
with k as (select * from g where cell % 7 <> 3 and c % 11 <> 5)
select a.cell, round(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))), 6)
  as distance
from k a, (select r, c from k where y = 1) b group by 1""", ["g"])
def nearest_distance_gaps(spark, d):
    grid = X.g(spark, d).where("cell % 7 <> 3 and c % 11 <> 5").withColumn("hit", F.col("y") == 1)
    return rounded(distance.nearest_distance(grid, "hit"), "distance").select("cell", "distance")


view("weights", """
select cell, nbr, rk from (select a.cell, b.cell as nbr, cast(row_number() over (partition by a.cell
  order by x.dr * x.dr + w.dc * w.dc, x.dr, w.dc) as integer) as rk
  from g a, unnest([-3, -2, -1, 0, 1, 2, 3]) as x(dr), unnest([-3, -2, -1, 0, 1, 2, 3]) as w(dc), g b
  where b.r = a.r + x.dr and b.c = a.c + w.dc and (x.dr <> 0 or w.dc <> 0)
    and x.dr * x.dr + w.dc * w.dc <= 9) where rk <= 8""", ["g"])


@query("knn_coords", "select cell, nbr, rk as rank, cast(0.125 as double) as w from weights", ["weights"])
def knn_coords(spark, d):
    return distance.knn_coords(X.g(spark, d), 8, X.WIDTH)


# --- rasterising -------------------------------------------------------------------

def shapes(spark, d):
    """One box or diamond per supplier."""
    t = X.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("kind"),
        (F.col("s_suppkey") * 37 % 150 + 0.3).alias("cx"),
        (F.col("s_suppkey") * 53 % 100 + 0.4).alias("cy"),
        (F.abs("s_acctbal") / 1000 + 2.00123457).alias("s"))
    x, y, s = F.col("cx"), F.col("cy"), F.col("s")
    ring = lambda *pts: F.array(*[G.corner(a, b) for a, b in pts])
    box = ring((x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s), (x - s, y - s))
    diamond = ring((x, y - s), (x + s, y), (x, y + s), (x - s, y), (x, y - s))
    return t.withColumn("rings", F.array(F.when(F.col("id") % 2 == 0, box).otherwise(diamond)))


view("shapes", """
select s_suppkey as id, s_nationkey as kind, s_suppkey * 37 % 150 + 0.3::double as cx,
  s_suppkey * 53 % 100 + 0.4::double as cy, abs(s_acctbal) / 1000 + 2.00123457 as s
from supplier""")

INSIDE = """(case when id % 2 = 0
  then abs(c + 0.5 - cx) <= s and abs(r + 0.5 - cy) <= s
  else abs(c + 0.5 - cx) + abs(r + 0.5 - cy) <= s end)"""
GAPX, GAPY = "greatest(c - cx, cx - (c + 1), 0.0)", "greatest(r - cy, cy - (r + 1), 0.0)"
TOUCHED = f"""(case when id % 2 = 0 then {GAPX} <= s and {GAPY} <= s
  else {GAPX} + {GAPY} <= s end)"""


@query("rasterize_mask", f"select distinct r, c from shapes, g where {TOUCHED}", ["shapes", "g"])
def rasterize_mask(spark, d):
    return rasterize.rasterize_mask(shapes(spark, d), ["id"], height(spark, d), X.WIDTH)


@query("rasterize_count", f"""
select r, c, count(*) as n from shapes, g where {INSIDE} group by 1, 2""", ["shapes", "g"])
def rasterize_count(spark, d):
    return rasterize.rasterize_count(shapes(spark, d), ["id"], height(spark, d), X.WIDTH)


@query("rasterize_class", f"""
select r, c, arg_max(kind, id) as kind from shapes, g where {INSIDE} group by 1, 2""",
       ["shapes", "g"])
def rasterize_class(spark, d):
    return rasterize.rasterize_class(
        shapes(spark, d), ["id"], "kind", "id", height(spark, d), X.WIDTH)


LEFT, TOP, RES = -25.0, 72.0, 0.05


@query("buffer_count", f"""
with p as (select s_suppkey, {TOP} - (s_suppkey * 53 % 100) * {RES} as lat,
  {LEFT} + (s_suppkey * 37 % 150) * {RES} as lon,
  coalesce(3.0408 * exp(0.6956 * nullif(s_nationkey % 7, 0)), 0.01) as km from supplier),
e as (select cell, r, c, {TOP} - (r + 0.5) * {RES} as y, {LEFT} + (c + 0.5) * {RES} as x from g)
select r, c, count(*) as n from p, e
where 12742.0176 * asin(sqrt(least(pow(sin(radians(y - lat) / 2), 2)
  + cos(radians(lat)) * cos(radians(y)) * pow(sin(radians(x - lon) / 2), 2), 1.0))) <= km
group by 1, 2""", ["g"])
def buffer_count(spark, d):
    k = F.col("s_suppkey")
    points = X.table(spark, d, "supplier").select(
        "s_suppkey", (F.lit(TOP) - (k * 53 % 100) * RES).alias("lat"),
        (F.lit(LEFT) + (k * 37 % 150) * RES).alias("lon"),
        vei_radius(F.nullif(F.col("s_nationkey") % 7, F.lit(0))).alias("km"))
    return rasterize.buffer_count(
        points, ["s_suppkey"], "lat", "lon", "km", (LEFT, TOP, RES), height(spark, d), X.WIDTH)


@query("line_buffer", """
with l as (select id, cx as x1, cy as y1, s * 2 - 5 as dx, s - 8 as dy from shapes),
t as (select id, r, c, c + 0.5 - x1 as px, r + 0.5 - y1 as py, dx, dy,
  greatest(0.0, least(1.0, ((c + 0.5 - x1) * dx + (r + 0.5 - y1) * dy) / (dx * dx + dy * dy))) as t
  from l, g)
select id, r, c from t
where (px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy) <= 1.37 * 1.37""",
       ["shapes", "g"])
def line_buffer(spark, d):
    x, y, s = F.col("cx"), F.col("cy"), F.col("s")
    lines = shapes(spark, d).select("id", F.array(
        G.segment(x, y, x + s * 2 - 5, y + s - 8)).alias("rings"))
    return rasterize.line_buffer(lines, ["id"], 1.37, height(spark, d), X.WIDTH)


@query("polygon_centroid", """
select id, round(cx + s / 3, 6) as x, round(cy + 2 * s / 3, 6) as y from shapes""", ["shapes"])
def polygon_centroid(spark, d):
    x, y, s = F.col("cx"), F.col("cy"), F.col("s")
    ring = F.array(G.corner(x, y), G.corner(x + s, y), G.corner(x, y + 2 * s), G.corner(x, y))
    out = shapes(spark, d).select("id", G.centroid(ring).alias("p"))
    return rounded(out.select("id", "p.x", "p.y"), "x", "y")


# --- terrain ------------------------------------------------------------------------

NINE = """
select a.cell, a.r, a.c, a.z, x.dr, w.dc, coalesce(b.z, a.z) as nz, b.z as bz
from dem a cross join unnest([-1, 0, 1]) as x(dr) cross join unnest([-1, 0, 1]) as w(dc)
left join dem b on b.r = a.r + x.dr and b.c = a.c + w.dc"""
view("nine", NINE, ["dem"])
view("horn", """
select cell, sum(dc * (case when dr = 0 then 2 else 1 end) * nz) / 8 as dx,
  sum(dr * (case when dc = 0 then 2 else 1 end) * nz) / 8 as dy from nine group by 1""", ["nine"])


@query("terrain_slope", "select cell, round(sqrt(dx * dx + dy * dy), 6) as slope from horn", ["horn"])
def terrain_slope(spark, d):
    return rounded(terrain.terrain_slope(X.dem(spark, d)), "slope").select("cell", "slope")


@query("terrain_aspect", """
select cell, case when dx <> 0 or dy <> 0 then round(case when degrees(atan2(-dx, dy)) < 0
  then degrees(atan2(-dx, dy)) + 360 else degrees(atan2(-dx, dy)) end, 5) end as aspect
from horn""", ["horn"])
def terrain_aspect(spark, d):
    return rounded(terrain.terrain_aspect(X.dem(spark, d)), "aspect", digits=5).select(
        "cell", "aspect")


@query("terrain_curvature", """
with k as (select cell, max(z) as z, max(nz) filter (dr = -1 and dc = 0) as n,
  max(nz) filter (dr = 1 and dc = 0) as s, max(nz) filter (dr = 0 and dc = -1) as w,
  max(nz) filter (dr = 0 and dc = 1) as e, sum(case when dr * dc <> 0 then -dr * dc * nz end) / -4
    as f from nine group by 1),
m as (select cell, (w + e) / 2 - z as d, (n + s) / 2 - z as ee, -f as f0, f, (e - w) / 2 as g,
  (n - s) / 2 as h from k)
select cell, round(-200 * (d + ee), 4) as curvature,
  round(case when g = 0 and h = 0 then 0 else
    200 * (d * g * g + ee * h * h + f0 * g * h) / (g * g + h * h) end, 4) as profile,
  round(case when g = 0 and h = 0 then 0 else
    -200 * (d * h * h + ee * g * g - f0 * g * h) / (g * g + h * h) end, 4) as planform
from m""", ["nine"])
def terrain_curvature(spark, d):
    out = terrain.terrain_curvature(X.dem(spark, d)).drop("r", "c")
    return rounded(out, "curvature", "profile", "planform", digits=4)


view("flow", """
select cell, case when drop > 0 then cast(1 << k as bigint) end as direction,
  case when drop > 0 then cell + dr * 150 + dc end as parent
from (select *, row_number() over (partition by cell order by drop desc, k) as rn from (
  select n.cell, n.dr, n.dc, s.k, coalesce((n.z - n.bz) / sqrt(n.dr * n.dr + n.dc * n.dc),
    cast('-inf' as double)) as drop
  from nine n join (values (0, 1, 0), (1, 1, 1), (1, 0, 2), (1, -1, 3), (0, -1, 4), (-1, -1, 5),
    (-1, 0, 6), (-1, 1, 7)) s(dr, dc, k) on n.dr = s.dr and n.dc = s.dc)) where rn = 1""", ["nine"])


@query("flow_direction", "select cell, direction, parent from flow", ["flow"])
def flow_direction(spark, d):
    return terrain.flow_direction(X.dem(spark, d), "z", X.WIDTH).select(
        "cell", "direction", "parent")


def flow(spark, d):
    return terrain.flow_direction(X.dem(spark, d), "z", X.WIDTH)


@query("fill_depressions", """
with recursive near as materialized (
  select cell, z, cell + dr * 150 + dc as other from nine where bz is not null
    and (dr <> 0 or dc <> 0)),
edge as (select cell, z from near group by 1, 2 having count(*) < 8),
fill(cell, w) using key (cell) as (
  select cell, z from edge
  union
  select x.cell, x.w from (select n.cell, min(greatest(n.z, f.w)) as w
    from fill f join near n on n.other = f.cell group by 1) x
  left join recurring.fill r on r.cell = x.cell where r.cell is null or x.w < r.w)
select d.cell, d.z, fill.w as filled from dem d join fill on d.cell = fill.cell""", ["nine"])
def fill_depressions(spark, d):
    return hydrology.fill_depressions(X.dem(spark, d)).select("cell", "z", "filled")


PATHS = """
with recursive net as materialized (select cell, parent from flow),
up(cell, spot) as (select cell, cell from net union all
  select up.cell, net.parent from up join net on up.spot = net.cell
  where net.parent is not null) """


@query("flow_accumulation", PATHS + """
select spot as cell, cast(count(*) as double) as upstream from up group by 1""", ["flow"])
def flow_accumulation(spark, d):
    return hydrology.flow_accumulation(flow(spark, d))


@query("basins", PATHS + """
select up.cell, up.spot as outlet from up join net on up.spot = net.cell
where net.parent is null""", ["flow"])
def basins(spark, d):
    return hydrology.basins(flow(spark, d))


@query("stream_cells", PATHS + """
select net.cell, net.parent, a.upstream from net join
  (select spot as cell, cast(count(*) as double) as upstream from up group by 1) a
on net.cell = a.cell where a.upstream > 4""", ["flow"])
def stream_cells(spark, d):
    f = flow(spark, d)
    return hydrology.stream_cells(f, hydrology.flow_accumulation(f), 4)


@query("strahler", PATHS + """
, area as (select spot as cell, count(*) as upstream from up group by 1),
s as materialized (select net.cell, net.parent from net join area a on net.cell = a.cell
  where a.upstream > 2),
ord(cell, k) using key (cell) as (
  select cell, 1 from s
  union
  select p.cell, p.k from (
    select t.parent as cell, case when t.l[1] = t.l[2] then t.l[1] + 1 else t.l[1] end as k
    from (select s.parent, list_reverse_sort(list(r.k)) as l
      from (select distinct c.parent from ord o join s c on c.cell = o.cell) q
      join s on s.parent = q.parent join recurring.ord r on r.cell = s.cell group by 1) t) p
  join recurring.ord r on r.cell = p.cell where p.k > r.k)
select cell, k as strahler from ord""", ["flow"])
def strahler(spark, d):
    f = flow(spark, d)
    return hydrology.strahler(hydrology.stream_cells(f, hydrology.flow_accumulation(f), 2, carry=("r", "c")))


@query("drainage_chain", """
select count(*) as n_cells, cast(0 as bigint) as inner_outlets,
  round(sum(radians(0.1::double) * 6371.0088::double * 6371.0088
    * (sin(radians(60.0::double - r * 0.1::double)) - sin(radians(60.0::double - (r + 1) * 0.1::double)))), 3)
    as outlet_km2, count(*) as drained_cells, true as orders_grow
from dem""", ["dem"])
def drainage_chain(spark, d):
    """Everything drains over the edge, and the areas at the outlets add up to the whole."""
    rows = height(spark, d)
    flow, upstream, outlets, streams = hydrology.drainage(
        X.dem(spark, d), "z", X.WIDTH, top=60.0, resolution=0.1, limit=300.0)
    inner = F.col("r").between(1, rows - 2) & F.col("c").between(1, X.WIDTH - 2)
    ends = flow.where(F.col("parent").isNull())
    below = streams.select(F.col("cell").alias("parent"), F.col("strahler").alias("next"))
    falling = streams.join(below, "parent").where(F.col("next") < F.col("strahler"))
    return flow.agg(F.count(F.lit(1)).alias("n_cells")).select(
        "n_cells", ends.agg(F.count_if(inner)).scalar().alias("inner_outlets"),
        ends.join(upstream, "cell").agg(F.round(F.sum("upstream_km2"), 3)).scalar().alias("outlet_km2"),
        outlets.where(F.col("outlet").isNotNull()).agg(F.count(F.lit(1))).scalar().alias("drained_cells"),
        F.lit(falling.isEmpty()).alias("orders_grow"))
