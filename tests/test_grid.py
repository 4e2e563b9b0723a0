"""Neighbourhood, distance and drainage operators against brute force, with gaps and small tiles."""

import heapq

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from graticule.operators import distance, focal, hydrology, rasterize, terrain
from graticule.functions import geometry as G

H, W = 19, 23


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(5)
    r, c = np.divmod(np.arange(H * W), W)
    return pd.DataFrame({"cell": r * W + c, "r": r, "c": c, "z": rng.integers(0, 60, H * W) * 1.0,
                         "split": rng.choice([0, 1, 2, 3], H * W, p=[0.1, 0.5, 0.2, 0.2])})


def gaps(grid):
    return grid[(grid["cell"] * 7 % 11) != 3]


def test_patches_with_gaps(spark, grid):
    part = gaps(grid)
    got = focal.patch_extract(spark.createDataFrame(part), ["z"], 5, tile=4).toPandas()
    dense = np.zeros((H + 4, W + 4))
    dense[part["r"] + 2, part["c"] + 2] = part["z"]
    assert len(got) == len(part)
    for row in got.itertuples():
        assert list(row.z) == list(dense[row.r:row.r + 5, row.c:row.c + 5].ravel())


@pytest.mark.parametrize("train", [False, True])
def test_erosion_with_gaps(spark, grid, train):
    part = gaps(grid)
    got = focal.erode_borders(
        spark.createDataFrame(part), "split", 3, H, W, erode_train=train, tile=5).toPandas()
    code = np.zeros((H, W), int)
    code[part["r"], part["c"]] = part["split"]
    for row in got.itertuples():
        own = code[row.r, row.c]
        edge = row.r in (0, H - 1) or row.c in (0, W - 1)
        near = code[max(row.r - 1, 0):row.r + 2, max(row.c - 1, 0):row.c + 2]
        clash = ((near != 0) & (near != own)).any()
        keep = (own == 1 and not train) or not (edge or clash)
        assert row.split == (own if keep else 0)
    # no kept validation or test cell sees another split
    if train:
        assert (got["split"] > 0).any()


def test_distance(spark, grid):
    df = spark.createDataFrame(grid).withColumn("hit", F.col("z") > 57)
    got = distance.nearest_distance(df, "hit").toPandas()
    hits = grid[grid["z"] > 57][["r", "c"]].to_numpy()
    for row in got.itertuples():
        want = np.sqrt(((hits - [row.r, row.c]) ** 2).sum(axis=1)).min()
        assert abs(row.distance - want) < 1e-12


def test_distance_without_features(spark, grid):
    df = spark.createDataFrame(grid).withColumn("hit", F.lit(False))
    assert distance.nearest_distance(df, "hit").where("distance is not null").count() == 0


def test_nearest_cells_with_gaps(spark, grid):
    part = grid[(grid["r"] < 3) | ((grid["cell"] % 9) == 0)]
    got = distance.knn_coords(spark.createDataFrame(part), 8, W, radius=1, tile=4).toPandas()
    points = part[["cell", "r", "c"]].to_numpy()
    near = got.sort_values("rank").groupby("cell")["nbr"].apply(list)
    assert len(near) == len(part)
    for cell, r, c in points:
        order = sorted(((rr - r) ** 2 + (cc - c) ** 2, rr - r, cc - c, other)
                       for other, rr, cc in points if other != cell)
        assert near[cell] == [o[3] for o in order[:8]]


def neighbours(r, c, known):
    return [(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)
            if (a or b) and (r + a, c + b) in known]


def flooded(z):
    """Priority flood from the edge inwards."""
    level, heap = {}, []
    for (r, c), h in z.items():
        if len(neighbours(r, c, z)) < 8:
            level[r, c] = h
            heap.append((h, r, c))
    heapq.heapify(heap)
    while heap:
        h, r, c = heapq.heappop(heap)
        for n in neighbours(r, c, z):
            if n not in level:
                level[n] = max(z[n], h)
                heapq.heappush(heap, (level[n], *n))
    return level


def test_filling(spark, grid):
    part = grid[~grid["cell"].isin([100, 260])]
    got = hydrology.fill_depressions(spark.createDataFrame(part), tile=5).toPandas()
    want = flooded({(r, c): z for r, c, z in part[["r", "c", "z"]].itertuples(index=False)})
    assert {(x.r, x.c): x.filled for x in got.itertuples()} == want
    assert (got["filled"] >= got["z"]).all()


def test_filled_ground_drains(spark, grid):
    filled = hydrology.fill_depressions(spark.createDataFrame(grid), gradient=1e-4, tile=6)
    flow = terrain.flow_direction(filled.select("cell", "r", "c", F.col("filled").alias("z")), "z", W, tile=6)
    inner = flow.where(F.col("r").between(1, H - 2) & F.col("c").between(1, W - 2))
    assert inner.where("parent is null").count() == 0


def lake(n=17, seed=4):
    """Rough ground with two wide lakes that span many small tiles, and a gap."""
    rng = np.random.default_rng(seed)
    z = rng.integers(3, 9, (n, n)).astype(float)
    z[3:14, 2:13] = 2.0
    z[5:12, 4:8] = 1.0
    return pd.DataFrame([(r * n + c, r, c, z[r, c]) for r in range(n) for c in range(n)
                         if (r, c) != (8, 15)], columns=["cell", "r", "c", "z"])


def test_flats_drain_without_changed_heights(spark, grid):
    for ground, width in ((lake(), 17), (grid[["cell", "r", "c", "z"]], W)):
        df = spark.createDataFrame(ground)
        results = []
        for tile in (4, 64):
            filled = hydrology.fill_depressions(df, tile=tile)
            flow = terrain.flow_direction(filled, "filled", width, tile, flats=True).toPandas()
            results.append({x.cell: (None if pd.isna(x.parent) else int(x.parent)) for x in flow.itertuples()})
        assert results[0] == results[1]  # tiles make no difference
        want = flooded({(r, c): z for r, c, z in ground[["r", "c", "z"]].itertuples(index=False)})
        height = {r * width + c: level for (r, c), level in want.items()}
        for cell, parent in results[0].items():
            r, c = divmod(cell, width)
            around = [(r + dr) * width + c + dc for dr in (-1, 0, 1) for dc in (-1, 0, 1) if dr or dc]
            edge = any(n not in height or abs(n % width - c) > 1 for n in around)
            assert parent is not None or edge
            seen = {cell}
            while parent is not None:  # never uphill, never in a circle
                assert height[parent] <= height[cell] and parent not in seen
                seen.add(parent)
                cell, parent = parent, results[0][parent]


def test_one_flat_by_hand(spark):
    """A corridor between walls: out at the east end, walls push to the middle row."""
    rows = ["99999", "92222", "92222", "92222", "99999"]
    cells = [(r * 5 + c, r, c, float(x)) for r, line in enumerate(rows) for c, x in enumerate(line)]
    df = spark.createDataFrame(cells, "cell long, r long, c long, z double")
    flow = {x.cell: x.parent for x in terrain.flow_direction(df, "z", 5, 2, flats=True).collect()}
    assert flow[11] == 12 and flow[12] == 13 and flow[13] == 14 and flow[14] is None
    assert flow[6] == 12 and flow[16] == 12  # away from the walls first


def test_filling_long_ways(spark):
    """A spiral: the way out crosses every tile, and some pits are joined in many steps."""
    n = 20
    rng = np.random.default_rng(12)
    z = rng.integers(0, 50, (n, n)).astype(float)
    ground = pd.DataFrame([(r * n + c, r, c, z[r, c]) for r in range(n) for c in range(n)],
                          columns=["cell", "r", "c", "z"])
    for tile in (3, 7, 64):
        got = hydrology.fill_depressions(spark.createDataFrame(ground), tile=tile).toPandas()
        want = flooded({(r, c): h for r, c, h in ground[["r", "c", "z"]].itertuples(index=False)})
        assert {(x.r, x.c): x.filled for x in got.itertuples()} == want


def test_sums_over_tiles(spark, grid):
    filled = hydrology.fill_depressions(spark.createDataFrame(grid), tile=5)
    flow = terrain.flow_direction(filled, "filled", W, 5, flats=True)
    plain = flow.select("cell", "parent")
    for tile in (3, 8):
        got = {x.cell: x.upstream for x in hydrology.flow_accumulation(flow, tile=tile).collect()}
        assert got == {x.cell: x.upstream for x in hydrology.flow_accumulation(plain).collect()}
        ends = {x.cell: x.outlet for x in hydrology.basins(flow, tile=tile).collect()}
        assert ends == {x.cell: x.outlet for x in hydrology.basins(plain).collect()}


def orders_by_hand(links):
    """Strahler orders of (cell, parent) rows, cell by cell; a row that comes twice is two branches."""
    above, order = {}, {}
    for cell, parent in links:
        above.setdefault(parent, []).append(cell)

    def of(cell):
        if cell not in order:
            near = sorted((of(x) for x in above.get(cell, [])), reverse=True)
            order[cell] = 1 if not near else near[0] + (near.count(near[0]) > 1)
        return order[cell]

    return {cell: of(cell) for cell, _ in links}


def test_stream_orders_over_tiles(spark, monkeypatch):
    """Random trees on a grid; the cells are read twice, not once for each order and doubling."""
    monkeypatch.setattr(hydrology, "_doubling", None)
    rng = np.random.default_rng(8)
    n, links = 40, []
    for r in range(n):
        for c in range(n):
            dr, dc = [(1, -1), (1, 0), (1, 1), (0, 1)][rng.choice(4, p=[0.2, 0.2, 0.2, 0.4])]
            inside = r + dr < n and 0 <= c + dc < n
            links.append((r * n + c, (r + dr) * n + c + dc if inside else None, r, c))
    some = [x for x in links if rng.random() < 0.9 or x[1] is None]
    known = {x[0] for x in some}
    some = [(a, b if b in known else None, r, c) for a, b, r, c in some]
    twice = some + [x for x in some if x[0] % 97 == 5]
    for rows in (some, twice):
        want = orders_by_hand([x[:2] for x in rows])
        df = spark.createDataFrame(rows, "cell long, parent long, r long, c long")
        for tile in (3, 64) if rows is some else (5,):
            got = hydrology.strahler(df, tile=tile).collect()
            assert len(got) == len(want) and {x.cell: x.strahler for x in got} == want
    assert max(want.values()) > 3


def test_drainage(spark, grid):
    filled = hydrology.fill_depressions(spark.createDataFrame(grid), gradient=1e-4, tile=64)
    flow = terrain.flow_direction(filled.select("cell", "r", "c", F.col("filled").alias("z")), "z", W)
    flow = spark.createDataFrame(flow.toPandas().assign(w=2.0), "cell long, r long, c long, direction double, parent double, w double")
    flow = flow.withColumn("parent", F.nanvl("parent", F.lit(None).cast("double")).cast("long"))
    parent = {x.cell: x.parent for x in flow.collect()}
    upstream, outlet = dict.fromkeys(parent, 0), {}
    for cell in parent:
        at = cell
        while True:
            upstream[at] += 2
            if parent[at] is None:
                break
            at = parent[at]
        outlet[cell] = at
    got = hydrology.flow_accumulation(flow, "w").collect()
    assert {x.cell: x.upstream for x in got} == upstream
    assert {x.cell: x.outlet for x in hydrology.basins(flow).collect()} == outlet
    # order of each cell from its children, deepest first
    children = {}
    for cell, p in parent.items():
        children.setdefault(p, []).append(cell)

    def order(cell):
        below = sorted((order(k) for k in children.get(cell, [])), reverse=True)
        if not below:
            return 1
        return below[0] + (len(below) > 1 and below[0] == below[1])

    got = hydrology.strahler(flow).collect()
    assert {x.cell: x.strahler for x in got} == {c: order(c) for c in parent}


def test_cycle_is_reported(spark):
    flow = spark.createDataFrame([(1, 2), (2, 1)], "cell long, parent long")
    with pytest.raises(RuntimeError):
        hydrology._doubling(flow.selectExpr("cell", "parent as jump"), lambda s: s,
                            F.col("jump").isNotNull(), max_rounds=3)


def test_polygon_with_hole(spark):
    ring = lambda pts: [(float(x), float(y)) for x, y in pts]
    outer = ring([(1.2, 1.2), (8.7, 1.2), (8.7, 8.7), (1.2, 8.7), (1.2, 1.2)])
    hole = ring([(3.2, 3.2), (5.7, 3.2), (5.7, 5.7), (3.2, 5.7), (3.2, 3.2)])
    df = spark.createDataFrame([(1, [outer, hole])], "id int, rings array<array<struct<x:double,y:double>>>")
    got = {(x.r, x.c) for x in rasterize.rasterize_mask(df, ["id"], 12, 12, all_touched=False).collect()}
    inside = lambda v, a, b: a < v + 0.5 < b
    want = {(r, c) for r in range(12) for c in range(12)
            if inside(r, 1.2, 8.7) and inside(c, 1.2, 8.7)
            and not (inside(r, 3.2, 5.7) and inside(c, 3.2, 5.7))}
    assert got == want


def test_shape_reaching_over_the_raster(spark):
    ring = [(-5.0, -5.0), (30.0, -5.0), (30.0, 30.0), (-5.0, 30.0), (-5.0, -5.0)]
    df = spark.createDataFrame([(1, [ring])], "id int, rings array<array<struct<x:double,y:double>>>")
    assert rasterize.rasterize_mask(df, ["id"], 4, 6).count() == 24


def test_centroid_of_square(spark):
    ring = F.array(*[G.corner(F.lit(x), F.lit(y)) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2), (0, 0))])
    p = spark.range(1).select(G.centroid(ring).alias("p")).first()["p"]
    assert (p.x, p.y) == (2.0, 1.0)


def test_plane_slope_and_aspect(spark):
    rows = [(r * 9 + c, r, c, 3.0 * c) for r in range(9) for c in range(9)]
    df = spark.createDataFrame(rows, "cell long, r long, c long, z double")
    inner = F.col("r").between(1, 7) & F.col("c").between(1, 7)
    assert {round(x.slope, 9) for x in terrain.terrain_slope(df).where(inner).collect()} == {3.0}
    # the plane rises eastward, so it falls to the west
    assert {x.aspect for x in terrain.terrain_aspect(df).where(inner).collect()} == {270.0}


def test_point_marks_and_buffers_its_cell(spark):
    df = spark.createDataFrame([(1, [[(3.5, 2.5)]])], "id int, rings array<array<struct<x:double,y:double>>>")
    assert [tuple(x) for x in rasterize.rasterize_mask(df, ["id"], 9, 9).collect()] == [(2, 3)]
    near = rasterize.line_buffer(df, ["id"], 1.1, 9, 9).select("r", "c").collect()
    assert sorted(map(tuple, near)) == [(1, 3), (2, 2), (2, 3), (2, 4), (3, 3)]


def test_carried_columns(spark, grid):
    df = spark.createDataFrame(grid.assign(name=grid["cell"].astype(str)))
    got = focal.patch_extract(df, ["z"], 3, tile=6, carry=("name", "split")).toPandas()
    assert len(got) == len(grid) and (got["name"] == got["cell"].astype(str)).all()
    assert dict(zip(got["cell"], got["split"])) == dict(zip(grid["cell"], grid["split"]))


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "cubic_spline"])
@pytest.mark.parametrize("resolution", [0.35, 2.6])
def test_resampling_does_not_depend_on_tiles(spark, grid, method, resolution):
    from graticule.operators.resample import resample_grid

    source = spark.createDataFrame(gaps(grid))
    target = spark.createDataFrame(grid[["cell", "r", "c"]])
    run = lambda tile: {x.cell: round(x.z, 9) for x in resample_grid(
        source, target, method, (0.0, 0.0, 1.0), (1.3, -2.2, resolution), "z", tile).collect()}
    small, whole = run(5), run(1000)
    assert small == whole and len(whole) > 10
    # a constant stays constant
    flat = resample_grid(source.withColumn("z", F.lit(3.0)), target, method, (0.0, 0.0, 1.0),
                         (1.3, -2.2, resolution), "z", 5)
    assert {round(x.z, 9) for x in flat.collect()} == {3.0}
