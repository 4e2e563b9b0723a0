"""Stream order over tiles, solved inside each tile and on the graph of what crosses them.

Inside a tile the order of a cell is known unless water of another tile passes it.  Of
the others only those stay that such water enters, or where two such ways meet; a chain
between two of them becomes a step function from the order at its start to the order at
its end.  What stays is put into tiles eight times as wide and contracted again, until no
water comes from outside.  Then the orders go back down, tile by tile.

The stream cells are read twice, however many orders there are and however long the paths
are; what goes up is bounded by the rims, and rounds grow with the logarithm of the width.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.operators.focal import TILE
from graticule.operators.rims import _downhill, _numbers
from graticule.session import discard, stored

HIGHEST = 255  # an order n takes 2 ** (n - 1) springs
WIDER = 8
NODES = ("cell bigint, r bigint, c bigint, up bigint, up_r bigint, up_c bigint, "
         "m bigint, k bigint, w bigint, outer bigint, steps binary")
NAMES = [x.split()[0] for x in NODES.split(", ")]
SAME = np.arange(HIGHEST + 1, dtype="uint8")


def _order(m, k):
    """Order below children of which ``k`` have the largest order ``m`` (0: a spring)."""
    return np.where(m == 0, 1, m + (k >= 2))


def _arrive(m, k, into, orders, weights):
    """Children of the given orders come to the cells ``into``."""
    before = m[into]
    np.maximum.at(m, into, orders)
    k[into[m[into] > before]] = 0
    top = orders == m[into]
    np.add.at(k, into[top], weights[top])


class _Tile:
    """Nodes of a tile as arrays; a cell that comes twice counts as two branches."""

    def __init__(self, table):
        columns = dict(zip(NAMES[:-1], _numbers(table, *NAMES[:-1])))
        _, first, times = np.unique(columns["cell"], return_index=True, return_counts=True)
        for name, values in columns.items():
            setattr(self, name, values[first].copy())
        self.w *= times
        steps = table.column("steps").to_pylist()
        self.steps = np.stack([SAME if steps[i] is None else np.frombuffer(steps[i], "uint8") for i in first])
        self.below, self.waves = _downhill(self.cell, self.up)
        self.far = (self.below < 0) & (self.up_r != np.iinfo("int64").min)

    def settle(self, wave, orders):
        """Orders of the cells of a wave reach the cells below them in the tile."""
        if orders.max(initial=0) >= HIGHEST:
            raise ValueError("stream orders are too high")
        inside = self.below[wave] >= 0
        at = wave[inside]
        _arrive(self.m, self.k, self.below[at], self.steps[at, orders[inside]].astype("int64"), self.w[at])


def _contracted(table):
    """Open nodes of a tile (w > 0), and the known orders that leave it (w = 0) for the cell they enter."""
    t = _Tile(table)
    entered, ways = t.outer > 0, np.zeros(len(t.cell), "int64")
    is_open = entered.copy()
    for wave in t.waves:
        shut = wave[~is_open[wave]]
        t.settle(shut, _order(t.m[shut], t.k[shut]))
        more = t.below[wave[is_open[wave]]]
        more = more[more >= 0]
        is_open[more] = True
        np.add.at(ways, more, 1)
    keep = entered | (ways >= 2)
    for wave in reversed(t.waves):
        wave = wave[is_open[wave] & (t.below[wave] >= 0)]
        stop = wave[keep[t.below[wave]]]
        to = t.below[stop]
        t.up[stop], t.up_r[stop], t.up_c[stop] = t.cell[to], t.r[to], t.c[to]
        go = wave[~keep[t.below[wave]]]
        to = t.below[go]
        x, m = t.steps[go].astype("int64"), t.m[to][:, None]
        after = np.where(x > m, x + (t.w[go] >= 2)[:, None], np.where(
            x == m, m + 1, _order(t.m[to], t.k[to])[:, None]))
        t.steps[go] = np.take_along_axis(t.steps[to], np.minimum(after, HIGHEST), axis=1)
        t.w[go], t.up[go], t.up_r[go], t.up_c[go] = t.w[to], t.up[to], t.up_r[to], t.up_c[to]
    stay, leave = np.flatnonzero(keep), np.flatnonzero(~is_open & t.far)
    gone = t.steps[leave, _order(t.m[leave], t.k[leave])].astype("int64")
    none = np.full(len(leave), np.iinfo("int64").min)
    both = lambda a, b: np.concatenate([a, b])
    columns = {
        "cell": both(t.cell[stay], t.up[leave]), "r": both(t.r[stay], t.up_r[leave]),
        "c": both(t.c[stay], t.up_c[leave]), "up": both(t.up[stay], none),
        "up_r": both(t.up_r[stay], none), "up_c": both(t.up_c[stay], none),
        "m": both(t.m[stay], gone), "k": both(t.k[stay], t.w[leave]),
        "w": both(t.w[stay], np.zeros(len(leave), "int64")),
    }
    columns["outer"] = np.zeros(len(columns["cell"]), "int64")
    missing = np.iinfo("int64").min
    arrays = [pa.array(v, pa.int64(), mask=v == missing) for v in columns.values()]
    steps = [t.steps[i].tobytes() for i in stay] + [None] * len(leave)
    return pa.table([*arrays, pa.array(steps, pa.binary())], names=NAMES)


def _solved(table, known):
    """Orders of all nodes of a tile, given those of its open nodes."""
    if not table.num_rows:
        return pa.table({n: pa.array([], pa.int64()) for n in ("cell", "r", "c", "strahler")})
    t = _Tile(table)
    given = np.zeros(len(t.cell), "int64")
    given[np.searchsorted(t.cell, known.column("cell").to_numpy())] = known.column("strahler").to_numpy()
    orders = given.copy()
    for wave in t.waves:
        orders[wave] = np.where(given[wave] > 0, given[wave], _order(t.m[wave], t.k[wave]))
        t.settle(wave, orders[wave])
    return pa.table({"cell": t.cell, "r": t.r, "c": t.c, "strahler": orders})


def _place(r, c, size, tile):
    """Tile of a cell; wider ones are shifted, so that in the end one holds all."""
    shift = size // WIDER if size > tile else 0
    return [F.floor((F.col(x) + shift) / size) for x in (r, c)]


def _first_nodes(streams, tile):
    """Stream cells as nodes, with the place of the cell below if it lies in another tile."""
    on_rim = lambda x: F.pmod(F.col(x), F.lit(tile)).isin(0, tile - 1)
    cells = streams.select(*[F.col(n).cast("bigint").alias(n) for n in ("cell", "r", "c")],
                           F.col("parent").cast("bigint").alias("up"))
    rim = on_rim("r") | on_rim("c")
    below = cells.where(rim).select(
        F.col("cell").alias("up"), F.col("r").alias("up_r"), F.col("c").alias("up_c")).dropDuplicates(["up"])
    new = [F.lit(0).cast("bigint").alias("m"), F.lit(0).cast("bigint").alias("k"), F.lit(1).cast("bigint").alias("w")]
    steps = F.lit(None).cast("binary").alias("steps")
    nodes = cells.where(rim).join(below, "up", "left").unionByName(
        cells.where(~rim), allowMissingColumns=True)
    return nodes.select("cell", "r", "c", "up", "up_r", "up_c", *new, steps)


def _entered(nodes, given, size, tile):
    """``nodes`` with the orders ``given`` to them, and whether others come from outside their tile."""
    here, there = _place("r", "c", size, tile), _place("up_r", "up_c", size, tile)
    crossing = nodes.where(F.col("up_r").isNotNull() & ((here[0] != there[0]) | (here[1] != there[1]))).select(
        F.col("up").alias("cell"), F.lit(0).cast("bigint").alias("gm"), F.lit(0).cast("bigint").alias("gk"),
        F.lit(1).cast("bigint").alias("outer"))
    if given is not None:
        crossing = crossing.unionByName(given.select(
            "cell", F.col("m").alias("gm"), F.col("k").alias("gk"), F.lit(0).cast("bigint").alias("outer")))
    come = crossing.groupBy("cell", "gm").agg(F.sum("gk").alias("gk"), F.max("outer").alias("outer")).groupBy(
        "cell").agg(F.max(F.struct("gm", "gk")).alias("g"), F.max("outer").alias("outer"))
    m, k = F.coalesce("g.gm", F.lit(0)), F.coalesce("g.gk", F.lit(0))
    columns = [F.col(n) for n in NAMES[:6]]
    return nodes.join(come, "cell", "left").select(
        *columns, F.greatest("m", m).alias("m"),
        F.when(F.col("m") > m, F.col("k")).when(F.col("m") < m, k).otherwise(F.col("k") + k).alias("k"),
        "w", F.coalesce("outer", F.lit(0)).cast("bigint").alias("outer"), "steps")


def tile_orders(streams: DataFrame, tile=TILE) -> DataFrame:
    """Stream order of each cell of a network (cell, parent, r, c) of neighbouring cells.

    A stream whose parent is not in the table ends there.
    """
    size, levels = tile, []
    nodes = stored(_entered(_first_nodes(streams, tile), None, size, tile))
    while True:
        levels.append((nodes, size))
        up = stored(nodes.groupBy(*_place("r", "c", size, tile)).applyInArrow(_contracted, NODES))
        left = up.where("w > 0")
        if left.isEmpty():
            break
        size *= WIDER
        nodes = stored(_entered(left.drop("outer"), up.where("w = 0"), size, tile))
        discard(up)
    discard(up)
    orders = streams.sparkSession.createDataFrame([], "cell bigint, r bigint, c bigint, strahler bigint")
    for nodes, size in reversed(levels):
        by = _place("r", "c", size, tile)
        orders = stored(nodes.groupBy(*by).cogroup(orders.groupBy(*by)).applyInArrow(
            _solved, "cell bigint, r bigint, c bigint, strahler bigint"))
        discard(nodes)
    return orders.select("cell", F.col("strahler").cast("int").alias("strahler"))
