"""Map algebra on long raster tables (ix, iy, value): one row per cell.

Neighbourhoods are built by scattering: every cell is sent to the cells around it and grouped there once.  That is one
shuffle with nothing collected, whatever the raster's shape or gaps.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.operators.components import connected_components
from meridion.operators.polyline import cumulative, moving_average
from meridion.operators.walks import along, follow
from meridion.session import materialize

# The eight neighbours (dy, dx) in the order that settles ties.
NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def bin_points(points: DataFrame, size: float, value: str = "v") -> DataFrame:
    """(ix, iy, h, n): mean and count of the points in each square."""
    at = lambda c: F.floor(F.col(c) / size).cast("long")
    return points.groupBy(at("x").alias("ix"), at("y").alias("iy")).agg(F.round(F.avg(value), 4).alias("h"), F.count("*").alias("n"))


def grid_to_cells(df: DataFrame, grid: str, *keys: str) -> DataFrame:
    """Nested rows of values to cells; rows are y."""
    return df.select(*keys, F.posexplode(grid).alias("iy", "row")).select(*keys, "iy", F.posexplode("row").alias("ix", "h"))


def cells_to_grid(cells: DataFrame, digits: int = 4, *keys: str) -> DataFrame:
    """Cells to nested rows, in order, rounded half to even."""
    rows = cells.groupBy(*keys, "iy").agg(F.array_sort(F.collect_list(F.struct("ix", F.bround("h", digits).alias("h")))).alias("r"))
    rows = rows.select(*keys, "iy", F.transform("r", lambda s: s["h"]).alias("row"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("iy", "row"))).alias("g")).select(*keys, F.transform("g", lambda s: s["row"]).alias("grid"))


def around(cells: DataFrame, value: str = "h", offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """(ix, iy, h, near): for each cell its neighbours as a map from their number to their value."""
    steps = F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).alias("dy"), F.lit(0).alias("dx")), *(F.struct(F.lit(k).alias("k"), F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx")) for k, (dy, dx) in enumerate(offsets or NEIGHBOURS)))
    sent = cells.select("ix", "iy", F.col(value).alias("h"), F.explode(steps).alias("s"))
    sent = sent.select((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), F.col("s.k").alias("k"), "h")
    met = sent.groupBy("ix", "iy").agg(F.max(F.when(F.col("k") == -1, F.col("h"))).alias("h"), F.map_from_entries(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "h")))).alias("near"))
    return met.where(F.col("h").isNotNull())


def downsample(cells: DataFrame, limit: int, width: int, height: int) -> DataFrame:
    s = -(-max(width, height) // limit)
    return cells.where((F.col("ix") % s == 0) & (F.col("iy") % s == 0)).withColumn("ix", F.expr(f"ix div {s}")).withColumn("iy", F.expr(f"iy div {s}"))


def resample_nearest(cells: DataFrame, size: int, to: int) -> DataFrame:
    """The value of the nearest of ``size`` nodes at each of ``to`` nodes per side."""
    spark = cells.sparkSession
    axis = spark.range(to).select(F.col("id").alias("t"), F.rint(F.col("id") / float(max(1, to - 1)) * (size - 1)).cast("long").alias("s"))
    x, y = axis.select(F.col("t").alias("tx"), F.col("s").alias("ix")), axis.select(F.col("t").alias("ty"), F.col("s").alias("iy"))
    return cells.join(F.broadcast(x), "ix").join(F.broadcast(y), "iy").select(F.col("tx").alias("ix"), F.col("ty").alias("iy"), "h")


def gradient(cells: DataFrame, step: float) -> DataFrame:
    """(ix, iy, h, gx, gy): central differences, one-sided where a neighbour is missing, else zero."""
    t = around(cells)
    part = lambda low, high: F.when(low.isNotNull() & high.isNotNull(), (high - low) / (2 * step)).when(high.isNotNull(), (high - F.col("h")) / step).when(low.isNotNull(), (F.col("h") - low) / step).otherwise(0.0)
    n = lambda k: F.try_element_at("near", F.lit(k))
    return t.select("ix", "iy", "h", part(n(3), n(4)).alias("gx"), part(n(1), n(6)).alias("gy"))


def slope(cells: DataFrame, step: float) -> DataFrame:
    return gradient(cells, step).withColumn("slope", F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))


def hillshade(cells: DataFrame, step: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Light on each cell in [0, 1]."""
    t = slope(cells, step)
    tilt, aspect = F.lit(math.pi / 2) - F.atan("slope"), F.atan2(-F.col("gx"), F.col("gy"))
    az, alt = F.radians(F.lit(azimuth)), F.radians(F.lit(altitude))
    light = F.sin(alt) * F.sin(tilt) + F.cos(alt) * F.cos(tilt) * F.cos(az - aspect)
    return t.select("ix", "iy", ((F.least(F.lit(1.0), F.greatest(F.lit(-1.0), light)) + 1) / 2).alias("shade"))


def flow_direction(cells: DataFrame) -> DataFrame:
    """(ix, iy, h, to_x, to_y): the neighbour with the largest drop (strictly above 0, ties by order), else itself."""
    drops = F.filter(F.transform(F.map_entries("near"), lambda e: F.struct((-(F.col("h") - e["value"])).alias("d"), e["key"].alias("k"))), lambda s: s["d"] < 0)
    best = F.array_min(drops)["k"]
    step = lambda i: F.coalesce(F.get(F.array(*(F.lit(o[i]) for o in NEIGHBOURS)), best), F.lit(0))
    return around(cells).select("ix", "iy", "h", (F.col("ix") + step(1)).alias("to_x"), (F.col("iy") + step(0)).alias("to_y"))


def flow_accumulation(flow: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(ix, iy, to_x, to_y, acc): how many cells drain through each, itself included.

    Iterative: in each round a cell's count moves twice as far as in the round before (pointers are doubled), so the
    number of rounds grows with the logarithm of the longest way.  Every cell adds what the cells 2^k steps up have.
    """
    base = flow.select("ix", "iy", "to_x", "to_y")
    moving = (F.col("ix") != F.col("to_x")) | (F.col("iy") != F.col("to_y"))
    jump = materialize(base.select("ix", "iy", F.when(moving, F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y"))).alias("to"), F.lit(1).cast("long").alias("acc")))
    for _ in range(max_rounds):
        if jump.where("to is not null").isEmpty():
            return base.join(jump.select("ix", "iy", "acc"), ["ix", "iy"])
        sent = jump.where("to is not null").groupBy(F.col("to.x").alias("ix"), F.col("to.y").alias("iy")).agg(F.sum("acc").alias("more"))
        onward = jump.select(F.col("ix").alias("nx"), F.col("iy").alias("ny"), F.col("to").alias("next"))
        moved = jump.join(onward, (F.col("to.x") == F.col("nx")) & (F.col("to.y") == F.col("ny")), "left").select("ix", "iy", F.col("next").alias("to"), "acc")
        jump = materialize(moved.join(sent, ["ix", "iy"], "left").select("ix", "iy", "to", (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")))
    raise RuntimeError("a cell drains into itself over others")


def river_mask(accumulated: DataFrame, share: float) -> DataFrame:
    """Cells through which at least this share of the largest count drains."""
    top = accumulated.agg((F.max("acc") * share).alias("least"))
    return accumulated.join(F.broadcast(top), F.col("acc") >= F.col("least")).drop("least")


def adaptive_threshold(accumulated: DataFrame, start: float, low: float = 0.1, high: float = 0.3, tries: int = 4) -> DataFrame:
    """(tries, threshold, coverage, fits): a share of the largest count at which between ``low`` and ``high`` of the cells are rivers.

    From ``start`` on it is lowered to three quarters where they cover too little and raised by 15 % (to 0.25 at most)
    where too much, ``tries`` times at most; each try is one pass over the counts.
    """
    acc = materialize(accumulated.select("acc"))
    top, threshold, n = acc.agg(F.max("acc")).head()[0] or 0, start, 0
    while True:
        covered = acc.agg(F.avg((F.col("acc") >= threshold * top).cast("double"))).head()[0] or 0.0
        if low <= covered <= high or n == tries:
            return accumulated.sparkSession.createDataFrame([(n, threshold, covered, low <= covered <= high)], "tries long, threshold double, coverage double, fits boolean")
        threshold, n = (max(1e-5, threshold * 0.75) if covered < low else min(0.25, threshold * 1.15)), n + 1


def trace_chains(rivers: DataFrame, min_cells: int = 2) -> DataFrame:
    """(head, seq, ix, iy, flow): from each river cell that no river cell drains into, down to the outlet.

    ``flow`` is what drains through the head.  Chains share their lower ways.
    """
    cell = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    t = materialize(rivers.select(cell("ix", "iy").alias("k"), cell("to_x", "to_y").alias("to"), "acc"))
    on = t.where("k <> to").select("k", "to").join(t.select(F.col("k").alias("to")), "to", "left_semi")
    heads = t.join(on.select(F.col("to").alias("k")).distinct(), "k", "left_anti").select(F.col("k").alias("walk"), "k", F.col("acc").alias("flow"))
    size = F.count("*").over(Window.partitionBy("walk"))
    walks = follow(on, heads).withColumn("n", size).where(F.col("n") >= min_cells)
    return walks.join(heads.select("walk", "flow"), "walk").select(F.col("walk").alias("head"), F.col("pos").alias("seq"), F.col("k.x").alias("ix"), F.col("k.y").alias("iy"), "flow")


def river_lines(rivers: DataFrame, step: float, min_length: float) -> DataFrame:
    """(head, seq, x, y, flow, length): chains as lines of cells ``step`` apart, smoothed over three points.

    Lines shorter than ``min_length`` after smoothing are left out.
    """
    by_line = Window.partitionBy("line_id")
    verts = trace_chains(rivers).select(F.col("head").alias("line_id"), "seq", (F.col("ix") * step).alias("x"), (F.col("iy") * step).alias("y"), "flow")
    smooth = moving_average(verts).join(verts.select("line_id", "seq", "flow"), ["line_id", "seq"])
    t = cumulative(smooth).withColumn("length", F.max("cum").over(by_line)).where(F.col("length") >= min_length)
    return t.select(F.col("line_id").alias("head"), "seq", "x", "y", "flow", "length")


def normalize(cells: DataFrame, value: str = "h") -> DataFrame:
    """Value to [0, 1] by its range; zeros if there is none."""
    r = cells.agg(F.min(value).alias("_low"), (F.max(value) - F.min(value)).alias("_span"))
    return cells.join(F.broadcast(r)).withColumn("norm", F.when(F.col("_span") < 1e-9, 0.0).otherwise((F.col(value) - F.col("_low")) / F.col("_span"))).drop("_low", "_span")


def terrain_class(height: Column, steep: Column, river: Column, extent: float) -> Column:
    """Code of normalised height and slope and the distance to water: the last class of this list that holds.

    1 plain, 2 rolling, 3 high hill, 4 mountain, 5 ridge, 0 floodplain.
    """
    near = river < max(55.0, extent * 0.04)
    rolling = (steep >= 0.18) & (steep < 0.36)
    hill = ((steep >= 0.36) & (steep < 0.58)) | ((height > 0.62) & (steep > 0.22))
    mountain = (steep >= 0.58) | ((height > 0.78) & (steep > 0.34))
    ridge = (height > 0.9) & (steep > 0.55)
    return F.when(near & (height < 0.48), 0).when(ridge, 5).when(mountain, 4).when(hill, 3).when(rolling, 2).otherwise(1)


def river_access(dist: Column, extent: float) -> Column:
    """Best at a small distance from water, falling off like a bell on both sides."""
    off = dist - max(40.0, extent * 0.08)
    return F.exp(-(off * off) / (2 * max(60.0, extent * 0.12) ** 2))


def flood_risk(dist: Column, height: Column, extent: float) -> Column:
    near = F.exp(-(dist * dist) / (2 * max(30.0, extent * 0.04) ** 2))
    return _unit(0.65 * near + 0.35 * _unit(1 - height))


def suitability(height: Column, steep: Column, dist: Column, flood: Column, radial: Column, extent: float) -> Column:
    """``radial``: distance from the centre with the border's middle at one."""
    return _unit(0.42 * (1 - _unit(steep)) + 0.28 * river_access(dist, extent) + 0.18 * _unit(1 - radial) + 0.12 * (1 - _unit(height)) - 0.35 * flood)


def resource_scores(height: Column, steep: Column, suit: Column, flood: Column) -> dict[str, Column]:
    return {
        "agri": _unit(0.65 * suit + 0.2 * (1 - flood) + 0.15 * (1 - steep)),
        "ore": _unit(0.6 * height + 0.4 * steep),
        "forest": _unit(0.4 * (1 - suit) + 0.35 * (1 - flood) + 0.25 * (1 - F.abs(steep - 0.45) * 2)),
    }


# How much a site of each kind attracts people.
RESOURCE_WEIGHTS = {"water": 0.55, "agri": 0.45, "ore": 0.25, "forest": 0.18}
OTHER_WEIGHT = 0.15


def site_weight(kind: Column) -> Column:
    return F.coalesce(*(F.when(kind == k, w) for k, w in RESOURCE_WEIGHTS.items()), F.lit(OTHER_WEIGHT))


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def contours(cells: DataFrame, levels: int) -> DataFrame:
    """(level_no, ix, iy, edges): for each 2x2 square and inner level the square's edges that the contour crosses.

    Edges: 0 bottom, 1 right, 2 top, 3 left; a saddle crosses all four, as two segments (0, 1) and (2, 3).
    """
    t = around(cells, offsets=[(0, 1), (1, 1), (1, 0)])
    t = t.where(F.size("near") == 3).select("ix", "iy", F.array(F.col("h"), *(F.element_at("near", k) for k in range(3))).alias("c"))
    r = cells.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    t = t.join(F.broadcast(r)).withColumn("level_no", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    level = F.col("low") + (F.col("high") - F.col("low")) * F.col("level_no") / (levels + 1)
    crossed = lambda i, j: (F.col("c")[i] >= F.col("level")) != (F.col("c")[j] >= F.col("level"))
    share = lambda i, j: (F.col("level") - F.col("c")[i]) / (F.col("c")[j] - F.col("c")[i])
    edges = F.array_compact(F.array(*(F.when(crossed(i, j), F.struct(F.lit(n).alias("edge"), share(i, j).alias("t"))) for n, (i, j) in enumerate([(0, 1), (1, 2), (3, 2), (0, 3)]))))
    return t.withColumn("level", level).withColumn("edges", edges).where(F.size("edges") > 0).select("level_no", "level", "ix", "iy", "edges")


# The sides of a square that its contour joins, by which corners are at the level or above (8 for the corner
# at (x, y), 4 at (x + 1, y), 2 at (x + 1, y + 1), 1 at (x, y + 1)).  Sides: 0 from the first corner to the second, 1 from
# the second to the third, and so on around.
CONTOUR_CASES = {
    0: [],
    1: [(3, 2)],
    2: [(2, 1)],
    3: [(3, 1)],
    4: [(0, 1)],
    5: [(0, 3), (1, 2)],
    6: [(0, 2)],
    7: [(0, 3)],
    8: [(0, 3)],
    9: [(0, 2)],
    10: [(0, 1), (2, 3)],
    11: [(0, 1)],
    12: [(3, 1)],
    13: [(2, 1)],
    14: [(3, 2)],
    15: [],
}
_CORNERS = [(0, 0), (1, 0), (1, 1), (0, 1)]


def contour_segments(cells: DataFrame, levels: int, step: float = 1.0) -> DataFrame:
    """(level_no, share, ix, iy, part, a, b): the contours of ``levels`` inner levels, one segment a row.

    ``share``: the level within the range of heights.  ``a`` and ``b`` are the ends (x, y, edge) in cells times ``step``,
    interpolated on the square's sides; ``edge`` names the side of the raster, the same for both squares beside it.  A
    square with a missing corner has no contour, nor has a flat raster.
    """
    t = around(cells, offsets=[(0, 1), (1, 1), (1, 0)]).where(F.size("near") == 3)
    t = t.select("ix", "iy", F.array(F.col("h"), *(F.element_at("near", k) for k in range(3))).alias("c"))
    r = cells.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    t = t.join(F.broadcast(r)).where(F.col("high") - F.col("low") >= 1e-9).withColumn("level_no", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    t = t.withColumn("level", F.col("low") + (F.col("high") - F.col("low")) * F.col("level_no") / (levels + 1))
    above = [F.when(F.col("c")[k] >= F.col("level"), 8 >> k).otherwise(0) for k in range(4)]
    pair = lambda p: F.struct(F.lit(p[0]).alias("i"), F.lit(p[1]).alias("j"))
    none = F.array().cast("array<struct<i: int, j: int>>")
    table = F.array(*(F.array(*map(pair, pairs)) if pairs else none for pairs in CONTOUR_CASES.values()))
    t = t.select("*", F.posexplode(F.get(table, above[0] + above[1] + above[2] + above[3])).alias("part", "s"))

    def end(side: Column) -> Column:
        def on(k: int) -> Column:
            (ax, ay), (bx, by) = _CORNERS[k], _CORNERS[(k + 1) % 4]
            v0, v1 = F.col("c")[k], F.col("c")[(k + 1) % 4]
            w = _unit(F.when(F.abs(v1 - v0) < 1e-9, 0.5).otherwise((F.col("level") - v0) / (v1 - v0)))
            edge = F.struct((F.col("ix") + min(ax, bx)).alias("ix"), (F.col("iy") + min(ay, by)).alias("iy"), F.lit("x" if ay == by else "y").alias("axis"))
            return F.struct(((F.col("ix") + ax + (bx - ax) * w) * step).alias("x"), ((F.col("iy") + ay + (by - ay) * w) * step).alias("y"), edge.alias("edge"))

        return F.when(side == 0, on(0)).when(side == 1, on(1)).when(side == 2, on(2)).otherwise(on(3))

    share = (F.col("level") - F.col("low")) / (F.col("high") - F.col("low"))
    return t.select("level_no", share.alias("share"), "ix", "iy", "part", end(F.col("s.i")).alias("a"), end(F.col("s.j")).alias("b"))


def contour_lines(segments: DataFrame) -> DataFrame:
    """(level_no, line, seq, x, y): segments of ``contour_segments`` joined to lines over the sides that they share.

    ``line``: the first side of its line; a closed line ends with the point that it began with.
    """
    node = lambda p: F.struct("level_no", F.col(f"{p}.edge.ix").alias("ix"), F.col(f"{p}.edge.iy").alias("iy"), F.col(f"{p}.edge.axis").alias("axis"))
    t = materialize(segments.select(F.struct("level_no", "ix", "iy", "part").alias("id"), node("a").alias("u"), node("b").alias("v"), "a", "b"))
    points = t.select(F.col("u").alias("n"), "a.x", "a.y").unionByName(t.select(F.col("v").alias("n"), "b.x", "b.y")).groupBy("n").agg(F.min(F.struct("x", "y")).alias("p"))
    return along(t.select("id", "u", "v")).join(points, "n").select("chain.level_no", F.col("chain").alias("line"), "seq", "p.x", "p.y")


# Fixed value: a tile has this many cells each way.
TILE = 128


def _tile_labels(ix: np.ndarray, iy: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The smallest key of the region of each cell, of cells that lie in one tile."""
    order = np.argsort(k, kind="stable")
    x, y, k = ix[order] % TILE, iy[order] % TILE, k[order]
    place = np.full((TILE + 1, TILE + 1), -1)
    place[y, x] = np.arange(len(k))
    a = np.tile(place[y, x], 2)
    b = np.concatenate([place[y, x + 1], place[y + 1, x]])
    a, b, root = a[b >= 0], b[b >= 0], np.arange(len(k))
    while True:
        low, after = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(after, root[a], low)
        np.minimum.at(after, root[b], low)
        while not np.array_equal(after, after[after]):
            after = after[after]
        if np.array_equal(after, root):
            break
        root = after
    labels = np.empty(len(k), dtype=np.int64)
    labels[order] = k[root[place[y, x]]]
    return labels


def label_zones(mask: DataFrame) -> DataFrame:
    """(ix, iy, zone): connected regions of cells (4 neighbours), named by their smallest cell.

    Regions are found in tiles first; only their parts that meet at the sides of tiles are joined over rounds.
    """
    key = F.col("iy") * 1_000_000_007 + F.col("ix")

    def parts(table: pa.Table) -> pa.Table:
        if table.column("k").null_count:  # a group of cells without a place
            return table.rename_columns(["ix", "iy", "part"])
        return pa.table({"ix": table.column("ix"), "iy": table.column("iy"), "part": _tile_labels(*(table.column(c).to_numpy() for c in ("ix", "iy", "k")))})

    cells = mask.select(*(F.col(c).cast("long").alias(c) for c in ("ix", "iy"))).withColumn("k", key)
    t = materialize(cells.groupBy(F.floor(F.col("ix") / TILE), F.floor(F.col("iy") / TILE)).applyInArrow(parts, "ix long, iy long, part long"))
    mod = lambda c: F.pmod(F.col(c), F.lit(TILE))
    met = None
    for c in ("ix", "iy"):
        last = t.where(mod(c) == TILE - 1).select(*((F.col(n) + int(n == c)).alias(n) for n in ("ix", "iy")), F.col("part").alias("u"))
        both = last.join(t.where(mod(c) == 0), ["ix", "iy"]).select("u", F.col("part").alias("v"))
        met = both if met is None else met.unionByName(both)
    whole = connected_components(met.distinct()).select(F.col("node").alias("part"), "component")
    return t.join(whole, "part", "left").select("ix", "iy", F.coalesce("component", "part").alias("zone"))


def zone_summary(zones: DataFrame, size: float) -> DataFrame:
    return zones.groupBy("zone").agg(
        F.count("*").alias("n_cells"), (F.count("*") * size * size).alias("area"), F.min("ix").alias("min_x"), F.max("ix").alias("max_x"), F.min("iy").alias("min_y"), F.max("iy").alias("max_y")
    )


def zone_widths(zones: DataFrame) -> DataFrame:
    """(ix, iy, zone, depth): cells of ``zones`` (ix, iy, zone) with the steps to the nearest cell outside their zone.

    The distance transform of steps along rows and columns: first within each row, then, with what the rows gave, within
    each column; running minima of both directions, no iteration.
    """
    row, column = Window.partitionBy("zone", "iy").orderBy("ix"), Window.partitionBy("zone", "ix").orderBy("iy")
    t = _runs(zones.select("ix", "iy", "zone"), "ix", row)
    run = Window.partitionBy("zone", "iy", "_run")
    t = t.withColumn("g", F.least(F.col("ix") - F.min("ix").over(run), F.max("ix").over(run) - F.col("ix")) + 1).drop("_run")
    t = _runs(t, "iy", column)
    run = Window.partitionBy("zone", "ix", "_run")
    ordered = run.orderBy("iy")
    before = F.min(F.col("g") - F.col("iy")).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) + F.col("iy")
    behind = F.min(F.col("g") + F.col("iy")).over(ordered.rowsBetween(0, Window.unboundedFollowing)) - F.col("iy")
    rim = F.least(F.col("iy") - F.min("iy").over(run), F.max("iy").over(run) - F.col("iy")) + 1
    return t.select("ix", "iy", "zone", F.least(before, behind, rim).alias("depth"))


def _runs(t: DataFrame, c: str, w: Window) -> DataFrame:
    """Cells with the number of their run of neighbours, as _run."""
    return t.withColumn("_new", F.when(F.lag(c).over(w) == F.col(c) - 1, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w)).drop("_new")


def filter_zones(zones: DataFrame, size: float, min_area: float, min_width: float, max_span: float, max_aspect: float, max_area: float) -> DataFrame:
    """(zone, n_cells, area, width, span, aspect, split): zones of enough area and width that do not touch the border.

    ``width``: of the widest part, as the steps across it; ``span`` and ``aspect`` of the box.  ``split``: larger, longer or
    more stretched than allowed.  The border is that of all zones' cells.
    """
    deep = zone_widths(zones).groupBy("zone").agg(F.max("depth").alias("depth"), F.count("*").alias("n_cells"), *(f(c).alias(f"{n}_{c[1]}") for c in ("ix", "iy") for f, n in ((F.min, "min"), (F.max, "max"))))
    rim = zones.agg(*(f(c).alias(f"rim_{n}_{c[1]}") for c in ("ix", "iy") for f, n in ((F.min, "min"), (F.max, "max"))))
    w, h = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    t = deep.select("zone", "n_cells", (F.col("n_cells") * size * size).alias("area"), ((2 * F.col("depth") - 1) * size).alias("width"), (F.greatest(w, h) * size).alias("span"), (F.greatest(w, h) / F.least(w, h)).alias("aspect"), *(f"{n}_{c}" for n in ("min", "max") for c in "xy"))
    inner = t.join(F.broadcast(rim)).where(" and ".join(f"{n}_{c} <> rim_{n}_{c}" for n in ("min", "max") for c in "xy"))
    good = inner.where((F.col("area") >= min_area) & (F.col("width") >= min_width))
    split = (F.col("area") > max_area) | (F.col("span") > max_span) | (F.col("aspect") > max_aspect)
    return good.select("zone", "n_cells", "area", "width", "span", "aspect", split.alias("split"))


def cost_distance(cells: DataFrame, sources: DataFrame, step_cost: Column, max_rounds: int = 1000) -> DataFrame:
    """(ix, iy, cost): least cost to reach each cell from a source over eight neighbours.

    ``step_cost`` is the cost of a unit step over columns h (from) and h2 (to); diagonals are longer by the root of two.
    Iterative: only cells that the last round made cheaper are looked at again.
    """
    t = materialize(cells.select("ix", "iy", "h"))
    state = materialize(sources.select("ix", "iy").distinct().join(t, ["ix", "iy"]).select("ix", "iy", F.lit(0.0).alias("cost")))
    delta = state
    steps = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(2**0.5 if dx and dy else 1.0).alias("w")) for dy, dx in NEIGHBOURS))
    for n in range(max_rounds):
        out = delta.join(t, ["ix", "iy"]).select(F.col("h"), "cost", "ix", "iy", F.explode(steps).alias("s"))
        out = out.select((F.col("ix") + F.col("s.dx")).alias("ix"), (F.col("iy") + F.col("s.dy")).alias("iy"), "h", "cost", "s.w")
        out = out.join(t.withColumnRenamed("h", "h2"), ["ix", "iy"]).select("ix", "iy", (F.col("cost") + F.col("w") * step_cost).alias("c"))
        best = out.groupBy("ix", "iy").agg(F.min("c").alias("c"))
        better = best.join(state, ["ix", "iy"], "left").where(F.col("cost").isNull() | (F.col("c") < F.col("cost") - 1e-9)).select("ix", "iy", F.col("c").alias("cost"))
        delta = materialize(better)
        if delta.isEmpty():
            return state
        state = materialize(state.unionByName(delta).groupBy("ix", "iy").agg(F.min("cost").alias("cost")))
    raise RuntimeError("cost distance did not settle")


def principal_axis(xx: Column, xy: Column, yy: Column) -> tuple[Column, Column]:
    """(degrees in [0, 180), anisotropy in [0, 1]) of a symmetric 2x2 tensor."""
    half = (xx - yy) / 2
    r = F.sqrt(half * half + xy * xy)
    angle = F.degrees(F.atan2(xy, half) / 2)
    return F.when(angle < 0, angle + 180).otherwise(angle), F.when(xx + yy <= 1e-12, 0.0).otherwise(2 * r / (xx + yy))
