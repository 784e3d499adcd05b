"""Spatial joins: shapes are filed under the grid cells that they touch and joined by cell.

Searches without a bound look at rings of cells: a row is answered once what it has found is no farther than the ring
that has been searched in full; only the other rows go on to a ring twice as wide.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import geometry as g
from meridion.operators import crossings
from meridion.operators.components import connected_components
from meridion.session import materialize


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _covered(df: DataFrame, box: tuple[Column, Column, Column, Column], size: float) -> DataFrame:
    """A row per cell that the box touches, as _cx, _cy."""
    x = F.explode(F.sequence(_cell(box[0], size), _cell(box[2], size)))
    return df.withColumn("_cx", x).withColumn("_cy", F.explode(F.sequence(_cell(box[1], size), _cell(box[3], size))))


def _spread(df: DataFrame) -> DataFrame:
    """Rows dealt by cell: the join needs that where no side is small, and a small table is not left to one task.

    The other side is joined by a merge: Spark sees the size of a table before it is filed under many cells, and would send
    it through the driver.
    """
    return df.repartition("_cx", "_cy")


def bbox_join(a: DataFrame, b: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """Pairs of rows whose boxes (a_min_x.., b_min_x..) overlap, each pair once: in the lowest cell that both touch."""
    left = _covered(a, tuple(F.col(f"a_{c}") for c in ("min_x", "min_y", "max_x", "max_y")), size)
    right = _covered(b, tuple(F.col(f"b_{c}") + s * pad for c, s in (("min_x", -1), ("min_y", -1), ("max_x", 1), ("max_y", 1))), size)
    own = (F.col("_cx") == F.greatest(_cell(F.col("a_min_x"), size), _cell(F.col("b_min_x") - pad, size))) & (F.col("_cy") == F.greatest(_cell(F.col("a_min_y"), size), _cell(F.col("b_min_y") - pad, size)))
    return _spread(left).join(right.hint("merge"), ["_cx", "_cy"]).where(g.boxes_overlap("a_", "b_", pad + g.TINY) & own).drop("_cx", "_cy")


def shared_cells(blocks: DataFrame, size: int) -> DataFrame:
    """(a, b, share): pairs of blocks of cells (zone_id, min_x, min_y, max_x, max_y, all inclusive) that share some, and the
    share of the smaller block; a row per pair, none per cell.  They meet in squares of ``size`` cells."""
    side = lambda p: blocks.select(*(F.col(c).alias(f"{p}{c}") for c in ("zone_id", "min_x", "min_y", "max_x", "max_y")))
    both = lambda c: F.least(f"a_max_{c}", f"b_max_{c}") - F.greatest(f"a_min_{c}", f"b_min_{c}") + 1
    area = lambda p: (F.col(f"{p}max_x") - F.col(f"{p}min_x") + 1) * (F.col(f"{p}max_y") - F.col(f"{p}min_y") + 1)
    met = bbox_join(side("a_"), side("b_"), size).where("a_zone_id < b_zone_id")
    return met.select(F.col("a_zone_id").alias("a"), F.col("b_zone_id").alias("b"), (both("x") * both("y") / F.least(area("a_"), area("b_"))).alias("share"))


def boxed(segments: DataFrame, prefix: str) -> DataFrame:
    """Segments (id, x0, y0, x1, y1) with their box; every column gets the prefix."""
    t = segments.select("*", F.least("x0", "x1").alias("min_x"), F.least("y0", "y1").alias("min_y"), F.greatest("x0", "x1").alias("max_x"), F.greatest("y0", "y1").alias("max_y"))
    return t.select(*(F.col(c).alias(prefix + c) for c in t.columns))


def crossing_join(segments: DataFrame, size: float | None = None, sharing: bool = False) -> DataFrame:
    """(a, b, x, y): pairs of segments (id, x0, y0, x1, y1) that cross in a point, without pairs that share an end, unless ``sharing``.

    Segments are dealt to tiles along their course, and a tile's pairs are compared in blocks that leave the task as they
    are found; sides of tiles and cells follow from the segments, ``size`` is not looked at any more.
    """
    ends = ["x0", "y0", "x1", "y1"]
    s = segments.select("id", *(F.col(c).cast("double").alias(c) for c in ends))
    s = s.where((F.greatest(*(F.abs(c) for c in ends)) < float("inf")) & F.col("id").isNotNull())
    count, mean, width, height = s.agg(F.count("*"), F.avg(g.distance(*ends)), F.max("x0") - F.min("x0"), F.max("y0") - F.min("y0")).head()
    cell, side = crossings.grid(count, mean or 0.0, width or 0.0, height or 0.0)
    filed = filed_along(s, cell / 32, cell * side).select("_cx", "_cy", "id", *ends)
    # Little is read for what is done with it, so small partitions are not put together.
    filed = filed.repartition(int(s.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_cx", "_cy")
    kind = segments.schema["id"].dataType.simpleString()
    return filed.groupBy("_cx", "_cy").applyInArrow(crossings.pairs_in_tile(cell, side, sharing), f"a {kind}, b {kind}, x double, y double")


def within_distance(a: DataFrame, b: DataFrame, radius: float, size: float | None = None) -> DataFrame:
    """All pairs of points (a: id, x, y; b: own names besides x, y) no farther apart than ``radius``, with dist."""
    size = size or radius
    reach = int(-(-radius // size))
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    left = a.withColumn("_cx", _cell(F.col("x"), size)).withColumn("_cy", _cell(F.col("y"), size))
    right = b.withColumnsRenamed({"x": "bx", "y": "by"}).withColumn("_dx", around).withColumn("_dy", around)
    right = right.withColumn("_cx", _cell(F.col("bx"), size) + F.col("_dx")).withColumn("_cy", _cell(F.col("by"), size) + F.col("_dy")).drop("_dx", "_dy")
    return left.join(right.hint("merge"), ["_cx", "_cy"]).withColumn("dist", g.distance("x", "y", "bx", "by")).where(F.col("dist") <= radius).drop("_cx", "_cy")


def cluster_cell(radius: float) -> Column:
    """The cell of a point for ``clustered_cells``, null where a coordinate is none: points of one cell are in reach of each other."""
    plain = F.greatest(F.abs("x"), F.abs("y")) < float("inf")
    return F.when(plain & F.col("x").isNotNull() & F.col("y").isNotNull(), F.struct(_cell(F.col("x"), 0.7 * radius).alias("x"), _cell(F.col("y"), 0.7 * radius).alias("y")))


def clustered_cells(points: DataFrame, radius: float) -> DataFrame:
    """(cell, cluster): points (x, y) that reach each other over steps of at most ``radius`` are in cells of one cluster.

    Points are not listed in pairs where they are dense: those of a cell (``cluster_cell``) are together, and two cells are
    if any two of their outermost points are near.  Only cells that are not together then have all their points compared,
    those in reach of the other cell's box.
    """
    at = points.select(cluster_cell(radius).alias("cell"), "x", "y").where("cell is not null")
    by = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    ends = F.array_distinct(F.array(*(f(F.struct("x", "y"), c) for c in by for f in (F.min_by, F.max_by))))
    box = [f(c).alias(f"{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in "xy"]
    cells = materialize(at.groupBy("cell").agg(ends.alias("ends"), *box))
    side = lambda p: cells.select(*(F.col(c).alias(f"{p}_{c}") for c in cells.columns))
    steps = F.array(*(F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i in range(-2, 3) for j in range(-2, 3) if (i, j) > (0, 0)))
    other = F.struct((F.col("a_cell.x") + F.col("_step.x")).alias("x"), (F.col("a_cell.y") + F.col("_step.y")).alias("y"))
    apart = lambda c: F.greatest(F.lit(0.0), F.col(f"a_lo{c}") - F.col(f"b_hi{c}"), F.col(f"b_lo{c}") - F.col(f"a_hi{c}"))
    pairs = side("a").withColumn("_step", F.explode(steps)).withColumn("b_cell", other).join(side("b").hint("merge"), "b_cell")
    pairs = pairs.where(g.length(apart("x"), apart("y")) <= radius + g.TINY)
    near = F.exists("a_ends", lambda p: F.exists("b_ends", lambda q: g.length(p["x"] - q["x"], p["y"] - q["y"]) <= radius))
    pairs = materialize(pairs.select("a_cell", "b_cell", near.alias("near"), *(f"{p}_{b}{c}" for p in "ab" for b in ("lo", "hi") for c in "xy")))
    parts = cells.select("cell").join(connected_components(pairs.where("near"), "a_cell", "b_cell").withColumnRenamed("node", "cell"), "cell", "left")
    parts = materialize(parts.select("cell", F.coalesce("component", "cell").alias("cluster")))
    named = lambda p: parts.select(F.col("cell").alias(f"{p}_cell"), F.col("cluster").alias(p))
    left = materialize(pairs.where("not near").join(named("a"), "a_cell").join(named("b"), "b_cell").where("a <> b"))
    if left.isEmpty():
        return parts

    def reaching(p: str, q: str) -> DataFrame:
        t = at.select(F.col("cell").alias(f"{p}_cell"), "x", "y").join(left, f"{p}_cell")
        off = lambda c: F.greatest(F.lit(0.0), F.col(f"{q}_lo{c}") - F.col(c), F.col(c) - F.col(f"{q}_hi{c}"))
        return t.where(g.length(off("x"), off("y")) <= radius + g.TINY).select("a_cell", "b_cell", "a", "b", F.col("x").alias(f"{p}x"), F.col("y").alias(f"{p}y")).distinct()

    met = reaching("a", "b").join(reaching("b", "a").drop("a", "b"), ["a_cell", "b_cell"]).where(g.distance("ax", "ay", "bx", "by") <= radius)
    joined = connected_components(met.select("a", "b").distinct(), "a", "b").select(F.col("node").alias("cluster"), "component")
    return materialize(parts.join(joined, "cluster", "left").select("cell", F.coalesce("component", "cluster").alias("cluster")))


# Fixed value: rows still open that are sent to all tasks, so that a late ring does not deal all others again.
FEW = 4096


def _rings(a: DataFrame, near, enough, first: float, limit: float) -> DataFrame:
    """Widen until each row's answer is proved: ``near(rows, radius)`` searches, ``enough(found, radius)`` proves."""
    open_rows, radius, done, few = a, min(first, limit), None, False
    while True:
        found = materialize(near(F.broadcast(open_rows) if few else open_rows, radius))
        last = radius >= limit
        good = found if last else enough(found, radius)
        done = good if done is None else done.unionByName(good)
        if last:
            return done
        open_rows = materialize(open_rows.join(good.select("id").distinct(), "id", "left_anti"))
        left = open_rows.count()
        if not left:
            return done
        radius, few = min(2 * radius, limit), left <= FEW


def _start(n: int, width: float, height: float, length: float, k: int, first: float) -> float:
    """A radius in which about 4 * k (16 at least) of ``n`` shapes lie, were they spread evenly; ``first`` at most."""
    if not n:
        return first
    each = max(width, 1e-6) * max(height, 1e-6) / n * max(16, 4 * k)
    return min(first, max(2 * each / (2 * length + math.sqrt(4 * length * length + 4 * math.pi * each)), first * 2.0**-20))


def knn_join(a: DataFrame, b: DataFrame, k: int, first: float, limit: float = 1e9) -> DataFrame:
    """(id, other, dist, rank): the k nearest points of b (other, x, y) for each of a (id, x, y); ties by other.

    The search begins with what holds a few times k points of b at their mean density, ``first`` at most.
    """
    order = Window.partitionBy("id").orderBy("dist", "other")
    b = materialize(b.select("other", "x", "y"))
    *span, n = b.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*")).head()
    reach = a.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.min("x"), F.min("y")).head()
    far = 2 * sum(float(x or 0) for x in (*span, *reach)) + first

    def near(rows, radius):
        return within_distance(rows.select("id", "x", "y"), b, radius).where("not (id <=> other)").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "other", "dist", "rank")

    def enough(found, _):
        full = found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == k)
        return found.join(full.select("id"), "id", "left_semi")

    return _rings(a, near, enough, _start(n, span[0] or 0.0, span[1] or 0.0, 0.0, k, first), min(limit, far))


def nearest_distance(a: DataFrame, b: DataFrame, first: float, otherwise: float) -> DataFrame:
    """(id, dist): distance from each point to the nearest of b; ``otherwise`` where there is none.

    The search begins with what holds a few points of b at their mean density, ``first`` at most.
    """
    b = b.select(F.col("id").alias("other"), "x", "y")
    if b.isEmpty():
        return a.select("id", F.lit(otherwise).alias("dist"))
    found = _nearest(a, b, first)
    return a.select("id").join(found, "id", "left").select("id", F.coalesce("dist", F.lit(otherwise)).alias("dist"))


def _nearest(a: DataFrame, b: DataFrame, first: float) -> DataFrame:
    b = materialize(b)
    box = lambda t: t.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).head()
    p, q = box(a), box(b)
    n = q[4]
    far = first + sum(max(abs((m or 0) - (n or 0)) for m in p[i : i + 2] for n in q[i : i + 2]) for i in (0, 2))

    def near(rows, radius):
        return within_distance(rows.select("id", "x", "y"), b, radius).groupBy("id").agg(F.min("dist").alias("dist"))

    return _rings(a.select("id", "x", "y"), near, lambda found, _: found, _start(n, (q[1] or 0) - (q[0] or 0), (q[3] or 0) - (q[2] or 0), 0.0, 1, first), far)


def filed_along(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """A row per cell in reach of the segment, as _cx, _cy: column by column those beside its part over the column."""
    reach = radius + g.TINY
    t = segments.withColumn("_cx", F.explode(F.sequence(_cell(F.least("x0", "x1") - reach, size), _cell(F.greatest("x0", "x1") + reach, size))))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share = lambda x, level: F.when(F.abs(dx) > g.TINY, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - F.col("x0")) / dx))).otherwise(level)
    one = F.col("y0") + share(F.col("_cx") * size - reach, 0.0) * dy
    two = F.col("y0") + share((F.col("_cx") + 1) * size + reach, 1.0) * dy
    return t.withColumn("_cy", F.explode(F.sequence(_cell(F.least(one, two) - reach, size), _cell(F.greatest(one, two) + reach, size))))


_along = filed_along  # its name before


def nearest_segment(points: DataFrame, segments: DataFrame, first: float, k: int = 1, limit: float | None = None, accept: Column | None = None) -> DataFrame:
    """(id, seg, dist, px, py, t, rank): the k nearest segments (seg, x0, y0, x1, y1) of each point; ties by seg.

    ``accept`` (of px, py and the segment's columns) leaves out others; none is farther than ``limit``.  The search
    begins with what holds a few segments at their mean density, ``first`` at most, and segments are filed under cells
    of an eighth of their length, so candidates do not grow with the square of a denser table.
    """
    order = Window.partitionBy("id").orderBy("dist", "seg")
    s = materialize(segments.select("seg", "x0", "y0", "x1", "y1"))
    size = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    *e, n, length = s.agg(F.min(F.least("x0", "x1")), F.max(F.greatest("x0", "x1")), F.min(F.least("y0", "y1")), F.max(F.greatest("y0", "y1")), F.count("*"), F.avg(size)).head()
    p = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).head()
    far = first + sum(max(abs((m or 0) - (n or 0)) for m in p[i : i + 2] for n in e[i : i + 2]) for i in (0, 2))
    began = _start(n, (e[1] or 0) - (e[0] or 0), (e[3] or 0) - (e[2] or 0), length or 0.0, k, first)

    def near(rows, radius):
        cell = max(radius, min(first, (length or 0.0) / 8))
        filed = filed_along(s, radius, cell)
        at = rows.select("id", "x", "y", _cell(F.col("x"), cell).alias("_cx"), _cell(F.col("y"), cell).alias("_cy"))
        met = _spread(at).join(filed.hint("merge"), ["_cx", "_cy"]).withColumn("dist", g.segment_distance("x", "y", "x0", "y0", "x1", "y1")).where(F.col("dist") <= radius)
        t = g.along_segment("x", "y", "x0", "y0", "x1", "y1")
        met = met.withColumn("t", t).withColumn("px", F.col("x0") + F.col("t") * (F.col("x1") - F.col("x0"))).withColumn("py", F.col("y0") + F.col("t") * (F.col("y1") - F.col("y0")))
        met = met if accept is None else met.where(accept)
        return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "seg", "dist", "px", "py", "t", "rank")

    def enough(found, _):
        full = found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == k)
        return found.join(full.select("id"), "id", "left_semi")

    return _rings(points.select("id", "x", "y"), near, enough, began, far if limit is None else min(limit, far))


def first_class_segment(points: DataFrame, segments: DataFrame, first: float, limit: float, accept: Column | None = None) -> DataFrame:
    """(id, seg, dist, ..): of the segments (seg, class, ..) in reach the nearest of the lowest class; ties by seg.

    Classes take turns, each with the points that none before has answered; there should be few of them.
    """
    left, done = points.select("id", "x", "y"), None
    for c in sorted(r[0] for r in segments.select("class").distinct().collect()):
        found = materialize(nearest_segment(left, segments.where(F.col("class") == c), first, 1, limit, accept))
        done = found if done is None else done.unionByName(found)
        left = materialize(left.join(found.select("id"), "id", "left_anti"))
        if left.isEmpty():
            break
    return nearest_segment(left, segments, first, 1, limit, accept) if done is None else done


def snap(points: DataFrame, anchors: DataFrame, radius: float) -> DataFrame:
    """(id, x, y, anchor): points moved to the nearest anchor (anchor, rank, x, y) in reach; ties by rank, then anchor."""
    best = nearest_anchor(points, anchors, radius).select("id", "anchor", "bx", "by")
    return points.join(best, "id", "left").select("id", F.coalesce("bx", "x").alias("x"), F.coalesce("by", "y").alias("y"), "anchor")


def nearest_anchor(points: DataFrame, anchors: DataFrame, radius: float) -> DataFrame:
    """(id, dist, rank, anchor, bx, by): the nearest anchor (anchor, rank, x, y) no farther than ``radius``; ties by rank, then anchor.

    The search begins with what holds a few anchors at their mean density, so it meets no more pairs where they are dense.
    """
    b = materialize(anchors.select("anchor", "rank", "x", "y"))
    n, width, height = b.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).head()

    def near(rows, reach):
        met = within_distance(rows.select("id", "x", "y"), b, reach).groupBy("id").agg(F.min(F.struct("dist", "rank", "anchor", "bx", "by")).alias("m"))
        return met.select("id", "m.*")

    return _rings(points.select("id", "x", "y"), near, lambda found, _: found, _start(n, width or 0.0, height or 0.0, 0.0, 1, radius), radius)


def best_within(a: DataFrame, b: DataFrame, radius: float, k: int, score: Column, bonus: float, order: list[str], where: Column, least: float = 0.0) -> DataFrame:
    """The k pairs of lowest ``score`` for each of a (id, x, y, ..) with points of b no farther than ``radius``, of those where ``where`` holds.

    ``score``, of the columns of both and dist, is at least dist - ``bonus``.  So the search begins with what holds about 12 * k
    points beyond ``least`` and answers a row once its k best are below what farther points can have; ``order`` puts equal
    scores in order.
    """
    b = materialize(b)
    n, width, height = b.agg(F.count("*"), F.max("x") - F.min("x"), F.max("y") - F.min("y")).head()
    first = math.sqrt(12 * k * max(width or 0.0, 1e-6) * max(height or 0.0, 1e-6) / (math.pi * n) + least * least) if n else radius

    def near(rows, reach):
        met = within_distance(rows, b, reach).where(where).withColumn("score", score)
        met = met if reach >= radius else met.where(F.col("score") < reach - bonus - 1e-3)
        return met.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("score", *order))).where(F.col("_k") <= k).drop("_k")

    def enough(found, _):
        full = found.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == k)
        return found.join(full.select("id"), "id", "left_semi")

    return _rings(a, near, enough, first, radius)


def _inside(ring: Column, x: Column, y: Column) -> Column:
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    passes = F.zip_with(ring, following, lambda a, b: F.when(((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0)) + a["x"]), 1).otherwise(0))
    return F.aggregate(passes, F.lit(0), lambda n, p: n + p) % 2 == 1


def _covers_cell(ring: Column, size: float) -> Column:
    """Whether the ring holds the whole cell _cx, _cy: no side of it comes near the cell, and the middle is inside."""
    pad = size * 1e-6
    x0, y0, x1, y1 = F.col("_cx") * size - pad, F.col("_cy") * size - pad, (F.col("_cx") + 1) * size + pad, (F.col("_cy") + 1) * size + pad
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))

    def touches(a, b):
        side = [(b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) for x in (x0, x1) for y in (y0, y1)]
        apart = (F.least(a["x"], b["x"]) > x1) | (F.greatest(a["x"], b["x"]) < x0) | (F.least(a["y"], b["y"]) > y1) | (F.greatest(a["y"], b["y"]) < y0)
        return F.when(apart | (F.least(*side) > 0) | (F.greatest(*side) < 0), 0).otherwise(1)

    met = F.aggregate(F.zip_with(ring, following, touches), F.lit(0), lambda n, p: n + p)
    return (met == 0) & _inside(ring, (x0 + x1) / 2, (y0 + y1) / 2)


def zones_by_cell(zones: DataFrame, size: float) -> DataFrame:
    """A row per cell and zone (zone_id, ring, box, _cx, _cy), in each cell up to the first zone that holds it whole.

    No later one can be the first for a point there, so where zones lie on each other a cell's rows do not grow with them.
    """
    ring = F.col("ring")
    ends = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    box = [ends(f, k).alias(f"_{n}{k}") for f, n in ((F.array_min, "lo"), (F.array_max, "hi")) for k in ("x", "y")]
    filed = _covered(zones.select("zone_id", "ring", *box), tuple(F.col(c) for c in ("_lox", "_loy", "_hix", "_hiy")), size)
    filed = filed.withColumn("_whole", F.min(F.when(_covers_cell(ring, size), F.col("zone_id"))).over(Window.partitionBy("_cx", "_cy")))
    return filed.where(F.col("_whole").isNull() | (F.col("zone_id") <= F.col("_whole"))).drop("_whole")


def points_in_zones(points: DataFrame, zones: DataFrame, size: float) -> DataFrame:
    """(id, zone_id): the first zone (zone_id, ring) that holds each point; points in none are left out."""
    at = points.select("id", "x", "y", _cell(F.col("x"), size).alias("_cx"), _cell(F.col("y"), size).alias("_cy"))
    boxed_in = F.col("x").between(F.col("_lox"), F.col("_hix")) & F.col("y").between(F.col("_loy"), F.col("_hiy"))
    met = _spread(at).join(zones_by_cell(zones, size).hint("merge"), ["_cx", "_cy"]).where(boxed_in & _inside(F.col("ring"), F.col("x"), F.col("y")))
    return met.groupBy("id").agg(F.min("zone_id").alias("zone_id"))


def rasterize(segments: DataFrame, size: float, radius: float) -> DataFrame:
    """(ix, iy): cells whose centre is no farther than ``radius`` from a segment."""
    ends = (F.least("x0", "x1") - radius, F.least("y0", "y1") - radius, F.greatest("x0", "x1") + radius, F.greatest("y0", "y1") + radius)
    t = _covered(segments, ends, size)
    centre = lambda c: (F.col(c) + 0.5) * size
    return t.where(g.segment_distance(centre("_cx"), centre("_cy"), "x0", "y0", "x1", "y1") <= radius).select(F.col("_cx").alias("ix"), F.col("_cy").alias("iy")).distinct()


def spaced_top_k(points: DataFrame, radius: float, k: int, max_rounds: int = 1000) -> DataFrame:
    """(id, x, y, score): best score first, without any point nearer than ``radius`` to one that is kept; k at most.

    Iterative, and gives what one pass over all points in the order of their scores does: in each round the best open
    points of cells are looked at, those that outrank the best of all cells in reach are kept, and points near them are
    dropped.  So no pairs of points are made; rounds end when k are kept that outrank all that is open.
    """
    cell = lambda c: _cell(F.col(c), radius)
    rank = F.struct(F.when(F.isnan("score"), float("-inf")).otherwise(-F.col("score")).alias("s"), "id")
    left = materialize(points.where("score > 0").select("id", "x", "y", "score", cell("x").alias("_cx"), cell("y").alias("_cy")))
    around = lambda df: df.withColumn("_cx", F.explode(F.array(*(F.col("_cx") + i for i in (-1, 0, 1))))).withColumn("_cy", F.explode(F.array(*(F.col("_cy") + i for i in (-1, 0, 1)))))
    kept = None
    for n in range(max_rounds):
        best = materialize(left.groupBy("_cx", "_cy").agg(F.min(F.struct(rank.alias("r"), "x", "y", "score")).alias("m")).select("_cx", "_cy", "m.*"))
        if best.isEmpty():
            return (left.select("id", "x", "y", "score") if kept is None else kept).orderBy(F.desc("score"), "id").limit(k)
        if kept is not None:
            last = kept.orderBy(F.desc("score"), "id").select(rank.alias("r")).limit(k).agg(F.max("r").alias("r"), F.count("*").alias("n"))
            if not last.where(F.col("n") == k).join(best.agg(F.min("r").alias("b")), F.col("r") < F.col("b")).isEmpty():
                return kept.orderBy(F.desc("score"), "id").limit(k)
        ahead = around(best.select("_cx", "_cy", "r")).groupBy("_cx", "_cy").agg(F.min("r").alias("ahead"))
        won = best.join(ahead, ["_cx", "_cy"]).where(F.col("r") == F.col("ahead")).select(F.col("r.id").alias("id"), "x", "y", "score", "_cx", "_cy")
        won = materialize(won)
        chosen = won.select("id", "x", "y", "score")
        kept = chosen if kept is None else kept.unionByName(chosen)
        kept = materialize(kept) if n % 8 == 7 else kept
        # Of the cells around one winner none has another, so a point has four to be compared with at most.
        out = around(won.select(F.col("id").alias("_w"), F.col("x").alias("_wx"), F.col("y").alias("_wy"), "_cx", "_cy"))
        gone = left.join(out, ["_cx", "_cy"]).where((F.col("id") == F.col("_w")) | (g.distance("x", "y", "_wx", "_wy") < radius)).select("id").distinct()
        left = materialize(left.join(gone, "id", "left_anti"))
    raise RuntimeError("spaced selection did not settle")
