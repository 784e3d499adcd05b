"""Polylines as vertex tables (line_id, seq, x, y): windows over each line."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import geometry as g


def _line() -> Window:
    return Window.partitionBy("line_id").orderBy("seq")



def segmentize(verts: DataFrame) -> DataFrame:
    """(line_id, seq, x0, y0, x1, y1, len): consecutive vertices, without segments shorter than 1e-6."""
    t = verts.select("line_id", "seq", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(_line()).alias("x1"), F.lead("y").over(_line()).alias("y1"))
    t = t.withColumn("len", g.distance("x0", "y0", "x1", "y1"))
    return t.where(F.col("x1").isNotNull() & (F.col("len") > g.TINY))


def measures(verts: DataFrame) -> DataFrame:
    """(line_id, length, span, sinuosity)."""
    step = g.distance("x", "y", F.lead("x").over(_line()), F.lead("y").over(_line()))
    t = verts.withColumn("step", step).groupBy("line_id").agg(F.sum("step").alias("length"), F.min_by(F.struct("x", "y"), "seq").alias("a"), F.max_by(F.struct("x", "y"), "seq").alias("b"))
    t = t.withColumn("length", F.coalesce("length", F.lit(0.0))).withColumn("span", g.distance("a.x", "a.y", "b.x", "b.y"))
    return t.select("line_id", "length", "span", F.when(F.col("span") <= g.TINY, 1.0).otherwise(F.col("length") / F.col("span")).alias("sinuosity"))


def cumulative(verts: DataFrame) -> DataFrame:
    """The distance along the line at each vertex, as cum."""
    step = F.coalesce(g.distance("x", "y", F.lag("x").over(_line()), F.lag("y").over(_line())), F.lit(0.0))
    return verts.withColumn("step", step).withColumn("cum", F.sum("step").over(_line().rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def _spans(verts: DataFrame) -> DataFrame:
    """Segments with the distance along the line at both ends and the line's length."""
    t = cumulative(verts)
    t = t.select("line_id", "seq", "x", "y", "cum", F.lead("x").over(_line()).alias("x1"), F.lead("y").over(_line()).alias("y1"), F.lead("cum").over(_line()).alias("cum1"))
    return t.withColumn("total", F.max(F.coalesce("cum1", "cum")).over(Window.partitionBy("line_id"))).where("cum1 is not null and cum1 > cum")


def interpolate(verts: DataFrame, at: Column) -> DataFrame:
    """(line_id, x, y, ux, uy): point and direction at a distance along each line, from columns of it (total)."""
    t = _spans(verts).withColumn("d", F.least(F.col("total"), F.greatest(F.lit(0.0), at)))
    hit = t.where((F.col("cum") <= F.col("d")) & (F.col("d") <= F.col("cum1")))
    first = hit.withColumn("_n", F.row_number().over(_line())).where("_n = 1")
    w = (F.col("d") - F.col("cum")) / (F.col("cum1") - F.col("cum"))
    ux, uy = g.unit(F.col("x1") - F.col("x"), F.col("y1") - F.col("y"))
    return first.select("line_id", (F.col("x") + w * (F.col("x1") - F.col("x"))).alias("px"), (F.col("y") + w * (F.col("y1") - F.col("y"))).alias("py"), ux.alias("ux"), uy.alias("uy"))


def locate(verts: DataFrame, px: float, py: float) -> DataFrame:
    """(line_id, along, dist, seq): where each line is nearest to a point; the first segment wins ties."""
    t = _spans(verts)
    w = g.along_segment(px, py, "x", "y", "x1", "y1")
    t = t.withColumn("dist", g.segment_distance(px, py, "x", "y", "x1", "y1")).withColumn("along", F.col("cum") + w * (F.col("cum1") - F.col("cum")))
    return t.groupBy("line_id").agg(F.min(F.struct("dist", "seq", "along")).alias("m")).select("line_id", F.col("m.along").alias("along"), F.col("m.dist").alias("dist"), F.col("m.seq").alias("seq"))


def moving_average(verts: DataFrame) -> DataFrame:
    w = _line().rowsBetween(-1, 1)
    return verts.select("line_id", "seq", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))


def resample(verts: DataFrame, spacing: float) -> DataFrame:
    """(line_id, k, x, y): a point every ``spacing`` along each line, from its start."""
    t = _spans(verts)
    first = F.ceil(F.col("cum") / spacing).cast("long")
    last = F.ceil(F.col("cum1") / spacing).cast("long") - 1
    t = t.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    w = (F.col("k") * spacing - F.col("cum")) / (F.col("cum1") - F.col("cum"))
    return t.select("line_id", "k", (F.col("x") + w * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + w * (F.col("y1") - F.col("y"))).alias("y"))


# Fixed values, in metres: a last piece that is shorter goes with the one before it, or goes altogether.
MERGED_TAIL, DROPPED_TAIL = 14.0, 8.0


def chunks(verts: DataFrame, most: float) -> DataFrame:
    """(line_id, chunk, seq, x, y): lines cut by length into pieces of ``most``, with the points where they are cut.

    What is left at the end is a piece; under 14 m it belongs to the piece before it, and under 8 m it is dropped.  A line that
    is not longer than ``most`` is one piece, whatever its length, and so is every line if ``most`` is under 8 m.  Points
    that repeat the one before them are left out; a point where a cut falls is that cut.
    """
    spans = _spans(verts)
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("total") / most)) if most >= DROPPED_TAIL else F.lit(1).cast("long")
    tail = F.col("total") - (F.col("n") - 1) * most
    t = spans.withColumn("n", n).withColumn("dropped", (F.col("n") > 1) & (tail < DROPPED_TAIL)).withColumn("merged", (F.col("n") > 1) & ~F.col("dropped") & (tail < MERGED_TAIL))
    shared = ("line_id", "n", "dropped", "merged")
    first = F.floor(F.col("cum") / most).cast("long") + 1
    # Cuts behind the start of a segment up to its end; the next segment has those at its own start.
    cuts = t.withColumn("lo", first).withColumn("hi", F.least(F.floor(F.col("cum1") / most).cast("long"), F.col("n") - 1)).where("lo <= hi").withColumn("k", F.explode(F.sequence("lo", "hi")))
    w = (F.col("k") * most - F.col("cum")) / (F.col("cum1") - F.col("cum"))
    cuts = cuts.select(*shared, (F.col("k") * most).alias("at"), (F.col("x") + w * (F.col("x1") - F.col("x"))).alias("px"), (F.col("y") + w * (F.col("y1") - F.col("y"))).alias("py"), F.array(F.col("k") - 1, "k").alias("in"))
    on_cut = lambda c: (F.abs(F.col(c) / most - F.round(F.col(c) / most)) * most <= 1e-9) & (F.round(F.col(c) / most) >= 1) & (F.round(F.col(c) / most) < F.col("n"))
    within = lambda c: F.array(F.least(F.floor(F.col(c) / most).cast("long"), F.col("n") - 1))
    starts = t.where(~on_cut("cum")).select(*shared, F.col("cum").alias("at"), F.col("x").alias("px"), F.col("y").alias("py"), within("cum").alias("in"))
    ends = t.where("cum1 = total").select(*shared, F.col("cum1").alias("at"), F.col("x1").alias("px"), F.col("y1").alias("py"), F.array(F.col("n") - 1).alias("in"))
    points = starts.unionByName(cuts).unionByName(ends).select(*shared, "at", F.col("px").alias("x"), F.col("py").alias("y"), F.explode("in").alias("k"))
    kept = points.where(~(F.col("dropped") & (F.col("k") == F.col("n") - 1)))
    chunk = F.when(F.col("merged") & (F.col("k") == F.col("n") - 1), F.col("k") - 1).otherwise(F.col("k"))
    once = kept.select("line_id", chunk.alias("chunk"), "at", "x", "y").dropDuplicates(["line_id", "chunk", "at"])
    lone = verts.join(spans.select("line_id").distinct(), "line_id", "left_anti").groupBy("line_id").agg(F.min_by(F.struct("x", "y"), "seq").alias("p"))
    once = once.unionByName(lone.select("line_id", F.lit(0).cast("long").alias("chunk"), F.lit(0.0).alias("at"), "p.x", "p.y"))
    return once.select("line_id", "chunk", (F.row_number().over(Window.partitionBy("line_id", "chunk").orderBy("at")) - 1).cast("long").alias("seq"), "x", "y")


def chaikin(verts: DataFrame, rounds: int = 1) -> DataFrame:
    """Corners cut at a quarter and three quarters of each segment; both ends stay."""
    t = verts.select("line_id", "seq", "x", "y")
    for _ in range(rounds):
        nx, ny = F.lead("x").over(_line()), F.lead("y").over(_line())
        t = t.select("*", nx.alias("nx"), ny.alias("ny"), F.row_number().over(_line()).alias("n"))
        mixed = lambda w: F.struct((F.col("x") * (1 - w) + F.col("nx") * w).alias("x"), (F.col("y") * (1 - w) + F.col("ny") * w).alias("y"))
        end = F.struct("x", "y")
        cut = F.when(F.col("nx").isNull(), F.array(end)).when(F.col("n") == 1, F.array(end, mixed(0.25), mixed(0.75))).otherwise(F.array(mixed(0.25), mixed(0.75)))
        t = t.select("line_id", "n", F.posexplode(cut).alias("k", "p")).select("line_id", F.row_number().over(Window.partitionBy("line_id").orderBy("n", "k")).cast("long").alias("seq"), "p.x", "p.y")
        t = t.withColumn("seq", F.col("seq") - 1)
    return t


def drop_repeats(verts: DataFrame, eps: float = 1e-6) -> DataFrame:
    px, py = F.lag("x").over(_line()), F.lag("y").over(_line())
    t = verts.select("*", (px.isNotNull() & (F.abs(F.col("x") - px) <= eps) & (F.abs(F.col("y") - py) <= eps)).alias("again"))
    return t.where(~F.col("again")).drop("again")


def _farthest_kept(eps: float):
    """Douglas-Peucker over one line's table (line_id, seq, x, y); ties to the smallest seq, and a stack instead of recursion."""

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        seq, gone = table.column("seq").to_numpy(), np.zeros(table.num_rows, dtype=bool)
        x, y = (table.column(c).to_numpy() for c in "xy")
        for c in "xy":
            gone |= np.asarray(table.column(c).is_null())
        kept, todo = {seq[0], seq[-1]}, [(0, len(seq) - 1)]
        while todo:
            lo, hi = todo.pop()
            if hi - lo < 2:
                continue
            i, j = np.searchsorted(seq, seq[lo], "right"), np.searchsorted(seq, seq[hi], "left")
            if i >= j or gone[lo] or gone[hi]:
                continue
            dx, dy, px, py = x[hi] - x[lo], y[hi] - y[lo], x[i:j] - x[lo], y[i:j] - y[lo]
            n = np.sqrt(dx * dx + dy * dy)
            off = np.sqrt(px * px + py * py) if n <= g.TINY else np.abs(dx * py - dy * px) / n
            off = np.where(gone[i:j], -1.0, np.where(np.isnan(off), np.inf, off))
            far = int(np.argmax(off))
            if off[far] > eps:
                kept.add(seq[i + far])
                todo += [(lo, i + far), (i + far, hi)]
        return table.filter(pa.array(np.isin(seq, list(kept))))

    return keep


def simplify(verts: DataFrame, eps: float) -> DataFrame:
    """Douglas-Peucker: the vertices that are kept.  Intervals are split at their farthest vertex, if beyond eps.

    Lines are dealt once, to no other tasks if they were dealt before; a line's vertices have to fit a task.
    """
    v = verts.select("line_id", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("line_id is not null and seq is not null")
    return v.groupBy("line_id").applyInArrow(_farthest_kept(eps), v.schema)


def turns(verts: DataFrame, most: float) -> DataFrame:
    """(line_id, seq, turn, clamped): change of heading at each inner vertex, and at most ``most`` degrees of it."""
    s = segmentize(verts)
    w = Window.partitionBy("line_id").orderBy("seq")
    t = s.select("line_id", "seq", (F.col("x1") - F.col("x0")).alias("dx"), (F.col("y1") - F.col("y0")).alias("dy"))
    t = t.select("*", F.lag("dx").over(w).alias("px"), F.lag("dy").over(w).alias("py")).where("px is not null")
    a = g.angle_between("px", "py", "dx", "dy", 0.0)
    return t.select("line_id", "seq", a.alias("turn"), F.least(a, F.lit(most)).alias("clamped"))


def transitions(samples: DataFrame, flag: str) -> DataFrame:
    """(line_id, crossings): changes of a flag along each line's samples, two to a crossing."""
    was = F.lag(flag).over(_line())
    t = samples.withColumn("turned", F.when(was.isNotNull() & (was != F.col(flag)), 1).otherwise(0))
    return t.groupBy("line_id").agg(F.sum("turned").alias("changes")).select("line_id", "changes", F.expr("changes div 2").alias("crossings"))


def segment_costs(segments: DataFrame, cells: DataFrame, size: float, extent: float, slope_penalty: float, crossing_penalty: float) -> DataFrame:
    """(line_id, seq, length, slope, crossings, cost) of segments (line_id, seq, x0, y0, x1, y1, len) over a raster.

    ``cells``: ix, iy, slope, wet, of ``size`` metres; a missing cell is flat and dry.  A segment is sampled at 8 steps at
    least, and one for each 64th of ``extent``; ``slope`` is the mean of its samples by the raster's greatest, two
    changes between wet and dry are a crossing.  The samples of one segment are all that meets in one window.
    """
    steps = F.greatest(F.lit(8), F.floor(F.col("len") / max(extent / 64, 1.0)).cast("int"))
    t = segments.where("len > 1e-6").withColumn("_n", steps).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    share = F.col("_k") / F.col("_n")
    cell = lambda a, b: F.floor((F.col(a) + (F.col(b) - F.col(a)) * share) / size).cast("long")
    t = t.withColumns({"ix": cell("x0", "x1"), "iy": cell("y0", "y1")}).join(cells.select("ix", "iy", "slope", "wet"), ["ix", "iy"], "left")
    wet = F.coalesce("wet", F.lit(False))
    was = F.lag(wet).over(Window.partitionBy("line_id", "seq").orderBy("_k"))
    t = t.withColumn("_turn", F.when(was != wet, 1).otherwise(0))
    t = t.groupBy("line_id", "seq").agg(F.first("len").alias("length"), F.avg(F.coalesce("slope", F.lit(0.0))).alias("slope"), F.expr("sum(_turn) div 2").alias("crossings"))
    most = cells.agg(F.coalesce(F.max("slope"), F.lit(0.0)).alias("_most"))
    t = t.join(F.broadcast(most)).withColumn("slope", F.col("slope") / (F.col("_most") + 1e-9)).drop("_most")
    return t.withColumn("cost", F.col("length") * (1 + slope_penalty * F.col("slope")) + F.col("crossings") * crossing_penalty)


def line_costs(costs: DataFrame) -> DataFrame:
    """(line_id, length, crossings, cost): the sums of ``segment_costs``."""
    return costs.groupBy("line_id").agg(F.sum("length").alias("length"), F.sum("crossings").alias("crossings"), F.sum("cost").alias("cost"))
