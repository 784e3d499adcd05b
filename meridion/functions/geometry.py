"""Plane geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter vectors have no direction.
TINY = 1e-6


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), v))


def world_to_cell(x: Column, extent: float, n: int) -> Column:
    """Index of the node that is nearest; halves go to the even one, ends are clamped."""
    return clip(F.rint(x / extent * (n - 1)), 0.0, float(n - 1)).cast("long")


def cell_to_world(i: Column, extent: float, n: int) -> Column:
    return i / float(n - 1) * extent


def length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def distance(ax, ay, bx, by) -> Column:
    return length(_c(ax) - _c(bx), _c(ay) - _c(by))


def unit(x: Column, y: Column) -> tuple[Column, Column]:
    """Both parts of the direction; zero for vectors that have none."""
    n = length(x, y)
    part = lambda v: F.when(n <= TINY, 0.0).otherwise(v / n)
    return part(x), part(y)


def cross(ax, ay, bx, by) -> Column:
    return _c(ax) * _c(by) - _c(ay) * _c(bx)


def dot(ax, ay, bx, by) -> Column:
    return _c(ax) * _c(bx) + _c(ay) * _c(by)


def boxes_overlap(a: str, b: str, eps: float = TINY) -> Column:
    """Boxes a and b with columns min_x, min_y, max_x, max_y under those prefixes."""
    g = lambda p, k: F.col(f"{p}{k}")
    return (
        (g(a, "min_x") <= g(b, "max_x") + eps) & (g(b, "min_x") <= g(a, "max_x") + eps) & (g(a, "min_y") <= g(b, "max_y") + eps) & (g(b, "min_y") <= g(a, "max_y") + eps)
    )


def along_segment(px, py, x0, y0, x1, y1) -> Column:
    """Share of the segment at which the point's projection lies, in [0, 1]."""
    px, py, x0, y0, x1, y1 = map(_c, (px, py, x0, y0, x1, y1))
    d2 = (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)
    return F.when(d2 <= TINY * TINY, 0.0).otherwise(clip(((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / d2))


def segment_distance(px, py, x0, y0, x1, y1) -> Column:
    t = along_segment(px, py, x0, y0, x1, y1)
    x0, y0, x1, y1 = map(_c, (x0, y0, x1, y1))
    return distance(px, py, x0 + t * (x1 - x0), y0 + t * (y1 - y0))


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees in [0, 360) from the x axis."""
    a = F.degrees(F.atan2(dy, dx))
    return F.when(a < 0, a + 360).otherwise(a)


def angle_between(ax, ay, bx, by, undefined: float = 180.0) -> Column:
    """Degrees in [0, 180]; ``undefined`` if a vector has no direction."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    n = length(ax, ay) * length(bx, by)
    return F.when(n <= TINY, undefined).otherwise(F.degrees(F.acos(clip((ax * bx + ay * by) / n, -1.0, 1.0))))


def crossing(a: tuple[str, str, str, str], b: tuple[str, str, str, str], eps: float = TINY) -> tuple[Column, Column, Column]:
    """(whether two segments cross in a point, its x, its y)."""
    ax, ay, bx, by = map(F.col, a)
    cx, cy, dx, dy = map(F.col, b)
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    den = rx * sy - ry * sx
    over = F.when(F.abs(den) > eps, den)
    t, u = ((cx - ax) * sy - (cy - ay) * sx) / over, ((cx - ax) * ry - (cy - ay) * rx) / over
    return over.isNotNull() & t.between(-eps, 1 + eps) & u.between(-eps, 1 + eps), ax + t * rx, ay + t * ry


def meeting(a: tuple[str, str, str, str], b: tuple[str, str, str, str], eps: float = TINY) -> tuple[Column, Column, Column]:
    """(kind, x, y) of two segments: 'point' with where they cross, 'overlap' with an end on both, or 'none'."""
    ax, ay, bx, by = map(F.col, a)
    cx, cy, dx, dy = map(F.col, b)
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    den = rx * sy - ry * sx
    side = (cx - ax) * ry - (cy - ay) * rx
    t = ((cx - ax) * sy - (cy - ay) * sx) / F.when(F.abs(den) > eps, den)
    u = side / F.when(F.abs(den) > eps, den)
    crosses = (F.abs(den) > eps) & (t >= -eps) & (t <= 1 + eps) & (u >= -eps) & (u <= 1 + eps)
    on = lambda px, py, x0, y0, x1, y1: (F.abs((x1 - x0) * (py - y0) - (y1 - y0) * (px - x0)) <= eps) & px.between(F.least(x0, x1) - eps, F.greatest(x0, x1) + eps) & py.between(F.least(y0, y1) - eps, F.greatest(y0, y1) + eps)
    ends = [(ax, ay, on(ax, ay, cx, cy, dx, dy)), (bx, by, on(bx, by, cx, cy, dx, dy)), (cx, cy, on(cx, cy, ax, ay, bx, by)), (dx, dy, on(dx, dy, ax, ay, bx, by))]
    pick = lambda k: F.coalesce(*(F.when(e[2], e[k]) for e in ends))
    shared = (F.abs(den) <= eps) & (ends[0][2] | ends[1][2] | ends[2][2] | ends[3][2])
    kind = F.when(crosses, "point").when(shared, "overlap").otherwise("none")
    return kind, F.when(crosses, ax + t * rx).when(shared, pick(0)), F.when(crosses, ay + t * ry).when(shared, pick(1))


def ring_area(ring: Column) -> Column:
    """Shoelace area of an array of (x, y) without a closing point."""
    n = F.size(ring)
    following = F.concat(F.slice(ring, 2, F.greatest(n, F.lit(1))), F.slice(ring, 1, 1))
    twice = F.aggregate(F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda a, v: a + v)
    return F.abs(twice) / 2


def blend(ax, ay, bx, by, weight: Column) -> tuple[Column, Column]:
    """Direction between two headings; the second is turned round if it opposes the first."""
    ax, ay, bx, by = map(_c, (ax, ay, bx, by))
    s = F.when(ax * bx + ay * by < 0, -1.0).otherwise(1.0)
    return unit(ax * (1 - weight) + s * bx * weight, ay * (1 - weight) + s * by * weight)


def contact_mode(d: Column) -> Column:
    """How an approach meets a tangent, from the dot product of both directions."""
    return F.when(d <= -0.82, "opposing").when(F.abs(d) <= 0.34, "perpendicular").when(F.abs(d) >= 0.82, "parallel").otherwise("oblique")
