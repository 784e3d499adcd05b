"""Map algebra over the binned surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.functions import geometry as g
from meridion.operators import raster as r
from meridion.operators import routes
from meridion.operators import spatial as sp
from meridion.plans import views as v
from meridion.plans.registry import query

S = v.CELL


def r4(c):
    return F.round(c, 4)


@query("bin_points_to_cells", "pts", "SELECT floor(x / 500)::BIGINT AS ix, floor(y / 500)::BIGINT AS iy, round(avg(v), 4) AS h, count(*) AS n FROM pts GROUP BY ALL")
def bin_points_to_cells(spark, d):
    return r.bin_points(v.pts(spark, d), S)


@query("cells_to_grid", "cells", "SELECT iy, count(*) AS n, string_agg(ix::VARCHAR, ',' ORDER BY ix) AS columns FROM cells GROUP BY iy")
def cells_to_grid(spark, d):
    c = v.cells(spark, d)
    grid = r.cells_to_grid(c.select("ix", "iy", F.col("ix").cast("double").alias("h")), 4)
    rows = c.select("iy").distinct().orderBy("iy").agg(F.array_sort(F.collect_list("iy")).alias("names"))
    t = r.grid_to_cells(grid.join(F.broadcast(rows)), "grid", "names")
    return t.groupBy(F.get("names", F.col("iy")).alias("iy")).agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ix", "h"))), lambda s: s["h"].cast("long").cast("string")), ",").alias("columns"))


@query("downsample_stride", "cells", "SELECT ix // 3 AS ix, iy // 3 AS iy, h FROM cells WHERE ix % 3 = 0 AND iy % 3 = 0")
def downsample_stride(spark, d):
    return r.downsample(v.cells(spark, d), 7, 21, 21).select("ix", "iy", "h")


@query("resample_nearest", "cells", """WITH a AS (SELECT t, round_even(t / 31.0::DOUBLE * 20, 0)::BIGINT AS s FROM (SELECT unnest(range(32)) AS t))
    SELECT x.t AS ix, y.t AS iy, h FROM cells JOIN a x ON x.s = ix JOIN a y ON y.s = iy""")
def resample_nearest(spark, d):
    return r.resample_nearest(v.cells(spark, d), 21, 32)


_GRAD = """WITH n AS (SELECT c.ix, c.iy, c.h, w.h AS wh, e.h AS eh, s.h AS sh, n.h AS nh FROM cells c LEFT JOIN cells w ON w.ix = c.ix - 1 AND w.iy = c.iy LEFT JOIN cells e ON e.ix = c.ix + 1 AND e.iy = c.iy
      LEFT JOIN cells s ON s.ix = c.ix AND s.iy = c.iy - 1 LEFT JOIN cells n ON n.ix = c.ix AND n.iy = c.iy + 1),
    g AS (SELECT ix, iy, h, CASE WHEN wh IS NOT NULL AND eh IS NOT NULL THEN (eh - wh) / 1000.0::DOUBLE WHEN eh IS NOT NULL THEN (eh - h) / 500.0::DOUBLE WHEN wh IS NOT NULL THEN (h - wh) / 500.0::DOUBLE ELSE 0 END AS gx,
      CASE WHEN sh IS NOT NULL AND nh IS NOT NULL THEN (nh - sh) / 1000.0::DOUBLE WHEN nh IS NOT NULL THEN (nh - h) / 500.0::DOUBLE WHEN sh IS NOT NULL THEN (h - sh) / 500.0::DOUBLE ELSE 0 END AS gy FROM n)"""


@query("slope", "cells", f"{_GRAD} SELECT ix, iy, round(sqrt(gx*gx+gy*gy), 4) AS slope FROM g")
def slope(spark, d):
    return r.slope(v.cells(spark, d), float(S)).select("ix", "iy", r4("slope").alias("slope"))


@query("hillshade", "cells", f"""{_GRAD} SELECT ix, iy, round((least(1.0, greatest(-1.0, sin(radians(45.0))*sin(pi()/2-atan(sqrt(gx*gx+gy*gy))) + cos(radians(45.0))*cos(pi()/2-atan(sqrt(gx*gx+gy*gy)))*cos(radians(315.0) - atan2(-gx, gy)))) + 1) / 2, 4) AS shade FROM g""")
def hillshade(spark, d):
    return r.hillshade(v.cells(spark, d), float(S)).select("ix", "iy", r4("shade").alias("shade"))


@query("slope_bias", "cells", f"""{_GRAD}, t AS (SELECT ix, iy, degrees(atan(sqrt(gx*gx+gy*gy))) AS deg FROM g)
    SELECT ix, iy, round(deg, 4) AS deg, round(least(1.0, greatest(0.0, (deg - 5) / 10)), 4) AS contour_weight FROM t""")
def slope_bias(spark, d):
    deg = F.degrees(F.atan("slope"))
    return r.slope(v.cells(spark, d), float(S)).select("ix", "iy", r4(deg).alias("deg"), r4(g.clip((deg - 5) / 10)).alias("contour_weight"))


_OFF = "(VALUES " + ", ".join(f"({k}, {dy}, {dx})" for k, (dy, dx) in enumerate(r.NEIGHBOURS)) + ") o(k, dy, dx)"
_FLOW = f"""f AS (SELECT ix, iy, h, to_x, to_y FROM (SELECT c.ix, c.iy, c.h, CASE WHEN n.h IS NOT NULL AND c.h - n.h > 0 THEN n.ix ELSE c.ix END AS to_x, CASE WHEN n.h IS NOT NULL AND c.h - n.h > 0 THEN n.iy ELSE c.iy END AS to_y,
    row_number() OVER (PARTITION BY c.ix, c.iy ORDER BY CASE WHEN n.h IS NULL THEN 1e300 ELSE n.h - c.h END, o.k) AS rk FROM cells c CROSS JOIN {_OFF} LEFT JOIN cells n ON n.ix = c.ix + o.dx AND n.iy = c.iy + o.dy) WHERE rk = 1)"""
_ACC = f"""RECURSIVE WITH {_FLOW}, w(sx, sy, ix, iy) AS (SELECT ix, iy, ix, iy FROM f UNION ALL SELECT w.sx, w.sy, f.to_x, f.to_y FROM w JOIN f ON f.ix = w.ix AND f.iy = w.iy WHERE f.to_x <> f.ix OR f.to_y <> f.iy),
    a AS (SELECT f.ix, f.iy, f.to_x, f.to_y, c.acc FROM f JOIN (SELECT ix, iy, count(*) AS acc FROM w GROUP BY ix, iy) c USING (ix, iy)),
    m AS (SELECT * FROM a WHERE acc >= 0.3::DOUBLE * (SELECT max(acc) FROM a))"""


@query("flow_direction", "cells", f"WITH {_FLOW} SELECT ix, iy, to_x, to_y FROM f")
def flow_direction(spark, d):
    return r.flow_direction(v.cells(spark, d)).select("ix", "iy", "to_x", "to_y")


@query("flow_accumulation", "cells", f"{_ACC} SELECT ix, iy, acc FROM a")
def flow_accumulation(spark, d):
    return r.flow_accumulation(r.flow_direction(v.cells(spark, d))).select("ix", "iy", "acc")


def _rivers(spark, d, share=0.3):
    return r.river_mask(r.flow_accumulation(r.flow_direction(v.cells(spark, d))), share)


@query("river_mask", "cells", f"{_ACC} SELECT ix, iy, acc FROM m")
def river_mask(spark, d):
    return _rivers(spark, d).select("ix", "iy", "acc")


_CHAINS = f"""{_ACC}, hd AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM m u WHERE u.to_x = m.ix AND u.to_y = m.iy AND (u.ix <> u.to_x OR u.iy <> u.to_y))),
    t(hx, hy, flow, seq, ix, iy, to_x, to_y) AS (SELECT ix, iy, acc, 0::BIGINT, ix, iy, to_x, to_y FROM hd UNION ALL SELECT t.hx, t.hy, t.flow, t.seq + 1, m.ix, m.iy, m.to_x, m.to_y FROM t JOIN m ON m.ix = t.to_x AND m.iy = t.to_y WHERE t.ix <> t.to_x OR t.iy <> t.to_y),
    ch AS (SELECT *, count(*) OVER (PARTITION BY hx, hy) AS n FROM t)"""


@query("trace_chains", "cells", f"{_CHAINS} SELECT hx, hy, seq, ix, iy, flow FROM ch WHERE n >= 2")
def trace_chains(spark, d):
    t = r.trace_chains(_rivers(spark, d))
    return t.select(F.col("head.x").alias("hx"), F.col("head.y").alias("hy"), F.col("seq").cast("long").alias("seq"), "ix", "iy", "flow")


_SMOOTH = _CHAINS.replace("cells", "surface").replace("0.3::DOUBLE", "0.02::DOUBLE") + """, sm AS (SELECT hx, hy, flow, seq, avg(ix * 20.0::DOUBLE) OVER w AS x, avg(iy * 20.0::DOUBLE) OVER w AS y FROM ch WHERE n >= 2 WINDOW w AS (PARTITION BY hx, hy ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
    ln AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM sm WINDOW w AS (PARTITION BY hx, hy ORDER BY seq)), tl AS (SELECT *, sum(step) OVER (PARTITION BY hx, hy) AS length FROM ln)"""


@query("river_lines", "surface", f"{_SMOOTH} SELECT hx, hy, seq, flow, round(x, 3) AS x, round(y, 3) AS y, round(length, 3) AS length FROM tl WHERE length >= 60")
def river_lines(spark, d):
    """Rivers of the growing surface as smoothed lines."""
    t = r.river_lines(r.river_mask(r.flow_accumulation(r.flow_direction(v.surface(spark, d))), 0.02), 20.0, 60.0)
    return t.select(F.col("head.x").alias("hx"), F.col("head.y").alias("hy"), "seq", "flow", *(F.round(c, 3).alias(c) for c in ("x", "y", "length")))


@query("minmax_normalize", "cells", "SELECT ix, iy, round((h - (SELECT min(h) FROM cells)) / (SELECT max(h) - min(h) FROM cells), 4) AS norm FROM cells")
def minmax_normalize(spark, d):
    return r.normalize(v.cells(spark, d)).select("ix", "iy", r4("norm").alias("norm"))


_NEAR = """near AS (SELECT c.ix, c.iy, c.h, min(sqrt(pow(c.ix*500.0-s.x,2)+pow(c.iy*500.0-s.y,2))) AS dist FROM cells c, sites s GROUP BY ALL)"""


def _cells_at(spark, d):
    return v.cells(spark, d).withColumn("x", F.col("ix") * float(S)).withColumn("y", F.col("iy") * float(S)).withColumn("cell", F.col("iy") * 100000 + F.col("ix"))


def _near_sites(spark, d):
    """Cells with their distance to the nearest site."""
    c = _cells_at(spark, d)
    return c.join(sp.nearest_distance(c.select(F.col("cell").alias("id"), "x", "y"), v.sites(spark, d).select("id", "x", "y"), 1000.0, otherwise=v.EXTENT), c["cell"] == F.col("id")).drop("id")


@query("nearest_point_distance", "cells sites", f"WITH {_NEAR} SELECT ix, iy, round(dist, 4) AS dist FROM near")
def nearest_point_distance(spark, d):
    return _near_sites(spark, d).select("ix", "iy", r4("dist").alias("dist"))


_CLASS = f"""{_GRAD}, {_NEAR}, z AS (SELECT ix, iy, (g.h - min(g.h) OVER ()) / (max(g.h) OVER () - min(g.h) OVER ()) AS hn, sqrt(gx*gx+gy*gy) AS sl, dist AS rv FROM g JOIN near USING (ix, iy)),
    q AS (SELECT ix, iy, hn, (sl - min(sl) OVER ()) / (max(sl) OVER () - min(sl) OVER ()) AS sn, sl / (max(sl) OVER () + 1e-9) AS sm, rv FROM z)"""


def _surface(spark, d):
    """ix, iy, hn, sn, slope, rv: normalised height and slope, the slope, the distance to the nearest site."""
    s = r.normalize(r.normalize(r.slope(v.cells(spark, d), float(S))).withColumnRenamed("norm", "hn"), "slope").withColumnRenamed("norm", "sn")
    return s.join(_near_sites(spark, d).select("ix", "iy", F.col("dist").alias("rv")), ["ix", "iy"])


@query("terrain_class", "cells sites", f"""{_CLASS} SELECT ix, iy, (CASE WHEN rv < 409.6 AND hn < 0.48 THEN 0 WHEN hn > 0.9 AND sn > 0.55 THEN 5 WHEN sn >= 0.58 OR (hn > 0.78 AND sn > 0.34) THEN 4 WHEN (sn >= 0.36 AND sn < 0.58) OR (hn > 0.62 AND sn > 0.22) THEN 3 WHEN sn >= 0.18 AND sn < 0.36 THEN 2 ELSE 1 END)::BIGINT AS code FROM q""")
def terrain_class(spark, d):
    return _surface(spark, d).select("ix", "iy", r.terrain_class(F.col("hn"), F.col("sn"), F.col("rv"), v.EXTENT).cast("long").alias("code"))


_SUIT = f"""{_CLASS}, fl AS (SELECT *, least(1.0, greatest(0.0, 0.65 * exp(-(rv*rv) / (2*409.6*409.6)) + 0.35 * (1 - hn))) AS flood FROM q),
    su AS (SELECT *, least(1.0, greatest(0.0, 0.42 * (1 - sn) + 0.28 * exp(-pow(rv-819.2,2) / (2*1228.8*1228.8)) + 0.18 * least(1.0, greatest(0.0, 1 - sqrt(pow(ix/10.0-1,2)+pow(iy/10.0-1,2)))) + 0.12 * (1 - hn) - 0.35 * flood)) AS suit FROM fl)"""


def _suitability(spark, d):
    t = _surface(spark, d)
    radial = g.length(F.col("ix") / 10.0 - 1, F.col("iy") / 10.0 - 1)
    t = t.withColumn("flood", r.flood_risk(F.col("rv"), F.col("hn"), v.EXTENT))
    return t.withColumn("suit", r.suitability(F.col("hn"), F.col("sn"), F.col("rv"), F.col("flood"), radial, v.EXTENT))


@query("suitability_flood", "cells sites", f"{_SUIT} SELECT ix, iy, round(flood, 4) AS flood, round(suit, 4) AS suit FROM su")
def suitability_flood(spark, d):
    return _suitability(spark, d).select("ix", "iy", r4("flood").alias("flood"), r4("suit").alias("suit"))


_KERN = """kn AS (SELECT c.ix, c.iy, coalesce(sum(CASE WHEN dist <= 2800 THEN wt * quality * exp(-dist*dist / (2*700.0*700.0)) END), 0) AS w FROM (SELECT c.ix, c.iy, s.quality, CASE s.kind WHEN 0 THEN 0.55 WHEN 1 THEN 0.45 WHEN 2 THEN 0.25 ELSE 0.18 END::DOUBLE AS wt, sqrt(pow(c.ix*500.0-s.x,2)+pow(c.iy*500.0-s.y,2)) AS dist FROM cells c, sites s) c GROUP BY ALL)"""


def _kernel(spark, d):
    c = _cells_at(spark, d)
    near = sp.within_distance(c.select(F.col("cell").alias("id"), "x", "y"), v.sites(spark, d).select(F.col("id").alias("site"), "x", "y", "quality", "kind"), 2800.0)
    kind = F.element_at(F.array(*map(F.lit, r.RESOURCE_WEIGHTS)), (F.col("kind") + 1).cast("int"))
    w = near.groupBy("id").agg(F.sum(r.site_weight(kind) * F.col("quality") * F.exp(-F.col("dist") * F.col("dist") / (2 * 700.0 * 700.0))).alias("w"))
    return c.join(w, c["cell"] == w["id"], "left").select("ix", "iy", F.coalesce("w", F.lit(0.0)).alias("w"))


@query("kernel_influence", "cells sites", f"WITH {_KERN} SELECT ix, iy, round(w / ((SELECT max(w) FROM kn) + 1e-9), 4) AS influence FROM kn")
def kernel_influence(spark, d):
    k = _kernel(spark, d)
    return k.join(F.broadcast(k.agg(F.max("w").alias("top")))).select("ix", "iy", r4(F.col("w") / (F.col("top") + 1e-9)).alias("influence"))


_POP = f"""{_SUIT}, {_KERN}, pp AS (SELECT ix, iy, suit, flood, least(1.0, greatest(0.0, (0.62 * suit + 0.38 * w / ((SELECT max(w) FROM kn) + 1e-9)) * (1 - 0.55 * flood))) AS pop FROM su JOIN kn USING (ix, iy))"""


def _population(spark, d):
    k = _kernel(spark, d)
    k = k.join(F.broadcast(k.agg(F.max("w").alias("top")))).select("ix", "iy", (F.col("w") / (F.col("top") + 1e-9)).alias("inf"))
    return _suitability(spark, d).join(k, ["ix", "iy"]).withColumn("pop", g.clip((0.62 * F.col("suit") + 0.38 * F.col("inf")) * (1 - 0.55 * F.col("flood"))))


@query("population_potential", "cells sites", f"{_POP} SELECT ix, iy, round(pop, 4) AS pop FROM pp")
def population_potential(spark, d):
    return _population(spark, d).select("ix", "iy", r4("pop").alias("pop"))


@query("green_score", "cells sites", f"{_POP} SELECT ix, iy, round(0.55 * flood + 0.25 * (1 - pop) + 0.20 * (1 - suit), 4) AS green FROM pp")
def green_score(spark, d):
    return _population(spark, d).select("ix", "iy", r4(0.55 * F.col("flood") + 0.25 * (1 - F.col("pop")) + 0.20 * (1 - F.col("suit"))).alias("green"))


@query("resource_scores", "cells sites", f"""{_SUIT} SELECT ix, iy, round(least(1.0, greatest(0.0, 0.65 * suit + 0.2 * (1 - flood) + 0.15 * (1 - sn))), 4) AS agri, round(least(1.0, greatest(0.0, 0.6 * hn + 0.4 * sn)), 4) AS ore, round(least(1.0, greatest(0.0, 0.4 * (1 - suit) + 0.35 * (1 - flood) + 0.25 * (1 - abs(sn - 0.45) * 2))), 4) AS forest FROM su""")
def resource_scores(spark, d):
    scores = r.resource_scores(F.col("hn"), F.col("sn"), F.col("suit"), F.col("flood"))
    return _suitability(spark, d).select("ix", "iy", *(r4(c).alias(k) for k, c in scores.items()))


@query("hub_score", "cells sites", f"""{_CLASS} SELECT ix, iy, round(0.45 * (1 - least(1.0, sm)) + 0.35 * exp(-pow(rv-819.2,2) / (2*1228.8*1228.8)) + 0.20 * greatest(0.0, 1 - sqrt(pow(ix*500.0-5120,2)+pow(iy*500.0-5120,2)) / 7680) - CASE WHEN rv < 25 THEN 0.5 ELSE 0 END, 4) AS score FROM q""")
def hub_score(spark, d):
    t = _surface(spark, d)
    t = t.join(F.broadcast(t.agg((F.max("slope") + 1e-9).alias("top"))))
    centre = F.greatest(F.lit(0.0), 1 - g.distance(F.col("ix") * 500.0, F.col("iy") * 500.0, 5120.0, 5120.0) / (v.EXTENT * 0.75))
    score = 0.45 * (1 - F.least(F.lit(1.0), F.col("slope") / F.col("top"))) + 0.35 * r.river_access(F.col("rv"), v.EXTENT) + 0.20 * centre - F.when(F.col("rv") < 25, 0.5).otherwise(0.0)
    return t.select("ix", "iy", r4(score).alias("score"))


@query("contour_hits", "cells", """WITH b AS (SELECT a.ix, a.iy, a.h AS h0, e.h AS h1, x.h AS h2, n.h AS h3 FROM cells a JOIN cells e ON e.ix=a.ix+1 AND e.iy=a.iy JOIN cells x ON x.ix=a.ix+1 AND x.iy=a.iy+1 JOIN cells n ON n.ix=a.ix AND n.iy=a.iy+1),
    l AS (SELECT k AS level_no, (SELECT min(h) FROM cells) + (SELECT max(h) - min(h) FROM cells) * k / 5.0::DOUBLE AS lv FROM (SELECT unnest(range(1, 5)) AS k)),
    e AS (SELECT level_no, ix, iy, e.edge, (lv - e.a) / (e.b - e.a) AS t FROM b, l, LATERAL (VALUES (0, h0, h1), (1, h1, h2), (2, h3, h2), (3, h0, h3)) e(edge, a, b) WHERE (e.a >= lv) <> (e.b >= lv))
    SELECT level_no, ix, iy, edge::BIGINT AS edge, round(t, 4) AS t FROM e""")
def contour_hits(spark, d):
    """The sides of squares that contours cross."""
    t = r.contours(v.cells(spark, d), 4).select("level_no", "ix", "iy", F.explode("edges").alias("e"))
    return t.select(F.col("level_no").cast("long").alias("level_no"), "ix", "iy", F.col("e.edge").cast("long").alias("edge"), r4("e.t").alias("t"))


def _side(k: int) -> str:
    """The end of a segment on a square's side, in SQL: x, y and the share of the way along it."""
    (ax, ay), (bx, by) = r._CORNERS[k], r._CORNERS[(k + 1) % 4]
    v0, v1 = f"h{k}", f"h{(k + 1) % 4}"
    w = f"least(1.0, greatest(0.0, CASE WHEN abs({v1} - {v0}) < 1e-9 THEN 0.5 ELSE (lv - {v0}) / ({v1} - {v0}) END))"
    return f"{{'x': (ix + {ax} + {bx - ax} * {w}) * 20.0::DOUBLE, 'y': (iy + {ay} + {by - ay} * {w}) * 20.0::DOUBLE}}"


_CASES = ", ".join(f"({case}, {part}, {i}, {j})" for case, pairs in r.CONTOUR_CASES.items() for part, (i, j) in enumerate(pairs))
_END = lambda c: f"CASE {c} WHEN 0 THEN {_side(0)} WHEN 1 THEN {_side(1)} WHEN 2 THEN {_side(2)} ELSE {_side(3)} END"


@query("contour_segments", "surface", f"""WITH b AS (SELECT a.ix, a.iy, a.h AS h0, e.h AS h1, x.h AS h2, n.h AS h3 FROM surface a JOIN surface e ON e.ix=a.ix+1 AND e.iy=a.iy JOIN surface x ON x.ix=a.ix+1 AND x.iy=a.iy+1 JOIN surface n ON n.ix=a.ix AND n.iy=a.iy+1),
    l AS (SELECT k AS level_no, lo + (hi - lo) * k / 5.0::DOUBLE AS lv, lo, hi FROM (SELECT min(h) AS lo, max(h) AS hi FROM surface), (SELECT unnest(range(1, 5)) AS k)),
    t(kind, part, i, j) AS (VALUES {_CASES}),
    g AS (SELECT *, {_END("i")} AS a, {_END("j")} AS z FROM b, l, t WHERE kind = (h0 >= lv)::INT * 8 + (h1 >= lv)::INT * 4 + (h2 >= lv)::INT * 2 + (h3 >= lv)::INT)
    SELECT level_no, ix, iy, part::BIGINT AS part, round((lv - lo) / (hi - lo), 6) AS share, round(a.x, 3) AS x0, round(a.y, 3) AS y0, round(z.x, 3) AS x1, round(z.y, 3) AS y1 FROM g""")
def contour_segments(spark, d):
    t = r.contour_segments(v.surface(spark, d), 4, 20.0)
    return t.select(F.col("level_no").cast("long").alias("level_no"), "ix", "iy", F.col("part").cast("long").alias("part"), F.round("share", 6).alias("share"), *(F.round(f"{e}.{c}", 3).alias(f"{c}{k}") for k, e in enumerate("ab") for c in "xy"))


@query("contour_lines", "surface")
def contour_lines(spark, d):
    """The contours of the whole surface as lines."""
    t = r.contour_lines(r.contour_segments(v.surface(spark, d), 4, 20.0))
    return t.select(F.col("level_no").cast("long").alias("level_no"), *(F.col(f"line.{c}").alias(f"line_{c}") for c in ("ix", "iy", "axis")), "seq", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


_LABEL = """RECURSIVE WITH k AS (SELECT ix, iy, iy * 1000000007 + ix AS k FROM cells WHERE h > 4500),
    e AS (SELECT a.k AS u, b.k AS v FROM k a JOIN k b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1),
    w(k, z) AS (SELECT k, k FROM k UNION SELECT e.v, w.z FROM w JOIN e ON e.u = w.k), z AS (SELECT k, min(z) AS zone FROM w GROUP BY k)"""


@query("label_zones", "cells", f"""{_LABEL}, x AS (SELECT min(ix) AS ax, max(ix) AS bx, min(iy) AS ay, max(iy) AS by_ FROM cells), t AS (SELECT zone, bool_or(ix IN (ax, bx) OR iy IN (ay, by_)) AS border FROM k JOIN z USING (k), x GROUP BY zone)
    SELECT ix, iy, zone, border FROM k JOIN z USING (k) JOIN t USING (zone)""")
def label_zones(spark, d):
    """Zones of cells, and whether a zone touches the border of the raster."""
    c = v.cells(spark, d)
    rim = c.agg(F.min("ix").alias("ax"), F.max("ix").alias("bx"), F.min("iy").alias("ay"), F.max("iy").alias("by"))
    z = r.label_zones(c.where("h > 4500")).select("ix", "iy", "zone")
    border = z.join(F.broadcast(rim)).groupBy("zone").agg(F.bool_or(F.col("ix").isin(F.col("ax"), F.col("bx")) | F.col("iy").isin(F.col("ay"), F.col("by"))).alias("border"))
    return z.join(border, "zone").select("ix", "iy", "zone", "border")


@query("filter_zones", "cells", f"""{_LABEL}, q AS (SELECT ix, iy, zone FROM k JOIN z USING (k)),
    r1 AS (SELECT *, ix - row_number() OVER (PARTITION BY zone, iy ORDER BY ix) AS run FROM q),
    r2 AS (SELECT ix, iy, zone, least(ix - min(ix) OVER w, max(ix) OVER w - ix) + 1 AS g FROM r1 WINDOW w AS (PARTITION BY zone, iy, run)),
    c1 AS (SELECT *, iy - row_number() OVER (PARTITION BY zone, ix ORDER BY iy) AS run FROM r2),
    c2 AS (SELECT zone, ix, iy, (SELECT min(o.g + abs(o.iy - c.iy)) FROM c1 o WHERE o.zone = c.zone AND o.ix = c.ix AND o.run = c.run) AS g, least(iy - min(iy) OVER w, max(iy) OVER w - iy) + 1 AS rim FROM c1 c WINDOW w AS (PARTITION BY zone, ix, run)),
    m AS (SELECT zone, max(least(g, rim)) AS depth, count(*) AS n_cells, min(ix) AS ax, max(ix) AS bx, min(iy) AS ay, max(iy) AS by_ FROM c2 GROUP BY zone),
    o AS (SELECT min(ix) AS oax, max(ix) AS obx, min(iy) AS oay, max(iy) AS oby FROM q),
    f AS (SELECT zone, n_cells, n_cells * 250000.0::DOUBLE AS area, (2 * depth - 1) * 500.0::DOUBLE AS width, greatest(bx - ax + 1, by_ - ay + 1) * 500.0::DOUBLE AS span, greatest(bx - ax + 1, by_ - ay + 1) / least(bx - ax + 1, by_ - ay + 1)::DOUBLE AS aspect FROM m, o WHERE ax <> oax AND bx <> obx AND ay <> oay AND by_ <> oby)
    SELECT zone, n_cells, area, width, span, round(aspect, 6) AS aspect, area > 1000000 OR span > 1400 OR aspect > 2.5 AS split FROM f WHERE area >= 250000 AND width >= 500""")
def filter_zones(spark, d):
    z = r.label_zones(v.cells(spark, d).where("h > 4500"))
    return r.filter_zones(z, float(S), 250_000.0, 500.0, 1400.0, 2.5, 1_000_000.0).withColumn("aspect", F.round("aspect", 6))


_COST = f"""RECURSIVE WITH c AS (SELECT * FROM cells), st AS (SELECT a.ix, a.iy, b.ix AS jx, b.iy AS jy, (CASE WHEN o.dx <> 0 AND o.dy <> 0 THEN sqrt(2.0) ELSE 1.0 END) * (1 + abs(b.h - a.h) / 5000.0::DOUBLE) AS w
    FROM c a CROSS JOIN {_OFF} JOIN c b ON b.ix = a.ix + o.dx AND b.iy = a.iy + o.dy),
    p(n, ix, iy, cost) AS (SELECT 0, ix, iy, 0.0::DOUBLE FROM (SELECT ix, iy FROM c ORDER BY iy, ix LIMIT 1) UNION ALL
    SELECT n + 1, ix, iy, min(cost) FROM (SELECT p.n, st.jx AS ix, st.jy AS iy, p.cost + st.w AS cost FROM p JOIN st ON st.ix = p.ix AND st.iy = p.iy UNION ALL SELECT n, ix, iy, cost FROM p) WHERE n < 60 GROUP BY n, ix, iy)"""


@query("cost_distance", "cells", f"{_COST} SELECT ix, iy, round(min(cost), 4) AS cost FROM p WHERE n = 60 GROUP BY ix, iy")
def cost_distance(spark, d):
    c = v.cells(spark, d)
    return r.cost_distance(c, c.orderBy("iy", "ix").limit(1), 1 + F.abs(F.col("h2") - F.col("h")) / 5000.0).select("ix", "iy", r4("cost").alias("cost"))


_SLOPE_WEIGHT, _WATER = routes.ROUTE_FACTORS["minor_local"]


def _route_cells(spark, d):
    """The open cells of the surface: field, ix, iy, rate, toll."""
    s = v.surface(spark, d)
    steep = r.slope(s.select("ix", "iy", "h"), 20.0).select("ix", "iy", "h", "slope")
    top = steep.agg(F.max("slope").alias("top"))
    t = steep.join(s.where("open").select("ix", "iy"), ["ix", "iy"]).join(F.broadcast(top)).withColumn("steep", F.col("slope") / (F.col("top") + 1e-9))
    return t.select(F.lit(0).cast("long").alias("field"), "ix", "iy", routes.route_rate(F.col("steep"), _SLOPE_WEIGHT).alias("rate"), F.when(F.col("h") < 30, _WATER).otherwise(0.0).alias("toll"))


def _route_sources(spark, d):
    """The first open cell of the surface."""
    t = v.surface(spark, d).where("open").agg(F.min(F.struct("iy", "ix")).alias("c"))
    return t.select(F.lit(0).cast("long").alias("field"), "c.ix", "c.iy")


_ROUTES = f"""RECURSIVE WITH g AS (SELECT ix, iy, h, open, CASE WHEN e IS NOT NULL AND w IS NOT NULL THEN (e - w) / 40.0::DOUBLE WHEN e IS NOT NULL THEN (e - h) / 20.0::DOUBLE WHEN w IS NOT NULL THEN (h - w) / 20.0::DOUBLE ELSE 0.0 END AS gx,
      CASE WHEN s IS NOT NULL AND n IS NOT NULL THEN (s - n) / 40.0::DOUBLE WHEN s IS NOT NULL THEN (s - h) / 20.0::DOUBLE WHEN n IS NOT NULL THEN (h - n) / 20.0::DOUBLE ELSE 0.0 END AS gy
      FROM (SELECT *, lead(h) OVER a AS e, lag(h) OVER a AS w, lead(h) OVER b AS s, lag(h) OVER b AS n FROM surface WINDOW a AS (PARTITION BY iy ORDER BY ix), b AS (PARTITION BY ix ORDER BY iy))),
    p AS MATERIALIZED (SELECT *, sqrt(gx * gx + gy * gy) / ((SELECT max(sqrt(gx * gx + gy * gy)) FROM g) + 1e-9::DOUBLE) AS steep FROM g WHERE open),
    c AS MATERIALIZED (SELECT ix, iy, 1.0::DOUBLE + {_SLOPE_WEIGHT}::DOUBLE * (steep * steep) AS rate, CASE WHEN h < 30 THEN {_WATER}::DOUBLE ELSE 0.0::DOUBLE END AS toll FROM p),
    s AS (SELECT m.ix, m.iy FROM (SELECT min({{'iy': iy, 'ix': ix}}) AS m FROM p)),
    o AS (SELECT dx, dy, CASE WHEN dx <> 0 AND dy <> 0 THEN sqrt(2.0::DOUBLE) ELSE 1.0 END AS len FROM {_OFF}),
    st AS MATERIALIZED (SELECT a.iy * 100000 + a.ix AS k, c.iy * 100000 + c.ix AS j, o.len * c.rate + c.toll AS step FROM c a, o JOIN c ON c.ix = a.ix + o.dx AND c.iy = a.iy + o.dy),
    w(k, cost) USING KEY (k) AS (SELECT iy * 100000 + ix, 0.0::DOUBLE FROM s UNION
      SELECT n.j, n.cost FROM (SELECT st.j, min(w.cost + st.step) AS cost FROM w JOIN st ON st.k = w.k GROUP BY st.j) n LEFT JOIN recurring.w old ON old.k = n.j WHERE old.cost IS NULL OR n.cost < old.cost),
    r AS MATERIALIZED (SELECT k, cost FROM w)"""


@query("route_costs", "surface", f"{_ROUTES} SELECT k % 100000 AS ix, k // 100000 AS iy, round(cost, 4) AS cost FROM r")
def route_costs(spark, d):
    return routes.route_costs(_route_cells(spark, d), _route_sources(spark, d)).select("ix", "iy", r4("cost").alias("cost"))


@query("route_paths", "surface", f"""{_ROUTES}, b AS MATERIALIZED (SELECT j, k FROM (SELECT st.j, st.k, row_number() OVER (PARTITION BY st.j ORDER BY r.cost + st.step, st.k) AS n FROM st JOIN r ON r.k = st.k) WHERE n = 1 AND j NOT IN (SELECT iy * 100000 + ix FROM s)),
    q AS (SELECT s_suppkey AS path, (s_suppkey * 104729) % w * 100000 + (s_suppkey * 7919) % w AS k FROM supplier, (SELECT floor(sqrt(count(*) * 4))::BIGINT AS w FROM orders)),
    t(path, n, k) AS (SELECT path, 0::BIGINT, k FROM q WHERE k IN (SELECT k FROM r) UNION ALL SELECT path, n + 1, b.k FROM t JOIN b ON b.j = t.k)
    SELECT path, max(n) OVER (PARTITION BY path) - n AS seq, t.k % 100000 AS ix, t.k // 100000 AS iy, round(cost, 4) AS cost FROM t JOIN r USING (k)""")
def route_paths(spark, d):
    """The ways to every supplier's cell."""
    width = v.table(spark, d, "orders").agg(F.floor(F.sqrt(F.count("*") * 4)).cast("long").alias("w"))
    k = F.col("s_suppkey").cast("long")
    goals = v.table(spark, d, "supplier").join(F.broadcast(width)).select(k.alias("path"), F.lit(0).cast("long").alias("field"), (k * 7919 % F.col("w")).alias("ix"), (k * 104729 % F.col("w")).alias("iy"))
    t = routes.route_paths(_route_cells(spark, d), _route_sources(spark, d), goals)
    return t.select("path", "seq", "ix", "iy", r4("cost").alias("cost"))


@query("structure_tensor", "cells seg", """WITH s AS (SELECT floor((x0+x1)/2/500)::BIGINT AS ix, floor((y0+y1)/2/500)::BIGINT AS iy, (x1-x0) AS dx, (y1-y0) AS dy FROM seg),
    t AS (SELECT ix, iy, sum(dx*dx) AS xx, sum(dx*dy) AS xy, sum(dy*dy) AS yy FROM s GROUP BY ALL)
    SELECT ix, iy, round(CASE WHEN degrees(atan2(xy, (xx-yy)/2)/2) < 0 THEN degrees(atan2(xy, (xx-yy)/2)/2) + 180 ELSE degrees(atan2(xy, (xx-yy)/2)/2) END, 4) AS angle, round(2*sqrt((xx-yy)/2*(xx-yy)/2 + xy*xy)/(xx+yy), 4) AS anisotropy FROM t JOIN cells USING (ix, iy)""")
def structure_tensor(spark, d):
    at = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / 500).cast("long")
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    t = v.seg(spark, d).groupBy(at("x0", "x1").alias("ix"), at("y0", "y1").alias("iy")).agg(F.sum(dx * dx).alias("xx"), F.sum(dx * dy).alias("xy"), F.sum(dy * dy).alias("yy"))
    angle, aniso = r.principal_axis(F.col("xx"), F.col("xy"), F.col("yy"))
    return t.join(v.cells(spark, d), ["ix", "iy"]).select("ix", "iy", r4(angle).alias("angle"), r4(aniso).alias("anisotropy"))


@query("adaptive_threshold", "surface", f"""{_ACC.replace("cells", "surface")}, top AS (SELECT max(acc) AS top, count(*) AS n FROM a),
    th(tries, threshold, coverage) AS (SELECT 0::BIGINT, 0.2::DOUBLE, (SELECT count(*) FROM a, top WHERE acc >= 0.2::DOUBLE * top) / (SELECT n FROM top)::DOUBLE UNION ALL
      SELECT tries + 1, t, (SELECT count(*) FROM a, top WHERE acc >= t * top) / (SELECT n FROM top)::DOUBLE FROM (SELECT tries, CASE WHEN coverage < 0.1 THEN greatest(1e-5, threshold * 0.75::DOUBLE) ELSE least(0.25, threshold * 1.15::DOUBLE) END AS t FROM th WHERE tries < 4 AND NOT coverage BETWEEN 0.1 AND 0.3))
    SELECT tries, round(threshold, 9) AS threshold, round(coverage, 9) AS coverage, coverage BETWEEN 0.1 AND 0.3 AS fits FROM th ORDER BY tries DESC LIMIT 1""")
def adaptive_threshold(spark, d):
    """The share of the largest flow at which rivers cover 10 to 30 % of the surface, after four tries at most."""
    t = r.adaptive_threshold(r.flow_accumulation(r.flow_direction(v.surface(spark, d))), 0.2)
    return t.select("tries", F.round("threshold", 9).alias("threshold"), F.round("coverage", 9).alias("coverage"), "fits")
