"""Land use, coverage, costs of lines over a raster and layers to fall back on."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.operators import landuse
from meridion.operators import polyline as p
from meridion.operators import raster as r
from meridion.operators import stats
from meridion.plans import views as v
from meridion.plans.polylines import _SEG
from meridion.plans.rasters import _GRAD, _SUIT, _suitability
from meridion.plans.registry import query


def r4(c):
    return F.round(c, 4)


_ZT = "coalesce(least(1.0, greatest(0.0, ((z.cx-s.x0)*(s.x1-s.x0)+(z.cy-s.y0)*(s.y1-s.y0)) / nullif((s.x1-s.x0)*(s.x1-s.x0)+(s.y1-s.y0)*(s.y1-s.y0), 0))), 0)"
_USES = f"""{_SUIT}, rw AS (SELECT zone_id, min(sqrt(pow(cx-s.x,2)+pow(cy-s.y,2))) AS river, sum(CASE s.kind WHEN 0 THEN 0.35 WHEN 1 THEN 0.7 WHEN 2 THEN 1.0 ELSE 0.25 END::DOUBLE * greatest(0.0, 1 - sqrt(pow(cx-s.x,2)+pow(cy-s.y,2)) / 1050) * quality) AS res FROM zones, sites s GROUP BY 1),
    w AS (SELECT zone_id, min(d) AS hub, arg_min(tier, (d, id)) AS tier FROM (SELECT zone_id, h.id, h.tier, sqrt(pow(cx-h.x,2)+pow(cy-h.y,2)) AS d FROM zones, hubs h) GROUP BY 1),
    rr AS (SELECT z.zone_id, s.id % 3 AS c, min(sqrt(pow(z.cx-(s.x0+{_ZT}*(s.x1-s.x0)),2)+pow(z.cy-(s.y0+{_ZT}*(s.y1-s.y0)),2))) AS d FROM zones z, seg s GROUP BY ALL),
    cu AS (SELECT zone_id, min(sqrt(pow(cx-x,2)+pow(cy-y,2))) AS cul FROM zones, (SELECT x0 AS x, y0 AS y FROM seg WHERE id % 3 = 2 AND id % 4 = 0 UNION ALL SELECT x1, y1 FROM seg WHERE id % 3 = 2 AND id % 4 = 0) GROUP BY 1),
    a AS (SELECT z.zone_id, z.cx, z.cy, z.area, coalesce(su.flood, 0) AS flood, river, res, hub, tier, cul, r0.d AS art, r1.d AS col, r2.d AS loc FROM zones z JOIN rw USING (zone_id) JOIN w USING (zone_id) JOIN cu USING (zone_id) LEFT JOIN su ON su.ix = floor(z.cx / 500) AND su.iy = floor(z.cy / 500)
      JOIN rr r0 ON r0.zone_id = z.zone_id AND r0.c = 0 JOIN rr r1 ON r1.zone_id = z.zone_id AND r1.c = 1 JOIN rr r2 ON r2.zone_id = z.zone_id AND r2.c = 2),
    us AS (SELECT zone_id, cx, cy, CASE WHEN flood > 0.6 OR river < 12 THEN 'green_candidate' WHEN area > 20000 AND art < 30 AND hub > 180 THEN 'industrial_candidate' WHEN (art < 35 OR col < 24) AND tier <= 2 AND area > 1200 THEN 'commercial_candidate'
      WHEN area > 6000 AND (res > 0.45 OR hub < 160) THEN 'public_facility_candidate' WHEN cul < 35 AND art > 55 THEN 'residential_candidate' WHEN loc > 65 AND col > 55 AND area > 8000 THEN 'green_candidate' ELSE 'residential_candidate' END AS land_use FROM a)"""


def _uses(spark, d):
    k = F.col("id")
    roads = v.seg(spark, d).select("id", F.when(k % 3 == 0, "arterial").when(k % 3 == 1, "major_local").otherwise("minor_local").alias("road_class"), (k % 4 == 0).alias("culdesac"), "x0", "y0", "x1", "y1")
    kind = F.element_at(F.array(*map(F.lit, landuse.KIND_SHARES)), (F.col("kind") + 1).cast("int"))
    sites = v.sites(spark, d).withColumn("kind", kind)
    zones = v.zones(spark, d).select(F.col("zone_id").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")
    return landuse.classify_zones(zones, _suitability(spark, d), float(v.CELL), sites.select("id", "x", "y"), roads, v.hubs(spark, d), sites)


@query("classify_zones", "zones cells sites hubs seg", f"{_USES} SELECT zone_id, land_use FROM us")
def classify_zones(spark, d):
    return _uses(spark, d).select(F.col("id").alias("zone_id"), "land_use")


@query("classify_blocks", "zones cells sites hubs seg", f"{_USES} SELECT block, arg_min(land_use, (-n, land_use)) AS land_use, max(n) AS n FROM (SELECT floor(cy / 1000)::BIGINT * 100 + floor(cx / 1000)::BIGINT AS block, land_use, count(*) AS n FROM us GROUP BY ALL) GROUP BY block")
def classify_blocks(spark, d):
    """The land use of most zones in each square of 1 km."""
    at = lambda c: F.floor(F.col(c) / 1000).cast("long")
    blocks = v.zones(spark, d).select(F.col("zone_id").alias("id"), (at("cy") * 100 + at("cx")).alias("block"))
    return stats.dominant(_uses(spark, d).join(blocks, "id"), ["block"], "land_use").select("block", F.col("dominant").alias("land_use"), F.col("weight").alias("n"))


@query("uncovered_patches", "surface seg", """RECURSIVE WITH cg AS (SELECT s.*, unnest(range(floor((least(x0,x1)-30)/40)::BIGINT, floor((greatest(x0,x1)+30)/40)::BIGINT + 1)) AS ix FROM seg s), ch AS (SELECT *, unnest(range(floor((least(y0,y1)-30)/40)::BIGINT, floor((greatest(y0,y1)+30)/40)::BIGINT + 1)) AS iy FROM cg),
    ct AS (SELECT *, (ix+0.5)*40::DOUBLE AS px, (iy+0.5)*40::DOUBLE AS py FROM ch), cp AS (SELECT *, coalesce(least(1.0, greatest(0.0, ((px-x0)*(x1-x0)+(py-y0)*(y1-y0)) / nullif((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0), 0))), 0) AS t FROM ct),
    cv AS (SELECT DISTINCT ix, iy FROM cp WHERE sqrt(pow(px-(x0+t*(x1-x0)),2)+pow(py-(y0+t*(y1-y0)),2)) <= 30),
    un AS MATERIALIZED (SELECT ix, iy, iy * 1000000007 + ix AS k FROM (SELECT ix, iy FROM surface WHERE open) ANTI JOIN cv USING (ix, iy)),
    nb AS MATERIALIZED (SELECT a.k, b.k AS k2 FROM un a JOIN un b ON (b.ix = a.ix + 1 AND b.iy = a.iy) OR (b.ix = a.ix - 1 AND b.iy = a.iy) OR (b.ix = a.ix AND b.iy = a.iy + 1) OR (b.ix = a.ix AND b.iy = a.iy - 1)),
    wk(k, c) AS (SELECT k, k FROM un UNION SELECT nb.k2, wk.c FROM wk JOIN nb USING (k)), lb AS (SELECT k, min(c) AS zone FROM wk GROUP BY 1)
    SELECT zone, count(*) AS n_cells, count(*) * 1600.0::DOUBLE AS area, max(ix) - min(ix) + 1 AS wide, max(iy) - min(iy) + 1 AS high FROM un JOIN lb USING (k) GROUP BY zone HAVING count(*) >= 3""")
def uncovered_patches(spark, d):
    """Open cells of 40 m that no segment is within 30 m of, in patches of 4800 square metres and more."""
    t = landuse.uncovered_patches(v.surface(spark, d).where("open"), v.seg(spark, d), 40.0, 30.0, 4800.0)
    return t.select("zone", "n_cells", "area", (F.col("max_x") - F.col("min_x") + 1).alias("wide"), (F.col("max_y") - F.col("min_y") + 1).alias("high"))


_STEEP = _GRAD.removeprefix("WITH ").replace("FROM cells c LEFT", "FROM fine c LEFT").replace("JOIN cells", "JOIN fine").replace("1000.0", "20.0").replace("500.0", "10.0")


@query("line_costs", "verts surface", f"""WITH fine AS (SELECT ix, iy, h FROM surface), {_STEEP}, sl AS (SELECT ix, iy, sqrt(gx*gx+gy*gy) AS slope, h >= 250 AS wet FROM g), {_SEG.replace("g AS", "sg AS", 1)},
    k AS (SELECT *, unnest(range(n + 1)) AS k FROM (SELECT *, greatest(8, floor(len / 16)::BIGINT) AS n FROM sg)),
    m AS (SELECT line_id, seq, k, len, coalesce(slope, 0) AS slope, coalesce(wet, false) AS wet FROM k LEFT JOIN sl ON sl.ix = floor((x0 + (x1 - x0) * (k / n::DOUBLE)) / 10) AND sl.iy = floor((y0 + (y1 - y0) * (k / n::DOUBLE)) / 10)),
    t AS (SELECT *, wet <> lag(wet) OVER (PARTITION BY line_id, seq ORDER BY k) AS turned FROM m),
    c AS (SELECT line_id, seq, any_value(len) AS len, avg(slope) / ((SELECT max(slope) FROM sl) + 1e-9::DOUBLE) AS slope, count(*) FILTER (turned) // 2 AS crossings FROM t GROUP BY ALL)
    SELECT line_id, round(sum(len), 3) AS length, sum(crossings)::BIGINT AS crossings, round(sum(len * (1 + 0.5 * slope) + crossings * 40), 3) AS cost FROM c GROUP BY line_id""")
def line_costs(spark, d):
    """What each line costs by length, slope and the rivers that it crosses."""
    cells = r.slope(v.surface(spark, d).select("ix", "iy", "h"), 10.0).withColumn("wet", F.col("h") >= 250)
    t = p.line_costs(p.segment_costs(p.segmentize(v.verts(spark, d)), cells, 10.0, 1024.0, 0.5, 40.0))
    return t.select("line_id", F.round("length", 3).alias("length"), "crossings", F.round("cost", 3).alias("cost"))


_REASONS = (*stats.EXEMPT_REASONS, "max_length", "target")


@query("trace_rates", "verts", f"""WITH {_SEG}, l AS (SELECT line_id, sum(len) AS m, line_id % 4 = 0 AS cul, {list(_REASONS)}[line_id % 7 + 1] AS reason, 80 + line_id % 11 * 40 AS axis FROM g GROUP BY line_id), f AS (SELECT *, NOT cul AND axis >= 200 AND reason IN ('max_length', 'target') AS strict FROM l)
    SELECT line_id % 5 AS grp, count(*) AS n, round(avg((m < 1500)::INT), 6) AS short, round(avg((m BETWEEN 1500 AND 4000)::INT), 6) AS in_band, round(avg((m > 4000)::INT), 6) AS long, round(avg((m > 1000)::INT), 6) AS over_1km, round(avg((m > 3000)::INT), 6) AS over_3km,
      round(coalesce(avg((m < 1500)::INT) FILTER (cul), 0), 6) AS culdesac_short, round(coalesce(avg((m BETWEEN 1500 AND 4000)::INT) FILTER (strict), 0), 6) AS strict_band FROM f GROUP BY grp""")
def trace_rates(spark, d):
    k = F.col("line_id")
    t = p.segmentize(v.verts(spark, d)).groupBy("line_id").agg(F.sum("len").alias("length_m"))
    t = t.select((k % 5).alias("grp"), "length_m", (k % 4 == 0).alias("culdesac"), F.element_at(F.array(*map(F.lit, _REASONS)), (k % 7 + 1).cast("int")).alias("reason"), (80 + k % 11 * 40).cast("double").alias("block_axis"))
    got = stats.trace_rates(t, ["grp"], 1500.0, 4000.0, 200.0)
    return got.select("grp", "n", *(F.round(c, 6).alias(c) for c in got.columns[2:]))


@query("fallback_layers", "surface", """WITH s AS (SELECT ix, iy, h AS suit, (ix * 31 + iy * 17) % 101 AS accum, CASE WHEN (ix + iy) % 3 = 0 THEN h / 1000 END AS flood, CASE WHEN ix % 2 = 0 THEN 0.5 END::DOUBLE AS population, NULL::DOUBLE AS green FROM surface),
    n AS (SELECT ix, iy, flood, population, (suit - min(suit) OVER ()) / greatest(1e-6, max(suit) OVER () - min(suit) OVER ())::DOUBLE AS su, (accum - min(accum) OVER ()) / greatest(1e-6, max(accum) OVER () - min(accum) OVER ())::DOUBLE AS ac FROM s)
    SELECT ix, iy, round(coalesce(flood, ac), 6) AS flood, round(coalesce(population, 0.75 * su + 0.25 * (1 - ac)), 6) AS population, round(0.55 * ac + 0.45 * (1 - su), 6) AS green, CASE WHEN flood IS NULL THEN 'flood ' ELSE '' END || CASE WHEN population IS NULL THEN 'population ' ELSE '' END || 'green' AS degraded FROM n""")
def fallback_layers(spark, d):
    x, y = F.col("ix"), F.col("iy")
    made = {"suit": F.col("h"), "accum": ((x * 31 + y * 17) % 101).cast("double"), "flood": F.when((x + y) % 3 == 0, F.col("h") / 1000), "population": F.when(x % 2 == 0, 0.5), "green": F.lit(None).cast("double")}
    t = landuse.fallback_layers(v.surface(spark, d).select("ix", "iy", *(c.alias(n) for n, c in made.items())))
    return t.select("ix", "iy", *(F.round(n, 6).alias(n) for n in ("flood", "population", "green")), F.concat_ws(" ", "degraded").alias("degraded"))


@query("fallback_traffic", "edges", """WITH e AS (SELECT *, 1 - (weight - least(min(weight) OVER (), 0)) / greatest(1e-6, greatest(max(weight) OVER (), 1) - least(min(weight) OVER (), 0))::DOUBLE AS light FROM edges),
    f AS (SELECT id, road_class, CASE road_class WHEN 'arterial' THEN 150 WHEN 'major_local' THEN 90 ELSE 45 END * (0.3::DOUBLE + light) AS flow, CASE road_class WHEN 'arterial' THEN 1100 WHEN 'major_local' THEN 700 ELSE 420 END * greatest(0.6, least(1.8, length_m / 140))::DOUBLE AS capacity FROM e)
    SELECT id, road_class, round(flow, 4) AS flow, round(capacity, 4) AS capacity, round(flow / capacity, 4) AS congestion FROM f""")
def fallback_traffic(spark, d):
    return landuse.fallback_traffic(v.edges(spark, d)).select("id", "road_class", r4("flow").alias("flow"), r4("capacity").alias("capacity"), r4("congestion").alias("congestion"))
