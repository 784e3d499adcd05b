"""Land use by its rules, patches that nothing covers, costs of lines, rates of traces, layers to fall back on."""

import math

import pytest
from meridion.operators import landuse, polyline, stats

ROADS = "id long, road_class string, culdesac boolean, x0 double, y0 double, x1 double, y1 double"
SITES = "id long, x double, y double, kind string, quality double, radius double"


def _uses(spark, zones, flood=(), rivers=(), roads=(), hubs=(), sites=()):
    make = lambda rows, ddl: spark.createDataFrame(list(rows), ddl)
    t = landuse.classify_zones(
        make(zones, "id long, x double, y double, area double"), make(flood, "ix long, iy long, flood double"), 100.0, make(rivers, "id long, x double, y double"), make(roads, ROADS),
        make(hubs, "id long, x double, y double, tier int"), make(sites, SITES),
    )
    return {r.id: r.land_use for r in t.collect()}


def test_uses_where_there_is_nothing(spark):
    assert _uses(spark, [(1, 50.0, 50.0, 500.0), (2, 50.0, 50.0, 9000.0)]) == {1: "residential_candidate", 2: "green_candidate"}
    assert _uses(spark, []) == {}


def test_flood_and_culdesacs_decide(spark):
    zones = [(1, 50.0, 50.0, 9000.0), (2, 150.0, 50.0, 9000.0), (3, 900.0, 900.0, 9000.0), (4, 910.0, 600.0, 9000.0)]
    roads = [(1, "minor_local", True, 900.0, 880.0, 900.0, 800.0), (2, "minor_local", False, 910.0, 620.0, 990.0, 700.0), (3, "arterial", False, 0.0, 5000.0, 10.0, 5000.0)]
    got = _uses(spark, zones, [(0, 0, 0.7), (1, 0, 0.6)], (), roads)
    # Risk above 0.6; none that is high and nothing near; a culdesac's end near; only a through street near.
    assert got == {1: "green_candidate", 2: "green_candidate", 3: "residential_candidate", 4: "residential_candidate"}
    far = [(5, 500.0, 500.0, 30_000.0)]
    assert _uses(spark, far, [], (), [(1, "arterial", False, 480.0, 500.0, 480.0, 600.0)], [(1, 900.0, 500.0, 1)]) == {5: "industrial_candidate"}
    assert _uses(spark, far, [], (), [(1, "arterial", False, 480.0, 500.0, 480.0, 600.0)], [(1, 600.0, 500.0, 1)]) == {5: "commercial_candidate"}
    assert _uses(spark, far, [], (), [], [], [(1, 510.0, 500.0, "ore", 0.9, 200.0)]) == {5: "public_facility_candidate"}
    assert _uses(spark, far, [], [(1, 505.0, 500.0)]) == {5: "green_candidate"}


def test_patches(spark):
    cells = spark.createDataFrame([(x, y) for x in range(6) for y in range(3)], "ix long, iy long")
    wall = spark.createDataFrame([(1, 25.0, 0.0, 25.0, 30.0)], "id long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r.n_cells, r.area) for r in landuse.uncovered_patches(cells, wall, 10.0, 4.0, 0.0).collect())
    assert got == [(6, 600.0), (9, 900.0)]  # the column at 25 is covered and parts the rest
    assert landuse.uncovered_patches(cells, wall, 10.0, 4.0, 700.0).count() == 1


def test_segment_costs_against_samples(spark):
    cells = {(x, y): (float((x * 7 + y * 3) % 5), (x + y) % 4 == 0) for x in range(10) for y in range(9)}
    rows = [(1, 0, 3.0, 4.0, 95.0, 60.0), (1, 1, 95.0, 60.0, 20.0, 88.0), (2, 0, 5.0, 5.0, 5.0, 5.0), (3, 0, 90.0, 20.0, 140.0, 20.0)]
    segs = spark.createDataFrame([(*r, math.dist(r[2:4], r[4:])) for r in rows], "line_id long, seq long, x0 double, y0 double, x1 double, y1 double, len double")
    raster = spark.createDataFrame([(*k, *x) for k, x in cells.items()], "ix long, iy long, slope double, wet boolean")
    got = {(r.line_id, r.seq): r for r in polyline.segment_costs(segs, raster, 10.0, 640.0, 0.5, 30.0).collect()}
    assert set(got) == {(1, 0), (1, 1), (3, 0)}  # a segment without length has no cost
    for line, seq, x0, y0, x1, y1 in rows:
        if (line, seq) not in got:
            continue
        length = math.dist((x0, y0), (x1, y1))
        n = max(8, int(length / 10))
        seen = [cells.get((math.floor((x0 + (x1 - x0) * (k / n)) / 10), math.floor((y0 + (y1 - y0) * (k / n)) / 10)), (0.0, False)) for k in range(n + 1)]
        slope = sum(s for s, _ in seen) / len(seen) / (4 + 1e-9)
        crossings = sum(a[1] != b[1] for a, b in zip(seen, seen[1:])) // 2
        r = got[line, seq]
        assert r.crossings == crossings and r.slope == pytest.approx(slope) and r.cost == pytest.approx(length * (1 + 0.5 * slope) + crossings * 30)
    lines = {r.line_id: r.cost for r in polyline.line_costs(polyline.segment_costs(segs, raster, 10.0, 640.0, 0.5, 30.0)).collect()}
    assert lines[1] == pytest.approx(got[1, 0].cost + got[1, 1].cost)


def test_trace_rates(spark):
    rows = [("a", 100.0, True, None, 500.0), ("a", 500.0, True, "target", 500.0), ("a", 500.0, False, "target", 500.0), ("a", 3500.0, False, None, 500.0), ("a", 500.0, False, "boundary", 500.0), ("a", 500.0, False, "target", 10.0), ("b", 50.0, False, "boundary", None)]
    t = spark.createDataFrame(rows, "g string, length_m double, culdesac boolean, reason string, block_axis double")
    got = {r.g: r for r in stats.trace_rates(t, ["g"], 300.0, 900.0, 200.0).collect()}
    a = got["a"]
    assert (a.n, a.short, a.in_band, a.long) == (6, pytest.approx(1 / 6), pytest.approx(4 / 6), pytest.approx(1 / 6))
    assert (a.over_1km, a.over_3km, a.culdesac_short, a.strict_band) == (pytest.approx(1 / 6), pytest.approx(1 / 6), 0.5, 0.5)
    assert (got["b"].culdesac_short, got["b"].strict_band) == (0.0, 0.0)


def test_fallback_layers_keep_what_is_known(spark):
    rows = [(0, 0, 1.0, 0.0, 0.3, None, None), (1, 0, 3.0, 10.0, None, None, 0.9)]
    t = landuse.fallback_layers(spark.createDataFrame(rows, "ix long, iy long, suit double, accum double, flood double, population double, green double"))
    got = {r.ix: (r.flood, r.population, r.green, r.degraded) for r in t.collect()}
    assert got == {0: (0.3, 0.25, 0.45, ["population", "green"]), 1: (1.0, 0.75, 0.9, ["flood", "population"])}
