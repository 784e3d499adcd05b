"""Spatial searches where shapes lie close on each other: the right rows, and no pairs without need."""

import math
import random

from meridion.operators import spatial as sp
from pyspark.sql import functions as F


def _square(k, x, y, h):
    return (k, [(x - h, y - h), (x + h, y - h), (x + h, y + h), (x - h, y + h)])


RING = "zone_id long, ring array<struct<x: double, y: double>>"


def test_zones_behind_one_that_holds_the_cell_are_not_filed_there(spark):
    rng = random.Random(1)
    squares = [(k, rng.uniform(0, 100), rng.uniform(0, 100), rng.uniform(1, 90)) for k in range(400)]
    zones = spark.createDataFrame([_square(*q) for q in squares], RING)
    points = [(k, rng.uniform(-20, 120), rng.uniform(-20, 120)) for k in range(300)]
    got = {r.id: r.zone_id for r in sp.points_in_zones(spark.createDataFrame(points, "id long, x double, y double"), zones, 20.0).collect()}
    want = {k: [z for z, cx, cy, h in squares if cx - h <= x < cx + h and cy - h <= y < cy + h] for k, x, y in points}
    assert got == {k: min(z) for k, z in want.items() if z}
    inner = sp.zones_by_cell(zones, 20.0).where("_cx between 0 and 4 and _cy between 0 and 4").groupBy("_cx", "_cy").count()
    assert inner.agg(F.max("count")).head()[0] < 60  # of 400


def test_a_slanted_ring_does_not_hold_cells_that_it_cuts(spark):
    zones = spark.createDataFrame([(1, [(0.0, -50.0), (50.0, 0.0), (0.0, 50.0), (-50.0, 0.0)]), (2, [(-60.0, -60.0), (60.0, -60.0), (60.0, 60.0), (-60.0, 60.0)])], RING)
    points = [(k, -59.3 + k % 12 * 10, -59.5 + k // 12 * 10) for k in range(144)]
    got = {r.id: r.zone_id for r in sp.points_in_zones(spark.createDataFrame(points, "id long, x double, y double"), zones, 10.0).collect()}
    assert got == {k: 1 if abs(x) + abs(y) < 50 else 2 for k, x, y in points}


def _segments(rng, n, span):
    return [(k, *(p := (rng.uniform(0, span), rng.uniform(0, span))), p[0] + rng.uniform(-60, 60), p[1] + rng.uniform(-60, 60) * (k % 7 > 0)) for k in range(n)]


def _away(x, y, s):
    _, x0, y0, x1, y1 = s
    n = (x1 - x0) ** 2 + (y1 - y0) ** 2
    t = min(1.0, max(0.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / n)) if n else 0.0
    return math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), x0 + t * (x1 - x0), y0 + t * (y1 - y0)


def test_segments_are_filed_along_their_course(spark):
    one = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 5.0, 0.0, 5.0, 100.0)], "seg long, x0 double, y0 double, x1 double, y1 double")
    n = {r.seg: r["count"] for r in sp._along(one, 1.0, 10.0).groupBy("seg").count().collect()}
    assert n[1] < 50 and n[2] < 15  # the box of the first has 144 cells


def test_nearest_segments_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = _segments(rng, 300, 200)
    s = spark.createDataFrame(rows, "seg long, x0 double, y0 double, x1 double, y1 double")
    points = [(k, rng.uniform(-100, 300), rng.uniform(-100, 300)) for k in range(60)] + [(60, 2500.0, -900.0)]
    p = spark.createDataFrame(points, "id long, x double, y double")
    got = {}
    for r in sp.nearest_segment(p, s, 100.0, 5).collect():
        got.setdefault(r.id, {})[r.rank] = r.seg
    for k, x, y in points:
        assert [got[k][i] for i in range(1, 6)] == [q[0] for q in sorted(rows, key=lambda q: (_away(x, y, q)[0], q[0]))[:5]]
    assert sp._start(300, 200.0, 200.0, 40.0, 1, 100.0) < 30  # 100 m would meet most of the table


def test_the_lowest_class_in_reach_goes_before_a_nearer_one(spark):
    rng = random.Random(3)
    rows = _segments(rng, 120, 400)
    s = spark.createDataFrame(rows, "seg long, x0 double, y0 double, x1 double, y1 double").withColumn("class", F.col("seg") % 3)
    points = [(k, rng.uniform(0, 400), rng.uniform(0, 400)) for k in range(50)]
    inner = (F.hypot(F.col("px") - F.col("x0"), F.col("py") - F.col("y0")) > 5) & (F.hypot(F.col("px") - F.col("x1"), F.col("py") - F.col("y1")) > 5)
    found = sp.first_class_segment(spark.createDataFrame(points, "id long, x double, y double"), s, 100.0, 30.0, inner)
    want = {}
    for k, x, y in points:
        fit = [(q[0] % 3, d, q[0]) for q in rows for d, px, py in [_away(x, y, q)] if d <= 30 and math.hypot(px - q[1], py - q[2]) > 5 and math.hypot(px - q[3], py - q[4]) > 5]
        if fit:
            want[k] = min(fit)[2]
    assert {r.id: r.seg for r in found.collect()} == want and len(want) > 20


def test_points_go_to_the_nearest_anchor_in_reach_only(spark):
    rng = random.Random(4)
    anchors = [(k, k % 3, float(rng.randrange(60)), float(rng.randrange(60))) for k in range(500)]
    points = [(k, float(rng.randrange(-40, 100)), float(rng.randrange(-40, 100))) for k in range(80)]
    found = sp.snap(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(anchors, "anchor long, rank long, x double, y double"), 25.0)
    want = {}
    for k, x, y in points:
        d, _, a = min((math.hypot(x - ax, y - ay), r, a) for a, r, ax, ay in anchors)
        want[k] = a if d <= 25 else None
    assert {r.id: r.anchor for r in found.collect()} == want
    assert sp._start(500, 60.0, 60.0, 0.0, 1, 25.0) < 10


def test_spaced_points_are_those_of_one_pass_and_rounds_are_few(spark):
    rng = random.Random(5)
    rows = [(k, float(rng.randrange(300)), float(rng.randrange(300)), float(rng.randrange(1, 40))) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, x double, y double, score double")
    kept = []
    for k, x, y, _ in sorted(rows, key=lambda r: (-r[3], r[0])):
        if all(math.hypot(x - a, y - b) >= 40 for _, a, b in kept):
            kept.append((k, x, y))
    assert [r.id for r in sp.spaced_top_k(df, 40.0, 10).collect()] == [k for k, _, _ in kept[:10]]
    assert {r.id for r in sp.spaced_top_k(df, 40.0, 1000, max_rounds=30).collect()} == {k for k, _, _ in kept}


def test_shared_cells_without_a_row_per_cell(spark):
    rng = random.Random(6)
    blocks = [(k, x := rng.randrange(20), y := rng.randrange(20), x + rng.randrange(8), y + rng.randrange(8)) for k in range(40)]
    cells = {k: {(x, y) for x in range(a, c + 1) for y in range(b, d + 1)} for k, a, b, c, d in blocks}
    want = {(a, b): round(len(cells[a] & cells[b]) / min(len(cells[a]), len(cells[b])), 9) for a in cells for b in cells if a < b and cells[a] & cells[b]}
    df = spark.createDataFrame(blocks, "zone_id long, min_x long, min_y long, max_x long, max_y long")
    assert {(r.a, r.b): round(r.share, 9) for r in sp.shared_cells(df, 5).collect()} == want


def test_nearest_distance_widens_from_the_mean_density(spark):
    rng = random.Random(16)
    b = [(k, rng.random() * 50, rng.random() * 50) for k in range(300)] + [(300, 4000.0, 4000.0)]
    a = [(k, rng.random() * 60, rng.random() * 60) for k in range(80)] + [(80, 2000.0, 2000.0), (81, -900.0, 10.0)]
    radii, near = [], sp.within_distance
    sp.within_distance = lambda p, q, radius, *more: radii.append(radius) or near(p, q, radius, *more)
    try:
        rows = sp.nearest_distance(*(spark.createDataFrame(t, "id long, x double, y double") for t in (a, b)), 5000.0, -1.0).collect()
    finally:
        sp.within_distance = near
    want = {i: min(((x - p) ** 2 + (y - q) ** 2) ** 0.5 for _, p, q in b) for i, x, y in a}
    assert all(abs(r.dist - want[r.id]) < 1e-9 for r in rows) and len(rows) == len(a)
    assert radii[0] < 1500


def test_clusters_of_points_equal_brute_force(spark):
    from meridion.operators.spatial import clustered_cells

    rng = random.Random(5)
    heaps = [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(45)]
    points = [(x + rng.gauss(0, 0.8), y + rng.gauss(0, 0.8)) for x, y in heaps for _ in range(6)] + [(0.0, 200.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 1.0)]
    # the nearest points of two cells need not be outermost ones
    points += [(300 + x, y) for x, y in ((0.0, 0.0), (1.3, 0.7), (1.3, -0.7), (1.35, 0.0), (0.7, 1.3), (3.3, 0.0), (3.9, 1.3), (3.9, -1.3))]
    got = clustered_cells(spark.createDataFrame(points, "x double, y double"), 2.0).collect()
    cell = lambda p: (math.floor(p[0] / 1.4), math.floor(p[1] / 1.4))
    plain = [p for p in points if p[0] is not None and math.isfinite(p[0])]
    name = {p: p for p in plain}

    def top(p):
        while name[p] != p:
            p = name[p]
        return p

    for p in plain:
        for q in plain:
            if math.dist(p, q) <= 2.0:
                name[top(p)] = top(q)
    parts = {}
    for p in plain:
        parts.setdefault(top(p), set()).add(cell(p))
    found = {}
    for r in got:
        found.setdefault(r.cluster, set()).add((r.cell.x, r.cell.y))
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, parts.values())) and len(parts) > 3


def test_nearest_points_begin_with_a_few(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(1500)] + [(1500, 900.0, -400.0)]
    a = spark.createDataFrame(rows, "id long, x double, y double")
    radii, plain = [], sp.within_distance
    monkeypatch.setattr(sp, "within_distance", lambda p, q, radius, size=None: radii.append(radius) or plain(p, q, radius, size))
    got = {}
    for r in sp.knn_join(a, a.withColumnRenamed("id", "other"), 4, 400.0).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.other
    for k, x, y in rows[::50]:
        want = sorted((math.hypot(x - p, y - q), j) for j, p, q in rows if j != k)[:4]
        assert [got[k][i] for i in range(1, 5)] == [j for _, j in want]
    assert radii[0] < 100  # 400 m would meet the whole square


def test_runs_of_crossings_are_one_row_and_cut_as_all_do(spark):
    from meridion.operators.topology import crossing_points, split_at_points, straight_network

    rng = random.Random(9)
    rows = [(k, *(rng.random() * 20 for _ in range(4)), "arterial", []) for k in range(150)]
    nodes, e = straight_network(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, road_class string, flags array<string>"))
    every, few = crossing_points(e, 0.6).collect(), crossing_points(e, 0.6, gap=0.6).collect()
    want = []
    for k in range(150):
        at = sorted(r.along for r in every if r.id == k)
        starts = [a for i, a in enumerate(at) if i == 0 or a - at[i - 1] > 0.6]
        want += [(k, a, sum(1 for z in at if a <= z < b)) for a, b in zip(starts, [*starts[1:], math.inf])]
    got = {}
    for r in sorted(few, key=lambda r: (r.id, r.along)):  # tiles that an edge crosses have runs of their own
        last = got.setdefault(r.id, [])
        if last and r.along - last[-1][2] <= 0.6:
            last[-1] = (last[-1][0], last[-1][1] + r.n, max(last[-1][2], r.until))
        else:
            last.append((r.along, r.n, r.until))
    assert sorted((k, a, n) for k, v in got.items() for a, n, _ in v) == want and len(few) < len(every) / 3
    # a cut inside a run is no cut, though none of the run's rows is near it
    k, (start, _, until) = next((k, c) for k, v in got.items() for c in v if c[2] - c[0] > 2)
    edge, mid = rows[k], (start + until) / 2
    long = math.hypot(edge[3] - edge[1], edge[4] - edge[2])
    x, y = (edge[1 + i] + mid / long * (edge[3 + i] - edge[1 + i]) for i in (0, 1))
    schema = "id long, seg long, t double, x double, y double, along double, until double, n long"
    more = spark.createDataFrame([(k, 0, mid / long, x, y, mid, None, 1)], schema)
    pieces = lambda cuts: sorted((r.id, r.u, r.v) for r in split_at_points(nodes, e, cuts, 0.6)[1].where(F.col("parent") == k).collect())
    cuts = spark.createDataFrame([tuple(r) for r in few if r.id == k], schema)
    assert pieces(cuts.unionByName(more)) == pieces(cuts)


def test_crossings_are_those_of_all_pairs_and_no_pairs_are_joined(spark):
    rng = random.Random(12)
    rows = [(k, *(float(rng.randrange(60)) for _ in range(4))) for k in range(160)]
    rows += [(160, 0.0, 0.0, 59.0, 59.0), (161, 5.0, 5.0, 5.0, 5.0), (162, float("nan"), 0.0, 9.0, 9.0), (163, 0.0, 9.0, math.inf, 9.0), (164, None, 0.0, 9.0, 9.0), (None, 0.0, 50.0, 50.0, 0.0), (165, -4000.0, 30.5, 9000.0, 31.0)]

    def point(a, b):
        (_, ax, ay, bx, by), (_, cx, cy, dx, dy) = a, b
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if abs(den) <= 1e-6 or {(ax, ay), (bx, by)} & {(cx, cy), (dx, dy)}:
            return None
        t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
        return (round(ax + t * (bx - ax), 6), round(ay + t * (by - ay), 6)) if -1e-6 <= t <= 1 + 1e-6 and -1e-6 <= u <= 1 + 1e-6 else None

    plain = [r for r in rows if r[0] is not None and r[0] not in (162, 163, 164)]
    want = sorted((a[0], b[0], *p) for a in plain for b in plain if a[0] < b[0] and (p := point(a, b)))
    found = sp.crossing_join(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), 4.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.a, r.b, round(r.x, 6), round(r.y, 6)) for r in found.collect()) == want and len(want) > 2000
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
