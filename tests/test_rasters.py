"""Routes, contours, chains and zone widths against plain versions on small inputs."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from meridion.operators import raster as r
from meridion.operators import routes, walks


def dijkstra(cells, sources):
    cost, heap = {}, [(0.0, s) for s in sources if s in cells]
    heapq.heapify(heap)
    while heap:
        c, (x, y) = heapq.heappop(heap)
        if (x, y) in cost:
            continue
        cost[x, y] = c
        for dy, dx in r.NEIGHBOURS:
            n = (x + dx, y + dy)
            if n in cells and n not in cost:
                rate, toll = cells[n]
                heapq.heappush(heap, (c + ((2**0.5 if dx and dy else 1.0) * rate + toll), n))
    return cost


@pytest.mark.parametrize("size", [4, 7, 64])
def test_routes_are_those_of_dijkstra(spark, size):
    rng = random.Random(size)
    fields = {f: {(x, y): (1 + rng.random() * 9, rng.choice([0.0, 0.0, 50.0])) for x in range(-6, 17) for y in range(13) if rng.random() < 0.8} for f in ("a", "b")}
    sources = {"a": [(-6, 0), (0, 0), (500, 500)], "b": [(16, 12), (16, 11)]}
    for f in fields:
        for s in sources[f][:2]:
            fields[f][s] = (1.0, 0.0)
    cells = spark.createDataFrame([(f, *k, *w) for f, c in fields.items() for k, w in c.items()], "field string, ix long, iy long, rate double, toll double")
    starts = spark.createDataFrame([(f, *k) for f, s in sources.items() for k in s], "field string, ix long, iy long")
    want = {f: dijkstra(fields[f], sources[f]) for f in fields}
    got = {(x.field, x.ix, x.iy): x.cost for x in routes.route_costs(cells, starts, size).collect()}
    assert got == {(f, *k): c for f in fields for k, c in want[f].items()}
    goals = [(n, f, x, y) for n, (f, x, y) in enumerate([("a", 16, 12), ("a", 3, 5), ("b", -6, 0), ("a", -6, 0), ("b", 900, 900)])]
    paths = defaultdict(list)
    for p in routes.route_paths(cells, starts, spark.createDataFrame(goals, "path long, field string, ix long, iy long"), size).collect():
        paths[p.path].append((p.seq, (p.ix, p.iy), p.cost))
    for n, f, x, y in goals:
        steps = sorted(paths[n])
        assert bool(steps) == ((x, y) in want[f])
        if steps:
            assert [s for s, _, _ in steps] == list(range(len(steps)))
            assert steps[-1][1] == (x, y) and steps[0][1] in sources[f] and steps[-1][2] == want[f][x, y]
            for (_, a, before), (_, b, after) in zip(steps, steps[1:]):
                rate, toll = fields[f][b]
                assert max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1
                assert after == before + ((2**0.5 if a[0] != b[0] and a[1] != b[1] else 1.0) * rate + toll)


def test_walks_double_and_circles_are_refused(spark):
    line = spark.createDataFrame([(k, k + 1 if k < 20 else None) for k in range(21)], "k long, to long")
    starts = spark.createDataFrame([("a", 0), ("b", 13), ("c", 20), ("d", 99)], "walk string, k long")
    got = sorted(map(tuple, walks.follow(line, starts).select("walk", "pos", "k").collect()))
    assert got == [("a", k, k) for k in range(21)] + [("b", k, 13 + k) for k in range(8)] + [("c", 0, 20), ("d", 0, 99)]
    assert {(x.k, x.end, x.left) for x in walks.ends_of_chains(line).collect()} == {(k, 20, 20 - k) for k in range(21)}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "k long, to long")
    for f in (lambda: walks.follow(ring, starts), lambda: walks.ends_of_chains(ring)):
        with pytest.raises(RuntimeError):
            f()


def test_links_are_ordered_along_open_and_closed_chains(spark):
    links = [("p", 5, 3), ("q", 9, 3), ("r", 9, 1), ("s", 20, 22), ("t", 22, 21), ("u", 21, 20), ("v", 30, 31), ("w", 31, 30), ("x", 40, 41)]
    got = sorted((x.chain, x.seq, x.id, x["from"], x.to, x.closed) for x in walks.order_chains(spark.createDataFrame(links, "id string, u long, v long")).collect())
    assert got == [
        (1, 0, "r", 1, 9, False), (1, 1, "q", 9, 3, False), (1, 2, "p", 3, 5, False),
        (20, 0, "s", 20, 22, True), (20, 1, "t", 22, 21, True), (20, 2, "u", 21, 20, True),
        (30, 0, "v", 30, 31, True), (30, 1, "w", 31, 30, True), (40, 0, "x", 40, 41, False),
    ]
    with pytest.raises(ValueError):
        walks.order_chains(spark.createDataFrame([("a", 1, 2), ("b", 1, 3), ("c", 1, 4)], "id string, u long, v long"))


def test_contours_have_both_kinds_of_saddle_and_stay_inside(spark):
    square = lambda *h: spark.createDataFrame([(x, y, float(v)) for (x, y), v in zip([(0, 0), (1, 0), (1, 1), (0, 1)], h, strict=True)], "ix long, iy long, h double")
    ends = lambda df: sorted(tuple(sorted([(x.a.x, x.a.y), (x.b.x, x.b.y)])) for x in r.contour_segments(df, 1, 10.0).collect())
    assert ends(square(0, 2, 0, 2)) == [((0.0, 5.0), (5.0, 0.0)), ((5.0, 10.0), (10.0, 5.0))]
    assert ends(square(2, 0, 2, 0)) == [((0.0, 5.0), (5.0, 10.0)), ((5.0, 0.0), (10.0, 5.0))]
    assert ends(square(0, 0, 4, 4)) == [((0.0, 5.0), (10.0, 5.0))]
    assert ends(square(3, 3, 3, 3)) == []
    rng = random.Random(1)
    rough = spark.createDataFrame([(x, y, rng.random()) for x in range(9) for y in range(7)], "ix long, iy long, h double")
    segments = r.contour_segments(rough, 5, 10.0).collect()
    assert len(segments) > 60
    for s in segments:
        assert 0 < s.share < 1 and all(0 <= p.x <= 80 and 0 <= p.y <= 60 for p in (s.a, s.b))


def test_contour_lines_hold_every_segment_once(spark):
    rng = random.Random(4)
    rough = spark.createDataFrame([(x, y, rng.random()) for x in range(12) for y in range(9)], "ix long, iy long, h double")
    segments = r.contour_segments(rough, 3)
    near = lambda x, y: (round(x, 6), round(y, 6))
    want = sorted((s.level_no, *sorted([near(s.a.x, s.a.y), near(s.b.x, s.b.y)])) for s in segments.collect())
    lines = defaultdict(list)
    for p in r.contour_lines(segments).collect():
        lines[p.level_no, p.line].append((p.seq, near(p.x, p.y)))
    got = []
    for (level, _), points in lines.items():
        points.sort()
        assert [s for s, _ in points] == list(range(len(points)))
        got += [(level, *sorted([a, b])) for (_, a), (_, b) in zip(points, points[1:])]
    assert sorted(got) == want
    ends = [p[0][1] for p in lines.values() if p[0][1] != p[-1][1]] + [p[-1][1] for p in lines.values() if p[0][1] != p[-1][1]]
    assert all(x in (0, 11) or y in (0, 8) for x, y in ends)  # open lines end at the raster's rim


def test_depth_is_the_way_out_of_the_zone(spark):
    rng = random.Random(2)
    cells = {(x, y): rng.choice("ab") if rng.random() < 0.25 else "a" for x in range(14) for y in range(11) if rng.random() < 0.93}
    df = spark.createDataFrame([(*k, z) for k, z in cells.items()], "ix long, iy long, zone string")
    around = [(x, y) for x in range(-1, 15) for y in range(-1, 12)]
    want = {(x, y): min(abs(x - u) + abs(y - w) for u, w in around if cells.get((u, w)) != z) for (x, y), z in cells.items()}
    assert {(c.ix, c.iy): c.depth for c in r.zone_widths(df).collect()} == want


def test_zones_are_kept_by_area_width_and_border(spark):
    shapes = {1: [(x, y) for x in range(5, 8) for y in range(5, 9)], 2: [(x, 12) for x in range(2, 14)], 3: [(0, y) for y in range(4)], 4: [(20, 20)], 5: [(x, y) for x in range(10, 13) for y in range(3, 8)]}
    df = spark.createDataFrame([(x, y, z) for z, c in shapes.items() for x, y in c] + [(30, 30, 6), (-1, -1, 7)], "ix long, iy long, zone long")
    got = {z.zone: (z.width, z.span, z.split) for z in r.filter_zones(df, 10.0, 300.0, 20.0, 45.0, 8.0, 5000.0).collect()}
    assert got == {1: (30.0, 40.0, False), 5: (30.0, 50.0, True)}
    assert r.filter_zones(df, 10.0, 300.0, 10.0, 1e9, 8.0, 5000.0).where("split").first().zone == 2


def test_rivers_are_smoothed_and_short_ones_go(spark):
    cells = [(x, 0, x + 1 if x < 6 else x, 0, x + 1.0) for x in range(7)] + [(6, 3, 6, 3, 9.0)]
    df = spark.createDataFrame(cells, "ix long, iy long, to_x long, to_y long, acc double")
    got = sorted((p.seq, p.x, p.y, p.flow, p.length) for p in r.river_lines(df, 10.0, 20.0).collect())
    assert [p[1] for p in got] == [5.0, 10.0, 20.0, 30.0, 40.0, 50.0, 55.0]
    assert {p[3:] for p in got} == {(1.0, 50.0)}
    assert r.river_lines(df, 10.0, 60.0).count() == 0


def test_a_route_within_one_tile_takes_two_rounds(spark, monkeypatch):
    """A corridor of 200 cells crosses no tile of the default size: its tile and what its rim adds are all that is run."""
    written = []
    monkeypatch.setattr(routes, "materialize", lambda df, plain=routes.materialize: written.append(1) or plain(df))
    cells = spark.range(200).selectExpr("0L AS field", "id AS ix", "0L AS iy", "1.0D AS rate", "0.0D AS toll")
    got = routes.route_costs(cells, cells.where("ix = 0").select("field", "ix", "iy"))
    assert {(r.ix, r.cost) for r in got.collect()} == {(k, float(k)) for k in range(200)}
    assert len(written) <= 2 + 2 * 3


def test_zones_over_tiles_equal_brute_force(spark):
    rng = random.Random(11)
    cells = {(x, y) for x in range(-140, 140) for y in range(120, 136) if rng.random() < 0.62} | {(x, -500) for x in range(-300, 300)}
    name, seen = {}, {}
    for start in sorted(cells, key=lambda c: c[1] * 1_000_000_007 + c[0]):
        todo = [start] if start not in name else []
        while todo:
            c = todo.pop()
            if c in cells and c not in name:
                name[c] = start[1] * 1_000_000_007 + start[0]
                todo += [(c[0] + 1, c[1]), (c[0] - 1, c[1]), (c[0], c[1] + 1), (c[0], c[1] - 1)]
    rows = [*cells, *list(cells)[:20], (None, 3)]
    got = r.label_zones(spark.createDataFrame(rows, "ix long, iy long"))
    # the rounds see parts of tiles that meet, not cells
    for p in got.collect():
        assert p.zone == name.get((p.ix, p.iy))
        seen[p.ix, p.iy] = seen.get((p.ix, p.iy), 0) + 1
    assert set(seen) == cells | {(None, 3)} and sum(seen.values()) == len(rows) and len(set(name.values())) > 20


def test_zones_are_joined_by_tiles_and_not_by_cells(spark, monkeypatch):
    met = []
    whole = r.connected_components
    monkeypatch.setattr(r, "connected_components", lambda e, *a: (met.append(e.count()), whole(e, *a))[1])
    mask = spark.range(256 * 256).selectExpr("id % 256 as ix", "id div 256 as iy")
    assert r.label_zones(mask).select("zone").distinct().count() == 1 and met[0] <= 4


def test_a_tile_is_settled_along_its_way_and_not_as_a_whole_each_step():
    import time

    import pandas as pd
    from meridion.operators.routes import _settle

    way = []  # there and back on every other line
    for y in range(0, 256, 2):
        line = range(256) if y % 4 == 0 else range(255, -1, -1)
        way += [(x, y) for x in line] + ([(255 if y % 4 == 0 else 0, y + 1)] if y < 254 else [])
    t = pd.DataFrame(way, columns=["ix", "iy"]).assign(cost=math.inf, rate=1.0, toll=0.5, known=False)
    t.loc[0, "cost"] = 0.0
    began = time.time()
    got = _settle(256)((0, 0, 0), t)
    assert time.time() - began < 25  # 32,000 steps; looking at all 65,536 cells in each took minutes
    cost = {(r.ix, r.iy): r.cost for r in got.itertuples()}
    assert len(cost) == len(way)
    # each of the 127 turns is two diagonal steps
    assert abs(cost[way[-1]] - (1.5 * (2 * 254 + 126 * 253) + 254 * (2**0.5 + 0.5))) < 1e-6
    assert all(cost[a] < cost[b] for a, b in zip(way[:255], way[1:255]))
