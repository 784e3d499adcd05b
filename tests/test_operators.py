"""Small literal inputs of the operators."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations
from types import SimpleNamespace

import pytest
from meridion.functions import geometry as g
from meridion.functions import text as s
from meridion.operators import events, graph, polyline, raster, spatial, stats
from meridion.operators.components import connected_components
from meridion.session import shared_folder
from meridion.sources import documents as docs
from meridion.streaming import feeds
from pyspark.sql import functions as F


def seg(spark, rows):
    return spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double, dx double, dy double")


@pytest.mark.parametrize(
    "row,kind,at",
    [((0, 0, 10, 0, 5, -5, 5, 0), "point", (5, 0)), ((0, 0, 10, 0, 0, 1, 10, 1), "none", None), ((0, 0, 10, 0, 4, 0, 12, 0), "overlap", (10, 0))],
)
def test_meeting_segments(spark, row, kind, at):
    k, x, y = g.meeting(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"))
    r = seg(spark, [tuple(map(float, row))]).select(k.alias("k"), x.alias("x"), y.alias("y")).head()
    assert r.k == kind and (at is None or (r.x, r.y) == at)


def test_point_to_segment(spark):
    r = spark.range(1).select(g.segment_distance(12.0, 3.0, 0.0, 0.0, 10.0, 0.0).alias("d")).head()
    assert math.isclose(r.d, math.sqrt(13))


def test_flow_on_small_rasters(spark):
    h = [[5, 4, 3], [6, 5, 4], [7, 6, 5]]
    t = spark.createDataFrame([(x, y, float(h[y][x])) for y in range(3) for x in range(3)], "ix long, iy long, h double")
    f = {(r.ix, r.iy): (r.to_x, r.to_y) for r in raster.flow_direction(t).collect()}
    x, y = f[1, 1]
    assert h[y][x] < h[1][1] and f[2, 0] == (2, 0)
    acc = {(r.ix, r.iy): r.acc for r in raster.flow_accumulation(raster.flow_direction(t)).collect()}

    def drains(c):
        return 1 + sum(drains(k) for k, to in f.items() if to == c and k != c)

    assert acc == {c: drains(c) for c in f}


def test_components_of_a_path_and_loops(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (200, 200)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200}
    assert connected_components(e.limit(0)).count() == 0


def test_tree_weight_equals_kruskal(spark):
    rows = [(u * 10 + v, u, v, float((u * 7 + v * 13) % 17 + 1)) for u in range(9) for v in range(u + 1, 9) if (u + v) % 3]
    tree = graph.minimum_spanning_tree(spark.createDataFrame(rows, "id long, u long, v long, weight double")).collect()
    root = list(range(9))

    def find(x):
        return x if root[x] == x else find(root[x])

    total = 0.0
    for w, u, v in sorted((w, u, v) for _, u, v, w in rows):
        if find(u) != find(v):
            root[find(u)] = find(v)
            total += w
    assert len(tree) == 8 and sum(r.weight for r in tree) == total


def test_simplify_equals_recursion(spark):
    pts = [(float(i), 40 * math.sin(i / 3) + (i * 37 % 11)) for i in range(40)]

    def keep(lo, hi):
        (x0, y0), (x1, y1) = pts[lo], pts[hi]
        n = math.hypot(x1 - x0, y1 - y0)
        far = max(((abs((x1 - x0) * (pts[i][1] - y0) - (y1 - y0) * (pts[i][0] - x0)) / n, -i) for i in range(lo + 1, hi)), default=(0, 0))
        if far[0] <= 6:
            return set()
        return {-far[1]} | keep(lo, -far[1]) | keep(-far[1], hi)

    df = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(pts)], "line_id long, seq long, x double, y double")
    assert {r.seq for r in polyline.simplify(df, 6.0).collect()} == {0, 39} | keep(0, 39)


def test_spacing_holds_and_equals_greedy(spark):
    pts = [(i, float(i * 37 % 101), float(i * 53 % 103), float(i * 29 % 97)) for i in range(60)]
    got = [r.id for r in spatial.spaced_top_k(spark.createDataFrame(pts, "id long, x double, y double, score double"), 25.0, 100).collect()]
    kept = []
    for i, x, y, v in sorted(pts, key=lambda p: (-p[3], p[0])):
        if v > 0 and all(math.hypot(x - a, y - b) >= 25 for _, a, b, _ in kept):
            kept.append((i, x, y, v))
    assert sorted(got) == sorted(k[0] for k in kept)


def test_dangles_keep_culdesacs(spark):
    e = spark.createDataFrame([(1, 1, 2, "minor_local", 2.0, ["culdesac"]), (2, 2, 3, "arterial", 50.0, []), (3, 3, 1, "arterial", 50.0, []), (4, 3, 4, "major_local", 2.0, [])], "id long, u long, v long, road_class string, length_m double, flags array<string>")
    assert {r.id for r in graph.prune_dangles(e, 10.0).collect()} == {1, 2, 3}


def test_lineage_orders_are_contiguous(spark):
    e = spark.createDataFrame([(5, 1, 2, "a"), (3, 2, 3, "a"), (9, 3, 4, "a"), (4, 8, 9, "b")], "id long, u long, v long, continuity_id string")
    got = {(r.continuity_id, r.id): r.segment_order for r in graph.segment_order(e).collect()}
    assert got == {("a", 5): 0, ("a", 3): 1, ("a", 9): 2, ("b", 4): 0}


def test_hull_of_a_square(spark):
    pts = [("g", float(x), float(y)) for x in range(5) for y in range(5)]
    r = stats.convex_hulls(spark.createDataFrame(pts, "g string, x double, y double"), "g").head()
    assert r.area == 16.0 and {(p.x, p.y) for p in r.ring} == {(0, 0), (4, 0), (4, 4), (0, 4)}


def test_ring_buffer_and_poll(spark):
    log = spark.createDataFrame([(1, k, k, "INFO", "progress") for k in range(1, 5)], "run_id long, seq long, ts long, level string, kind string")
    tail = events.ring_tail(log, 3).collect()
    assert sorted(r.seq for r in tail) == [2, 3, 4] and {r.dropped for r in tail} == {1}
    assert [r.seq for r in events.poll(log, 1, 2).collect()] == [3, 4]


def test_truncation_and_levels(spark):
    r = spark.createDataFrame([("x" * 800, " warning ", "")], "t string, l string, b string").select(s.truncate(F.col("t"), 512).alias("t"), s.normal_level(F.col("l")).alias("l"), s.normal_level(F.col("b")).alias("b")).head()
    assert r.t == "x" * 512 + "...(truncated:800)" and r.l == "WARN" and r.b is None


def test_event_stream_frames(spark):
    body = ": hi\r\n\r\nevent: heartbeat\ndata: {}\n\nevent: complete\ndata: a\ndata: b\n\n"
    got = [(r.event, r.data) for r in docs.parse_event_stream(spark.createDataFrame([(1, body)], "id int, body string"), "body").orderBy("frame").collect()]
    assert got == [("heartbeat", "{}"), ("complete", "a\nb")]


def test_layers_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "good.json").write_text('{"id": 1,\n "names": ["a"]}')
    (tmp_path / "bad.json").write_text('{"id": oops')
    schema = T.StructType().add("id", "long").add("names", T.ArrayType(T.StringType()))
    good, bad = docs.read_layers(spark, str(tmp_path), schema)
    assert [tuple(r) for r in good.collect()] == [(1, ["a"])] and bad.count() == 1


def test_stroke_and_widths(spark):
    n = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 0.0), (2, 20.0, 1.0), (3, 10.0, 10.0)], "id long, x double, y double")
    e = spark.createDataFrame([(1, 0, 1, "arterial"), (2, 1, 2, "arterial"), (3, 1, 3, "arterial")], "id long, u long, v long, road_class string")
    assert {r.id: r.stroke for r in graph.strokes(e, n).collect()} == {1: 1, 2: 1, 3: 3}


def test_progress_is_told_and_its_errors_are_not_passed_on(spark):
    from meridion.streaming.progress import ProgressListener, counted

    df, seen = counted(spark.range(7), "load")
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 7
    told = []
    ProgressListener(lambda *x: told.append(x))._tell("a", 0.5, "b")
    ProgressListener(lambda *x: 1 / 0)._tell("a", 0.5, "b")
    assert told == [("a", 0.5, "b")]


def test_names_from_a_pandas_provider(spark):
    from meridion.functions import providers

    providers.register("loud", providers.from_pandas(lambda hub: "H" + hub.astype(str)))
    assert [r.n for r in spark.range(2).select(providers.names_by("loud", "id").alias("n")).collect()] == ["H0", "H1"]
    with pytest.raises(KeyError):
        providers.names_by("none", "id")


def _brute_cleanup(edges, snap, reach, tolerance, shortest):
    """The same steps over plain lists: edges as {id: [x0, y0, x1, y1]} with class and flags by id."""
    from math import dist

    main = {(e[k], e[k + 1]) for i, e in edges.items() for k in (0, 2) if i % 3 == 0}
    rank = {}
    for i, e in edges.items():
        for k in (0, 2):
            rank[e[k], e[k + 1]] = min(i % 3, rank.get((e[k], e[k + 1]), 3))
    name = lambda n: f"{round(n[0] * 1000)}:{round(n[1] * 1000)}"
    to, left = {n: n for n in main}, set(rank) - main
    while left:
        cluster, new = set(), {left.pop()}
        while new:
            cluster |= new
            new = {m for m in left if any(dist(m, n) <= snap for n in new)}
            left -= new
        near = [(dist(n, m), rank[m], name(m), m) for n in cluster for m in main if dist(n, m) <= snap]
        best = min(near)[3] if near else min(cluster, key=lambda n: (rank[n], name(n)))
        to |= {n: best for n in cluster}
    moves = sum(m != n for n, m in to.items())
    snapped = {i: (*to[a, b], *to[c, d]) for i, (a, b, c, d) in edges.items() if to[a, b] != to[c, d]}
    collapsed = len(edges) - len(snapped)
    key = lambda x, y: f"{round(x * 1000)}:{round(y * 1000)}"
    degree = Counter(key(*e[k : k + 2]) for e in snapped.values() for k in (0, 2))

    def foot(p, e):
        (x0, y0, x1, y1), (x, y) = e, p
        t = min(1, max(0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
        return x0 + t * (x1 - x0), y0 + t * (y1 - y0)

    clear = lambda p, e: min(dist(p, e[:2]), dist(p, e[2:])) > max(2 * tolerance, 1.5)
    joined, cuts, junctions = {i: list(e) for i, e in snapped.items()}, defaultdict(list), 0
    for i, e in snapped.items():
        for k in (0, 2):
            p = e[k : k + 2]
            found = [(dist(p, f), j, f) for j, o in snapped.items() if j != i and dist(p, f := foot(p, o)) <= reach and clear(f, o)]
            if degree[key(*p)] == 1 and i % 3 and found:
                _, j, f = min(found)
                joined[i][k : k + 2] = f
                cuts[j].append(f)
                junctions += 1
    crossings = 0
    for i, j in combinations(sorted(joined), 2):
        (ax, ay, bx, by), (cx, cy, dx, dy) = joined[i], joined[j]
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        if {(ax, ay), (bx, by)} & {(cx, cy), (dx, dy)} or abs(den) <= 1e-6:
            continue
        t, u = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den, ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
        p = (ax + t * (bx - ax), ay + t * (by - ay))
        if -1e-6 <= t <= 1 + 1e-6 and -1e-6 <= u <= 1 + 1e-6 and clear(p, joined[i]) and clear(p, joined[j]):
            crossings += 1
            cuts[i].append(p)
            cuts[j].append(p)
    pieces = {}
    for i, e in joined.items():
        at = sorted((dist(p, e[:2]), p) for p in cuts[i] if min(dist(p, e[:2]), dist(p, e[2:])) > max(tolerance, 1))
        at = [p for k, (a, p) in enumerate(at) if k == 0 or a - at[k - 1][0] > max(tolerance, 0.5)]
        ends = [tuple(e[:2]), *at, tuple(e[2:])]
        for k, (p, q) in enumerate(zip(ends, ends[1:], strict=False)):
            pieces[str(i) if len(ends) == 2 else f"{i}{'-cul' if i % 4 == 0 else ''}-s{k}"] = (i, key(*p), key(*q), dist(p, q))
    degree = Counter(n for _, u, v, _ in pieces.values() for n in (u, v))
    gone = {k for k, (i, u, v, n) in pieces.items() if 1 in (degree[u], degree[v]) and i % 3 and i % 4 and n < shortest and not (i % 3 == 2 and n >= 25)}
    counts = {"snapped": moves, "collapsed": collapsed, "t_junctions": junctions, "crossings": crossings, "pieces": len(pieces), "pruned": len(gone)}
    return {k: (i, u, v, round(n, 3)) for k, (i, u, v, n) in pieces.items() if k not in gone}, counts


def test_topology_cleanup_equals_brute_force(spark):
    from meridion.operators.topology import straight_network, topology_cleanup

    rng = random.Random(4)
    at = lambda: float(rng.randrange(600))
    edges = {i: [at(), at(), 0.0, 0.0] for i in range(1, 130)}
    for e in edges.values():
        e[2:] = [e[0] + rng.randrange(-110, 111), e[1] + rng.randrange(10, 111)]
    edges[130], edges[131] = [10.0, 10.0, 90.0, 10.0], [50.0, 40.0, 50.0, 13.0]  # an end three metres from a street
    edges[133] = [300.0, 900.0, 303.0, 900.0]  # shorter than the radius
    kinds = {0: "arterial", 1: "major_local", 2: "minor_local"}
    df = spark.createDataFrame([(i, *e, kinds[i % 3], ["culdesac"] if i % 4 == 0 else []) for i, e in edges.items()], "id long, x0 double, y0 double, x1 double, y1 double, road_class string, flags array<string>")
    nodes, kept, counts = topology_cleanup(*straight_network(df), 6.0, 9.0, 0.6, 60.0)
    want, steps = _brute_cleanup(edges, 6.0, 9.0, 0.6, 60.0)
    assert {r.step: r.n for r in counts.collect()} == steps and all(steps.values())
    place = {n.id: f"{round(n.x * 1000)}:{round(n.y * 1000)}" for n in nodes.collect()}
    assert {r.id: (r.parent, place[r.u], place[r.v], round(r.length_m, 3)) for r in kept.collect()} == want
    none = topology_cleanup(*straight_network(df.limit(0)), 6.0, 9.0, 0.6, 60.0)
    assert none[1].count() == 0 and {r.n for r in none[2].collect()} == {0}


def test_snapping_joins_clusters_once_and_tears_nothing_off(spark):
    from meridion.operators.topology import snap_nodes

    def snapped(xs, edges, radius, kinds=None):
        nodes = spark.createDataFrame([(k, float(x), 0.0) for k, x in enumerate(xs)], "id long, x double, y double")
        path = lambda u, v: [(float(xs[u]), 0.0), (float(xs[u] + xs[v]) / 2, 50.0), (float(xs[v]), 0.0)] if abs(xs[u] - xs[v]) > radius else [(float(xs[u]), 0.0), (float(xs[v]), 0.0)]
        rows = [(f"e{k}", u, v, path(u, v), (kinds or {}).get(k, "minor_local"), []) for k, (u, v) in enumerate(edges)]
        e = spark.createDataFrame(rows, "id string, u long, v long, path array<struct<x: double, y: double>>, road_class string, flags array<string>")
        first = snap_nodes(nodes, e, radius)
        assert snap_nodes(first[0], first[1], radius)[2].isEmpty()
        return {n.id: n.x for n in first[0].collect()}, {x.id: (x.u, x.v, x.path[0].x, x.path[-1].x) for x in first[1].collect()}, first[3].count()

    # steps of three metres are one cluster: all of it meets at one node
    assert snapped([0, 3, 6, 9, 100], [(0, 4), (1, 4), (2, 4), (3, 4)], 4.0) == ({0: 0.0, 4: 100.0}, {f"e{k}": (0, 4, 0.0, 100.0) for k in range(4)}, 0)
    # an edge within the cluster collapses, and its neighbours still meet
    assert snapped([0, 3, 3.5, 200], [(0, 3), (1, 2), (2, 3)], 4.0) == ({0: 0.0, 3: 200.0}, {"e0": (0, 3, 0.0, 200.0), "e2": (0, 3, 0.0, 200.0)}, 1)
    # arterials stay where they are, and draw others to the nearest of them
    found = snapped([0, 3, 5, 500, 600], [(0, 3), (1, 4), (2, 3)], 4.0, {0: "arterial", 2: "arterial"})
    assert found == ({0: 0.0, 2: 5.0, 3: 500.0, 4: 600.0}, {"e0": (0, 3, 0.0, 500.0), "e1": (2, 4, 5.0, 600.0), "e2": (2, 3, 5.0, 500.0)}, 0)


def test_pieces_of_polylines_keep_their_points(spark):
    from meridion.operators.topology import crossing_points, path_length, split_at_points

    lines = {"a": [(0, 0), (40, 10), (80, 0), (120, 10)], "b": [(20, -30), (20, 40)], "c": [(40, -30), (40, 10), (40, 60)], "d": [(80, 40), (100, -20), (110, 40)], "e": [(300, 0), (400, 0)]}
    nodes = spark.createDataFrame([(f"{k}{n}", float(p[i][0]), float(p[i][1])) for k, p in lines.items() for n, i in ((0, 0), (1, -1))], "id string, x double, y double")
    rows = [(k, f"{k}0", f"{k}1", [(float(x), float(y)) for x, y in p], ["culdesac"] if k == "b" else [], k.upper()) for k, p in lines.items()]
    e = spark.createDataFrame(rows, "id string, u string, v string, path array<struct<x: double, y: double>>, flags array<string>, label string")
    new, pieces = split_at_points(nodes, e, crossing_points(e, 0.6), 0.6)
    got = {p.id: p for p in pieces.withColumn("measured", path_length(F.col("path"))).collect()}
    assert set(got) == {"a-s0", "a-s1", "a-s2", "a-s3", "a-s4", "b-cul-s0", "b-cul-s1", "c-s0", "c-s1", "d-s0", "d-s1", "d-s2", "e"}
    assert all(abs(p.length_m - p.measured) < 1e-9 and p.label == p.parent.upper() for p in got.values())
    for k, p in lines.items():
        mine = sorted((x for x in got.values() if x.parent == k), key=lambda x: x.piece)
        total = sum(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in zip(p, p[1:]))
        assert abs(sum(x.length_m for x in mine) - total) < 1e-9
        assert (mine[0].u, mine[-1].v) == (f"{k}0", f"{k}1") and all(x.v == y.u for x, y in zip(mine, mine[1:]))
        assert set(p) <= {(q.x, q.y) for x in mine for q in x.path}
    assert got["a-s1"].v == got["c-s0"].v and got["a-s0"].v == got["b-cul-s0"].v  # crossings are shared nodes
    place = {n.id: (n.x, n.y) for n in new.collect()}
    assert all(place[x.u] == tuple(x.path[0]) and place[x.v] == tuple(x.path[-1]) for x in got.values())


def test_parallel_segments_do_not_cross(spark):
    rows = [(1, 0.0, 0.0, 10.0, 0.0), (2, 0.0, 1.0, 10.0, 1.0), (3, 2.0, 0.0, 8.0, 0.0), (4, 5.0, -5.0, 5.0, 5.0), (5, 3.0, 3.0, 3.0, 3.0)]
    found = spatial.crossing_join(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double"), 4.0).collect()
    assert sorted((r.a, r.b, r.x, r.y) for r in found) == [(1, 4, 5.0, 0.0), (2, 4, 5.0, 1.0), (3, 4, 5.0, 0.0)]


def test_numbering_equals_sorting(spark):
    rows = [(i, (i * 37) % 11) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, size long").repartition(7)
    got = {r.id: r.place for r in stats.numbered(df, [F.desc("size"), F.asc("id")], "place").collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])))}
    assert stats.numbered(df.limit(0), [F.asc("id")], "place").count() == 0


def test_betweenness_in_blocks_equals_all_paths(spark):
    """Against a listing of all shortest paths, with ties, two components and sources in several blocks."""
    rows = [(1, 2, 1.0), (2, 3, 1.0), (1, 4, 1.0), (4, 3, 1.0), (3, 5, 2.0), (1, 5, 4.0), (5, 6, 1.0), (10, 11, 3.0)]
    near = {}
    for u, v, w in rows:
        near.setdefault(u, {})[v] = w
        near.setdefault(v, {})[u] = w
    found = {}

    def walk(path, cost):
        found.setdefault((path[0], path[-1]), []).append((cost, path))
        for y, w in near[path[-1]].items():
            if y not in path:
                walk([*path, y], cost + w)

    for x in near:
        walk([x], 0.0)
    want = {(u, v): 0.0 for u, v, _ in ((min(u, v), max(u, v), w) for u, v, w in rows)}
    for (a, b), paths in found.items():
        best = min(c for c, _ in paths)
        short = [p for c, p in paths if c == best]
        for p in short if a < b else []:
            for x, y in zip(p, p[1:]):
                want[min(x, y), max(x, y)] += 1 / len(short)
    e = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "id long, u long, v long, weight double")
    for block_rows in (10**6, 30):
        got = {(r.u, r.v): r.score for r in graph.edge_betweenness(e, block_rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_streams_keep_rows_in_files(spark, tmp_path, monkeypatch):
    """Several micro-batches: appended rows of all batches, the last state of a complete stream; an empty feed."""
    path = str(tmp_path / "feed")
    spark.range(30).selectExpr("id % 3 AS run_id", "id AS seq", "timestamp_seconds(id) AS ts", "'k' AS kind").repartition(4).write.parquet(path)
    monkeypatch.setattr(feeds, "read_feed", lambda s, p, schema: s.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p))
    assert feeds.run_once(spark, path, lambda s: (s, "append")).count() == 30
    assert sorted((r.run_id, r.n) for r in feeds.run_once(spark, path, lambda s: (feeds.status(s), "complete")).collect()) == [(0, 10), (1, 10), (2, 10)]
    empty = str(tmp_path / "empty")
    spark.read.parquet(path).limit(0).write.parquet(empty)
    assert feeds.run_once(spark, empty, lambda s: (s, "append")).count() == 0


def test_no_folder_of_one_machine_on_a_cluster():
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))


def test_dense_crossings_that_cannot_cut_are_left_out_and_counted(spark):
    from meridion.operators.topology import crossing_points, split_at_points, straight_network

    rng = random.Random(15)
    rows = [(k, *(rng.random() * 12 for _ in range(4)), "arterial", []) for k in range(90)]
    nodes, e = straight_network(spark.createDataFrame(rows, "id long, x0 double, y0 double, x1 double, y1 double, road_class string, flags array<string>"))
    every, few = crossing_points(e, 0.6), crossing_points(e, 0.6, gap=0.6)
    n = every.count()
    assert few.count() < n == few.agg(F.sum("n")).head()[0]
    pieces = lambda cuts: sorted((r.id, r.u, r.v, round(r.length_m, 9)) for r in split_at_points(nodes, e, cuts, 0.6)[1].collect())
    assert pieces(few) == pieces(every) == pieces(every.drop("along"))


def test_simplify_deals_lines_once_and_ends_at_any_depth(spark, monkeypatch):
    # every split takes one vertex off, which 64 rounds did not reach
    rows = [(1, k, float(k), 0.0 if k == 0 else 10.0 * 1.3 ** (150 - k)) for k in range(150)]
    rows += [(2, k, float(k), float("nan") if k == 3 else 0.0) for k in range(7)] + [(3, 0, 5.0, 5.0), (4, 0, 0.0, 0.0), (4, 1, 4.0, None), (4, 2, 9.0, 0.0), (None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "line_id long, seq long, x double, y double")

    def keep(a, b):
        (_, _, x0, y0), (_, _, x1, y1) = rows[a], rows[b]
        n = math.hypot(x1 - x0, y1 - y0)
        off = [(-abs((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)) / n, k) for _, k, x, y in rows[a + 1 : b]]
        return keep(a, min(off)[1]) | {min(off)[1]} | keep(min(off)[1], b) if off and -min(off)[0] > 0.01 else set()

    got = polyline.simplify(df, 0.01)
    found = {}
    for r in got.collect():
        found.setdefault(r.line_id, set()).add(r.seq)
    assert found[1] == keep(0, 149) | {0, 149} and len(found[1]) > 100
    assert found[2] == {0, 1, 2, 3, 4, 6} and found[3] == {0} and found[4] == {0, 2} and len(found) == 4
    assert str(polyline.simplify(df, 0.01)._jdf.queryExecution().executedPlan().toString()).count("Exchange hashpartitioning") == 1


def test_rounds_of_paths_neither_shuffle_nor_sort_the_network(spark):
    rng = random.Random(3)
    rows = sorted({(min(a, b), max(a, b)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a != b})
    e = spark.createDataFrame([(i, u, v, float(1 + (u * 7 + v) % 5)) for i, (u, v) in enumerate(rows)], "id long, u long, v long, weight double")
    adj = graph._dealt(graph.adjacency(e).select("node", "other", "weight"))
    plan = spark.range(3).withColumnRenamed("id", "node").join(adj.hint("merge"), "node")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1  # both for the other side
    far = {(s, n): 0.0 if s == n else math.inf for s in (0, 5) for n in range(40)}
    for _ in range(40):
        for u, v in rows:
            for a, b in ((u, v), (v, u)):
                for s in (0, 5):
                    far[s, b] = min(far[s, b], far[s, a] + 1 + (u * 7 + v) % 5)
    got = graph.shortest_paths(e, spark.createDataFrame([(0,), (5,)], "node long")).collect()
    assert {(r.src, r.node): r.dist for r in got} == {k: d for k, d in far.items() if d < math.inf}
