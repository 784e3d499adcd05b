"""Strokes: scores by angle, class, width and spine, and what is told of each run."""

import math
import random

from meridion.operators import graph

SCHEMA = "id long, u long, v long, road_class string, width_m double, flags array<string>, length_m double, path array<struct<x: double, y: double>>"


def _edge(i, u, v, path, kind="minor_local", width=8.0, flags=()):
    return (i, u, v, kind, width, list(flags), sum(math.dist(a, b) for a, b in zip(path, path[1:])), path)


def test_scores_by_width_and_spine(spark):
    west, east = [(-10.0, 0.0), (0.0, 0.0)], [(0.0, 0.0), (10.0, 0.0)]
    score = lambda *rows: {(r.a, r.b): r.score for r in graph.continuation_scores(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert score(_edge(1, 0, 1, west), _edge(2, 1, 2, east)) == {(1, 2): 1.0, (2, 1): 1.0}
    assert score(_edge(1, 0, 1, west), _edge(2, 1, 2, east, "arterial"))[1, 2] == 0.3
    assert score(_edge(1, 0, 1, west), _edge(2, 1, 2, east, width=10.0))[1, 2] == round(1 - 0.2 / 0.35, 6)
    assert score(_edge(1, 0, 1, west), _edge(2, 1, 2, east, width=16.0)) == {}  # too different in width
    assert score(_edge(1, 0, 1, west, flags=["local_spine"]), _edge(2, 1, 2, east, flags=["local_spine"]))[1, 2] == 1.5
    bent = [(0.0, 0.0), (10.0, 10 * math.tan(math.radians(15)))]
    assert (1, 2) in score(_edge(1, 0, 1, west), _edge(2, 1, 2, bent))
    assert score(_edge(1, 0, 1, west, flags=["local_spine"]), _edge(2, 1, 2, bent)) == {}  # spines bend 12 degrees at most
    assert score() == {}


def test_paths_decide_where_an_edge_goes_on(spark):
    """The straight lines would turn, the parts at the shared node do not."""
    a = _edge(1, 0, 1, [(-50.0, 80.0), (-10.0, 0.0), (0.0, 0.0)])
    b = _edge(2, 1, 2, [(0.0, 0.0), (10.0, 0.0), (50.0, 80.0)])
    rows = graph.stroke_summary(spark.createDataFrame([a, b], SCHEMA)).collect()
    assert [(r.stroke, r.n_edges, r.deflection) for r in rows] == [(1, 2, 0.0)]


def test_summary_and_metrics(spark):
    rows = [
        _edge(1, 0, 1, [(0.0, 0.0), (400.0, 0.0)], flags=["b"]),
        _edge(2, 1, 2, [(400.0, 0.0), (800.0, 40.0)], flags=["a", "b"]),
        _edge(3, 5, 6, [(0.0, 900.0), (0.0, 990.0)], "arterial", flags=["local_spine"]),
        _edge(4, 8, 9, [(5000.0, 0.0), (5000.0, -80.0)], "arterial"),
    ]
    s = graph.stroke_summary(spark.createDataFrame(rows, SCHEMA))
    got = {r.stroke: r for r in s.collect()}
    bend = math.degrees(math.atan2(40, 400))
    assert sorted(got) == [1, 3, 4]
    assert got[1].n_edges == 2 and got[1].spine and got[1].flags == ["a", "b", "local_spine_run"]
    assert math.isclose(got[1].deflection, bend, abs_tol=1e-6) and math.isclose(got[1].bearing, bend / 2, abs_tol=1e-6)
    assert got[3].spine and got[3].flags == ["local_spine"] and got[3].road_class == "arterial"
    assert not got[4].spine and got[4].flags == [] and math.isclose(got[4].bearing, 270.0)
    m = {r.scope: r for r in graph.stroke_metrics(s, 700.0, 900.0).collect()}
    assert {k: r.n for k, r in m.items()} == {"all": 3, "spine": 2, "arterial": 2, "minor_local": 1}
    assert m["arterial"].p50 == 85.0 and m["spine"].in_band == 0.5


def test_best_continuations_are_those_of_all_pairs(spark):
    """Many edges that leave a node alike, a few loops; kinds of ends are compared, not edges."""
    rng, rows = random.Random(9), []
    at = {n: (100.0 * n, 0.0) for n in range(4)}
    for k in range(240):
        u, v = rng.randrange(4), rng.randrange(4)
        (x, y), (p, q) = at[u], at[v]
        path = [(x, y), (x + rng.choice([-10, 10]), y + rng.choice([-3, 0, 3])), (p + rng.choice([-10, 10]), q + rng.choice([-3, 0, 3])), (p, q)]
        rows.append(_edge(k, u, v, path, rng.choice(["arterial", "minor_local"]), rng.choice([8.0, 9.0]), rng.choice([[], ["local_spine"]])))
    df = spark.createDataFrame(rows, SCHEMA)
    want = {}
    for r in graph.continuation_scores(df).collect():
        want[r.node, r.a] = min(want.get((r.node, r.a), (9, 0)), (-r.score, r.b))
    found = {(r.node, r.a): (-r.score, r.b) for r in graph.best_continuations(df).collect()}
    assert found == want and len(want) > 200


def test_rounds_of_a_spanning_tree_get_smaller(spark, monkeypatch):
    sizes = []
    whole = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df: (sizes.append(whole(df).count() if "v" not in df.columns and {"a", "b", "e"} == set(df.columns) else None), whole(df))[1])
    rows = [(u * 100 + v, u, v, float((u * 37 + v * 61) % 89)) for u in range(30) for v in range(30)]  # both directions and loops
    tree = graph.minimum_spanning_tree(spark.createDataFrame(rows, "id long, u long, v long, weight double")).collect()
    sizes = [n for n in sizes if n]
    took, name = [], list(range(30))
    for w, u, v, k in sorted((w, min(u, v), max(u, v), k) for k, u, v, w in rows if u != v):
        if name[u] != name[v]:
            took.append((k, u, v, w))
            name = [name[u] if n == name[v] else n for n in name]
    assert sorted(map(tuple, tree)) == sorted(took) and sizes[0] == 30 * 29 and all(n <= 15 * 14 // 2 for n in sizes[2::2])


def test_trade_is_dealt_to_tasks_by_its_rows(spark, sf_dir, monkeypatch):
    from meridion.plans import views

    monkeypatch.setattr(views, "TASK_ROWS", 500)
    rows = views.table(spark, sf_dir, "lineitem").count()
    t = views.trade(spark, sf_dir)
    assert t.rdd.getNumPartitions() > rows // 500 and max(t.rdd.glom().map(len).collect()) < 750
    assert t.count() == views.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().count()
