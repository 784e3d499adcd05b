"""Networks as edge tables (id, u, v, weight, ..): undirected, parallel edges allowed."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridion.functions import geometry as g
from meridion.operators import stats
from meridion.operators.components import connected_components
from meridion.session import materialize


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (id, node, other, ..)."""
    rest = [c for c in edges.columns if c not in ("id", "u", "v")]
    one = edges.select("id", F.col("u").alias("node"), F.col("v").alias("other"), *rest)
    return one.unionByName(edges.select("id", F.col("v").alias("node"), F.col("u").alias("other"), *rest))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("u").alias("node")).unionByName(edges.select(F.col("v").alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def dead_ends(edges: DataFrame) -> DataFrame:
    return degrees(edges).where("degree = 1").select("node")


def simple(edges: DataFrame) -> DataFrame:
    """One edge per pair, the cheapest (then the smallest id); no loops."""
    t = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.struct("weight", "id").alias("w"))
    return t.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", F.col("w.weight").alias("weight"), F.col("w.id").alias("id"))


def minimum_spanning_tree(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(id, u, v, weight) of the tree's edges (ties by u, v).

    Boruvka: in each round every component takes its cheapest edge to another one, so their number halves at least.  A round
    goes on with what is left between the new components, for each two of them the cheapest edge, so rounds get smaller.
    """
    # (weight, u, v) is the order that edges are taken in; a and b are the components that an edge joins.
    e = edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "weight", "id")
    e, tree = materialize(e.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v", "id").alias("e"))), None
    for _ in range(max_rounds):
        pick = e.select(F.explode(F.array("a", "b")).alias("c"), F.struct("e", "a", "b").alias("m")).groupBy("c").agg(F.min("m").alias("m"))
        took = materialize(pick.select("m.*").distinct())
        new = took.select("e.id", "e.u", "e.v", "e.weight")
        tree = new if tree is None else tree.unionByName(new)
        if took.isEmpty():
            return tree
        merged = materialize(connected_components(took, "a", "b"))
        for c in "ab":  # every component has taken an edge, so it is among the merged
            e = e.join(merged.withColumnsRenamed({"node": c, "component": f"_{c}"}), c).drop(c).withColumnRenamed(f"_{c}", c)
        e = e.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
        e = materialize(e)
    raise RuntimeError("the tree did not settle")


def _dealt(adj: DataFrame) -> DataFrame:
    """``adj`` written once by node and in order, so that rounds which join what they look at neither shuffle nor sort it."""
    spark = adj.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    adj = materialize(adj)
    try:  # a checkpoint of an adaptive plan does not tell how its rows are dealt
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        return materialize(adj.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").sortWithinPartitions("node"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def _distances(adj: DataFrame, sources: DataFrame, max_rounds: int) -> DataFrame:
    """(src, node, dist) of all sources at once; only distances that the last round improved are looked at again."""
    state = materialize(sources.select(F.col("node").alias("src"), "node", F.lit(0.0).alias("dist")).distinct())
    delta = state
    for _ in range(max_rounds):
        out = delta.join(adj, "node").select("src", F.col("other").alias("node"), (F.col("dist") + F.col("weight")).alias("d")).groupBy("src", "node").agg(F.min("d").alias("d"))
        delta = materialize(out.join(state, ["src", "node"], "left").where("dist is null or d < dist - 1e-9").select("src", "node", F.col("d").alias("dist")))
        if delta.isEmpty():
            return state
        state = materialize(state.unionByName(delta).groupBy("src", "node").agg(F.min("dist").alias("dist")))
    raise RuntimeError("paths did not settle")


def _last_steps(state: DataFrame, adj: DataFrame) -> DataFrame:
    """(src, prev, node): the steps that least distances end with."""
    back = state.join(adj, "node").select("src", F.col("other").alias("to"), F.col("node").alias("prev"), (F.col("dist") + F.col("weight")).alias("d"))
    best = back.join(state.select("src", F.col("node").alias("to"), F.col("dist").alias("at")), ["src", "to"]).where("abs(d - at) < 1e-9 and to <> src")
    return best.select("src", "prev", F.col("to").alias("node"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_rounds: int = 500) -> DataFrame:
    """(src, node, dist, prev): least distance from every source; prev ties to the smallest."""
    adj = _dealt(adjacency(simple(edges)).select("node", "other", "weight")).hint("merge")
    state = _distances(adj, sources, max_rounds)
    prev = _last_steps(state, adj).groupBy("src", "node").agg(F.min("prev").alias("prev"))
    return state.join(prev, ["src", "node"], "left")


def trace_paths(paths: DataFrame, pairs: DataFrame, max_hops: int = 1000) -> DataFrame:
    """(src, dst, .., u, v): the edges of the path of each pair (src, dst, ..)."""
    p = materialize(paths.select("src", "node", "prev"))
    rest = [c for c in pairs.columns if c not in ("src", "dst")]
    now, done = materialize(pairs.withColumn("node", F.col("dst"))), None
    for n in range(max_hops):
        step = materialize(now.join(p, ["src", "node"]).where("prev is not null"))
        if step.isEmpty():
            return done if done is not None else step.select("src", "dst", *rest, F.least("node", "prev").alias("u"), F.greatest("node", "prev").alias("v"))
        out = step.select("src", "dst", *rest, F.least("node", "prev").alias("u"), F.greatest("node", "prev").alias("v"))
        done = out if done is None else done.unionByName(out)
        done = materialize(done) if n % 8 == 7 else done
        now = step.select("src", "dst", *rest, F.col("prev").alias("node"))
    raise RuntimeError("a path does not end")


def od_demand(hubs: DataFrame) -> DataFrame:
    """(src, dst, demand): each pair of hubs by tiers, and for each tier-3 hub a row to its nearest hub of a higher tier."""
    a = hubs.select(F.col("id").alias("src"), F.col("tier").alias("ta"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = hubs.select(F.col("id").alias("dst"), F.col("tier").alias("tb"), F.col("x").alias("bx"), F.col("y").alias("by"))
    lo, hi = F.least("ta", "tb"), F.greatest("ta", "tb")
    at = lambda i, j, n: ((lo == i) & (hi == j), n)
    rules = [at(1, 2, 180.0), at(1, 3, 90.0), at(2, 2, 70.0), at(2, 3, 45.0), at(3, 3, 20.0)]
    demand = F.coalesce(*(F.when(c, n) for c, n in rules), F.lit(30.0))
    pairs = a.join(b, F.col("src") < F.col("dst")).select("src", "dst", demand.alias("demand"))
    return pairs.unionByName(nearest_higher(hubs).where("tier = 3").select(F.col("id").alias("src"), F.col("higher").alias("dst"), F.lit(35.0).alias("demand")))


def nearest_higher(hubs: DataFrame) -> DataFrame:
    """(id, tier, higher): the nearest hub of a strictly higher tier; ties by id."""
    b = hubs.select(F.col("id").alias("o"), F.col("tier").alias("t2"), F.col("x").alias("bx"), F.col("y").alias("by"))
    t = hubs.join(F.broadcast(b), F.col("t2") < F.col("tier"))
    return t.groupBy("id", "tier").agg(F.min(F.struct(g.distance("x", "y", "bx", "by").alias("d"), "o")).alias("m")).select("id", "tier", F.col("m.o").alias("higher"))


def assign_flows(edges: DataFrame, demand: DataFrame) -> DataFrame:
    """(id, u, v, flow): demand summed over the edges of shortest paths; other edges have 0."""
    e = simple(edges)
    paths = shortest_paths(edges, demand.select(F.col("src").alias("node")).distinct())
    used = trace_paths(paths, demand.groupBy("src", "dst").agg(F.sum("demand").alias("demand"))).groupBy("u", "v").agg(F.sum("demand").alias("flow"))
    return e.join(used, ["u", "v"], "left").select("id", "u", "v", F.coalesce("flow", F.lit(0.0)).alias("flow"))


def capacity(road_class: Column, length_m: Column) -> Column:
    return F.when(road_class == "arterial", 1200.0).otherwise(420.0) * F.least(F.lit(1.8), F.greatest(F.lit(0.6), length_m / 140))


def _spread(start: DataFrame, steps: DataFrame, at: str, to: str, max_rounds: int) -> DataFrame:
    """(src, node, x): ``start``'s values carried along the steps from ``at`` to ``to``, added up over all walks."""
    now, total = start, start
    for n in range(max_rounds):
        moved = now.withColumnRenamed("node", at).join(steps, ["src", at]).groupBy("src", to).agg(F.sum("x").alias("x"))
        now = materialize(moved.withColumnRenamed(to, "node"))
        if now.isEmpty():
            return materialize(total.groupBy("src", "node").agg(F.sum("x").alias("x")))
        total = total.unionByName(now)
        if n % 8 == 7:
            total = materialize(total.groupBy("src", "node").agg(F.sum("x").alias("x")))
    raise RuntimeError("shortest paths have a cycle: weights have to be above zero")


def edge_betweenness(edges: DataFrame, block_rows: int = 50_000_000, max_rounds: int = 10_000) -> DataFrame:
    """(u, v, score): shares of shortest paths between all pairs that use each edge (exact); weights above zero.

    Numbers of paths go forward over the last steps of shortest paths, shares of what lies behind go backward, all by
    joins and sums of (source, node) rows.  Sources are taken in blocks of about ``block_rows`` such rows.
    """
    e = materialize(simple(edges).select("u", "v", "weight"))
    adj = materialize(adjacency(e.withColumn("id", F.lit(0))).select("node", "other", "weight"))
    nodes = materialize(adj.select("node").distinct())
    blocks = nodes.count() ** 2 // block_rows + 1
    got = None
    for k in range(blocks):
        state = _distances(adj, nodes.where(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k), max_rounds)
        steps = materialize(_last_steps(state, adj))
        along = steps.withColumnRenamed("node", "next")
        count = _spread(state.where("src = node").select("src", "node", F.lit(1.0).alias("x")), along, "prev", "next", max_rounds)
        behind = _spread(count.where("src <> node").withColumn("x", 1 / F.col("x")), along, "next", "prev", max_rounds)
        used = steps.join(count.withColumnsRenamed({"node": "prev", "x": "c"}), ["src", "prev"]).join(behind, ["src", "node"])
        part = used.groupBy(F.least("prev", "node").alias("u"), F.greatest("prev", "node").alias("v")).agg((F.sum(F.col("c") * F.col("x")) / 2).alias("score"))
        got = materialize(part if got is None else got.unionByName(part).groupBy("u", "v").agg(F.sum("score").alias("score")))
    return e.select("u", "v").join(got, ["u", "v"], "left").select("u", "v", F.coalesce("score", F.lit(0.0)).alias("score"))


def incident_pairs(edges: DataFrame) -> DataFrame:
    """(node, a, b): all ordered pairs of different edges that share a node."""
    t = adjacency(edges.select("id", "u", "v")).select("node", F.col("id").alias("a"))
    return t.join(t.withColumnRenamed("a", "b"), "node").where("a <> b")


# Degrees by which a street may turn and still go on, by class and with a spine; factor for a change of
# class; share of the wider by which widths may differ; factor for two spines; length from which a run is a spine.
MAX_TURN = {"arterial": 15.0, "major_local": 18.0}
LOCAL_TURN = 22.0
SPINE_TURN = 12.0
CLASS_MISMATCH = 0.3
WIDTH_TOLERANCE = 0.35
SPINE_BONUS = 1.5
SPINE_LENGTH = 500.0


def edge_ends(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, id, road_class, width_m, spine, dx, dy): both ends of each edge with the direction in which it leaves.

    An edge with a ``path`` of points leaves along its first part, one without (then ``nodes`` are needed) along the
    straight line.  Without a ``width_m`` all are equally wide, without ``flags`` none is a spine.
    """
    has = edges.columns
    width = F.col("width_m").cast("double") if "width_m" in has else F.lit(1.0)
    spine = F.coalesce(F.array_contains("flags", "local_spine"), F.lit(False)) if "flags" in has else F.lit(False)
    t = edges.select("id", "u", "v", "road_class", width.alias("width_m"), spine.alias("spine"), *(["path"] if "path" in has else []))
    if "path" in has:
        step = lambda a, b, c: F.element_at("path", b)[c] - F.element_at("path", a)[c]
        ways = [("u", step(1, 2, "x"), step(1, 2, "y")), ("v", step(-1, -2, "x"), step(-1, -2, "y"))]
    else:
        at = lambda e: nodes.select(F.col("id").alias(e), F.col("x").alias(f"{e}x"), F.col("y").alias(f"{e}y"))
        t = t.join(at("u"), "u").join(at("v"), "v")
        ways = [("u", F.col("vx") - F.col("ux"), F.col("vy") - F.col("uy")), ("v", F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))]
    ends = F.array(*(F.struct(F.col(e).alias("node"), F.lit(e).alias("side"), dx.alias("dx"), dy.alias("dy")) for e, dx, dy in ways))
    return t.withColumn("e", F.explode(ends)).select("e.node", "id", "road_class", "width_m", "spine", "e.side", "e.dx", "e.dy")


def _scored(a: DataFrame, b: DataFrame, met: Column) -> DataFrame:
    """Pairs of ends (a_.., b_..) at one node for which ``met`` holds and that score, with score and turn.

    They meet by sectors of the circle that are wider than any turn: a looks ahead, and a sector to either side.
    """
    n = int(360 // max(SPINE_TURN, LOCAL_TURN, *MAX_TURN.values()))
    sector = lambda p, way: F.pmod(F.floor(F.atan2(way * F.col(f"{p}dy"), way * F.col(f"{p}dx")) / (2 * math.pi) * n), F.lit(n))
    ahead = F.explode(F.array_distinct(F.array(*(F.pmod(sector("a_", -1) + k, F.lit(n)) for k in (-1, 0, 1)))))
    t = a.withColumn("_sector", ahead).join(b.withColumn("b_sector", sector("b_", 1)), (F.col("a_node") == F.col("b_node")) & (F.col("_sector") == F.col("b_sector")) & met)
    turn = 180 - g.angle_between("a_dx", "a_dy", "b_dx", "b_dy", 0.0)
    local = F.when(F.col("a_spine") | F.col("b_spine"), SPINE_TURN).otherwise(LOCAL_TURN)
    most = lambda c: F.coalesce(*(F.when(c == k, x) for k, x in MAX_TURN.items()), local)
    t = t.withColumn("turn", turn).withColumn("most", F.greatest(most(F.col("a_road_class")), most(F.col("b_road_class"))))
    wider = F.greatest("a_width_m", "b_width_m")
    width = F.when(wider > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.col("a_width_m") - F.col("b_width_m")) / wider / WIDTH_TOLERANCE)).otherwise(1.0)
    score = (1 - F.col("turn") / F.col("most")) * F.when(F.col("a_road_class") == F.col("b_road_class"), 1.0).otherwise(CLASS_MISMATCH)
    score = score * width * F.when(F.col("a_spine") & F.col("b_spine"), SPINE_BONUS).otherwise(1.0)
    return t.where("turn < most").withColumn("score", F.round(score, 6)).where("score > 0")


def _side(ends: DataFrame, prefix: str) -> DataFrame:
    return ends.select(*(F.col(c).alias(f"{prefix}{c}") for c in ends.columns))


def continuation_scores(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, a, b, score, turn): how well b goes on from a, by angle, class, width and spine; pairs that score nothing have none."""
    far = edge_ends(edges, nodes).drop("side")
    t = _scored(_side(far, "a_"), _side(far, "b_"), F.col("a_id") != F.col("b_id"))
    return t.select(F.col("a_node").alias("node"), F.col("a_id").alias("a"), F.col("b_id").alias("b"), "score", "turn")


def best_continuations(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, a, b, score, turn): for each edge a at a node the other edge that goes on from it best; ties to the smaller id.

    Edges that leave a node alike (by direction, class, width and spine) score alike and are never each other's
    continuation, so only the smallest of them is compared: work grows with the kinds of ends at a node, not with the
    pairs of its edges.  Both ends of a loop are a kind of their own.
    """
    own = F.when(F.col("u") == F.col("v"), F.col("id"))
    far = edge_ends(edges, nodes).join(edges.where(own.isNotNull()).select("id", F.lit(True).alias("_loop")), "id", "left")
    far = far.withColumn("own", F.when(F.col("_loop"), F.col("id"))).drop("_loop")
    kind = Window.partitionBy("node", "road_class", "width_m", "spine", "dx", "dy", "own")
    far = materialize(far.withColumn("kind", F.min(F.struct("id", "side")).over(kind)))
    firsts = far.where(F.struct("id", "side") == F.col("kind")).drop("side")
    apart = F.coalesce(F.col("a_own") != F.col("b_own"), F.lit(True))
    t = _scored(_side(firsts, "a_"), _side(firsts, "b_"), apart)
    best = t.groupBy("a_node", "a_kind").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("b_id").alias("b"), "turn")).alias("m"))
    each = far.select(F.col("node").alias("a_node"), F.col("kind").alias("a_kind"), F.col("id").alias("a")).join(best, ["a_node", "a_kind"])
    each = each.groupBy(F.col("a_node").alias("node"), "a").agg(F.min("m").alias("m"))  # a loop has two ends
    return each.select("node", "a", F.col("m.b").alias("b"), (-F.col("m.s")).alias("score"), "m.turn")


def mutual_best(candidates: DataFrame) -> DataFrame:
    """(node, a, b): pairs of which each is the other's best at the node; a < b; ties to the smaller id."""
    best = candidates.groupBy("node", "a").agg(F.min(F.struct((-F.col("score")).alias("s"), "b")).alias("m")).select("node", "a", F.col("m.b").alias("b"))
    back = best.select("node", F.col("a").alias("b"), F.col("b").alias("a"))
    return best.join(back, ["node", "a", "b"], "left_semi").where("a < b")


def continuations(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, a, b, turn): the pairs of edges that go on in each other, with the degrees of the bend; written once."""
    t = materialize(best_continuations(edges, nodes))
    return materialize(mutual_best(t).join(t.select("node", "a", "b", "turn"), ["node", "a", "b"]))


def strokes(edges: DataFrame, nodes: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """(id, stroke): edges chained over mutually best continuations; a stroke is named by its smallest edge."""
    links = mutual_best(materialize(best_continuations(edges, nodes))) if links is None else links
    joined = connected_components(links, "a", "b")
    return edges.select("id").join(joined, edges["id"] == joined["node"], "left").select("id", F.coalesce("component", "id").alias("stroke"))


def stroke_summary(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(stroke, n_edges, length_m, road_class, bearing, deflection, spine, flags), a row for each stroke.

    ``road_class`` has most of the length (ties: the smaller name), ``bearing`` is the circular mean of the directions
    in which edges leave their first node, ``deflection`` the sum of the bends between edges.  A stroke is a spine by
    the flag of an edge or by its length; one by length gets the flag ``local_spine_run``.
    """
    links = continuations(edges, nodes)
    of = materialize(strokes(edges, nodes, links))
    t = edges.select("id", "road_class", "length_m", "flags").join(of, "id")
    way = edge_ends(edges, nodes).where("side = 'u'").select("id", F.degrees(F.atan2("dy", "dx")).alias("way"))
    bearing = stats.circular_mean(way.join(of, "id"), ["stroke"], "way").withColumnRenamed("mean", "bearing")
    bends = links.join(of, F.col("a") == F.col("id")).groupBy("stroke").agg(F.sum("turn").alias("deflection"))
    # Flags are few kinds: each stroke's kinds are made distinct before they are listed.
    kinds = t.select("stroke", F.explode("flags").alias("flag")).distinct().groupBy("stroke").agg(F.collect_set("flag").alias("flags"))
    s = t.groupBy("stroke").agg(F.count("*").alias("n_edges"), F.sum("length_m").alias("length_m"))
    s = s.join(stats.dominant(t, ["stroke"], "road_class", F.col("length_m")).select("stroke", F.col("dominant").alias("road_class")), "stroke")
    s = s.join(bearing, "stroke").join(bends, "stroke", "left").join(kinds, "stroke", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    flagged = F.array_contains(flags, "local_spine")
    spine = flagged | (F.col("length_m") >= SPINE_LENGTH)
    flags = F.array_sort(F.when(spine & ~flagged, F.array_union(flags, F.array(F.lit("local_spine_run")))).otherwise(flags))
    return s.select("stroke", "n_edges", "length_m", "road_class", "bearing", F.coalesce("deflection", F.lit(0.0)).alias("deflection"), spine.alias("spine"), flags.alias("flags"))


def stroke_metrics(summary: DataFrame, low: float = 1000.0, high: float = 2000.0) -> DataFrame:
    """(scope, n, p50, p90, p99, mean_edges, deflection_p90, in_band) over all strokes, spines, and each class."""
    scopes = F.array_compact(F.array(F.lit("all"), F.when(F.col("spine"), "spine"), F.col("road_class")))
    t = summary.withColumn("scope", F.explode(scopes))
    rest = t.groupBy("scope").agg(F.count("*").alias("n"), F.avg("n_edges").alias("mean_edges"), F.percentile("deflection", 0.9).alias("deflection_p90"), F.avg(F.when(F.col("length_m").between(low, high), 1.0).otherwise(0.0)).alias("in_band"))
    return stats.percentiles(t, ["scope"], "length_m").join(rest, "scope")


def prune_dangles(edges: DataFrame, min_length: float) -> DataFrame:
    """Without short dead-end edges of local classes; culdesacs stay, and minor_local from 25 m on."""
    d = degrees(edges)
    t = edges.join(d.withColumnsRenamed({"node": "u", "degree": "du"}), "u").join(d.withColumnsRenamed({"node": "v", "degree": "dv"}), "v")
    loose = (F.col("du") == 1) | (F.col("dv") == 1)
    local = F.col("road_class") != "arterial"
    keep = F.array_contains("flags", "culdesac") | ((F.col("road_class") == "minor_local") & (F.col("length_m") >= 25))
    return t.where(~(loose & local & ~keep & (F.col("length_m") < min_length))).drop("du", "dv")


def bridge_components(edges: DataFrame, nodes: DataFrame, candidates: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Edges with the cheapest candidate edges (u, v, weight) that connect their components, round by round."""
    all_ = materialize(edges.select("u", "v", "weight"))
    for _ in range(max_rounds):
        comp = connected_components(all_)
        label = nodes.select(F.col("id").alias("n")).join(comp, F.col("n") == F.col("node"), "left").select("n", F.coalesce("component", "n").alias("c"))
        label = materialize(label)
        cross = candidates.join(label.withColumnsRenamed({"n": "u", "c": "cu"}), "u").join(label.withColumnsRenamed({"n": "v", "c": "cv"}), "v").where("cu <> cv")
        pick = cross.select(F.explode(F.array("cu", "cv")).alias("c"), F.struct("weight", "u", "v").alias("e")).groupBy("c").agg(F.min("e").alias("e")).select("e.u", "e.v", "e.weight").distinct()
        pick = materialize(pick)
        if pick.isEmpty():
            return all_
        all_ = materialize(all_.unionByName(pick))
    raise RuntimeError("components did not settle")


def loop_edges(edges: DataFrame, budget: int, least_gain: float = 0.10) -> DataFrame:
    """(id, u, v, gain): the edges outside the tree that shorten ways most: detour over the tree less 1."""
    tree = minimum_spanning_tree(edges)
    e = simple(edges).join(tree.select("id"), "id", "left_anti")
    paths = shortest_paths(tree, e.select(F.col("u").alias("node")).distinct())
    t = e.join(paths.select(F.col("src").alias("u"), F.col("node").alias("v"), "dist"), ["u", "v"])
    t = t.withColumn("gain", F.col("dist") / F.col("weight") - 1).where(F.col("gain") > least_gain)
    return t.orderBy(F.desc("gain"), "u", "v").limit(budget).select("id", "u", "v", "gain")


def backbone(edges: DataFrame, loop_budget: int) -> DataFrame:
    tree = minimum_spanning_tree(edges).select("id", "u", "v").withColumn("kind", F.lit("tree"))
    return tree.unionByName(loop_edges(edges, loop_budget).select("id", "u", "v").withColumn("kind", F.lit("loop")))


def width_guidance(scored: DataFrame, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """(.., guidance): edges by the quantiles of their score."""
    q = scored.agg(F.percentile("score", low).alias("lo"), F.percentile("score", high).alias("hi"))
    return scored.join(F.broadcast(q)).withColumn("guidance", F.when(F.col("score") >= F.col("hi"), "widen").when(F.col("score") <= F.col("lo"), "narrow").otherwise("keep")).drop("lo", "hi")


def lineage(edges: DataFrame) -> DataFrame:
    """(continuity, n_edges, length): edges per continuity group; edges without one are a group by themselves."""
    c = F.coalesce("continuity_id", F.concat(F.lit("local-auto-"), F.col("id").cast("string")))
    return edges.groupBy(c.alias("continuity")).agg(F.count("*").alias("n_edges"), F.sum("length_m").alias("length"))


def orphans(edges: DataFrame) -> DataFrame:
    """Edges whose parent group does not exist."""
    groups = edges.select(F.col("continuity_id").alias("parent_continuity_id")).distinct()
    return edges.where("parent_continuity_id is not null").join(groups, "parent_continuity_id", "left_anti")


def segment_order(edges: DataFrame) -> DataFrame:
    """(id, continuity_id, segment_order): 0, 1, .. along each group, from its smallest leaf on.

    Groups are few edges each; within one, the walk goes on over the unvisited edge with the smallest id and starts
    again at the smallest edge that is left.
    """

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        ends = {}
        for i, u, v in zip(t["id"], t["u"], t["v"], strict=True):
            ends.setdefault(u, []).append(i)
            ends.setdefault(v, []).append(i)
        at = {i: (u, v) for i, u, v in zip(t["id"], t["u"], t["v"], strict=True)}
        order, left = [], set(at)
        leaves = sorted(n for n, e in ends.items() if len(e) == 1)
        node = leaves[0] if leaves else min(ends)
        while left:
            more = sorted(i for i in ends.get(node, []) if i in left)
            i = more[0] if more else min(left)
            node = at[i][1] if at[i][0] == node else at[i][0]
            order.append(i)
            left.discard(i)
        return pd.DataFrame({"id": order, "continuity_id": t["continuity_id"].iloc[0], "segment_order": range(len(order))})

    return edges.select("id", "u", "v", "continuity_id").groupBy("continuity_id").applyInPandas(walk, "id long, continuity_id string, segment_order long")
