"""Network queries over the edges between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.operators import graph as g
from meridion.operators import stats
from meridion.operators.components import connected_components as cc
from meridion.operators.topology import path_length
from meridion.plans import views as v
from meridion.plans.joins import _BENT, _bent_streets
from meridion.plans.registry import query
from meridion.session import materialize, table


def r4(c):
    return F.round(c, 4)


_ADJ = "adj AS (SELECT id, u AS node, v AS other, weight FROM edges UNION ALL SELECT id, v, u, weight FROM edges)"
_CC = f"RECURSIVE WITH {_ADJ}, w(node, c) AS (SELECT DISTINCT node, node FROM adj UNION SELECT adj.other, w.c FROM w JOIN adj USING (node)), comp AS (SELECT node, min(c) AS component FROM w GROUP BY 1)"
_SP = f"""RECURSIVE WITH {_ADJ}, p(n, src, node, dist) AS (SELECT 0, node, node, 0.0::DOUBLE FROM (SELECT DISTINCT node FROM adj) UNION ALL
    SELECT n + 1, src, node, min(dist) FROM (SELECT p.n, p.src, adj.other AS node, p.dist + adj.weight AS dist FROM p JOIN adj USING (node) UNION ALL SELECT n, src, node, dist FROM p) WHERE n < 26 GROUP BY n, src, node),
    sp AS (SELECT src, node, min(dist) AS dist FROM p WHERE n = 26 GROUP BY ALL)"""
_PREV = "pv AS (SELECT a.src, a.node, min(adj.other) AS prev FROM sp a JOIN adj ON adj.node = a.node JOIN sp b ON b.src = a.src AND b.node = adj.other WHERE abs(b.dist + adj.weight - a.dist) < 1e-9 AND a.node <> a.src GROUP BY ALL)"


@query("adjacency", "edges", f"WITH {_ADJ} SELECT id, node, other FROM adj")
def adjacency(spark, d):
    return g.adjacency(v.edges(spark, d)).select("id", "node", "other")


@query("node_degree", "edges", f"WITH {_ADJ} SELECT node, count(*) AS degree FROM adj GROUP BY node")
def node_degree(spark, d):
    return g.degrees(v.edges(spark, d))


_STREETS = f"WITH {_BENT}, st AS (SELECT b.id, b.x::BIGINT || ':' || b.y::BIGINT AS u, b.xe::BIGINT || ':' || b.ye::BIGINT AS v, b.id % 3 AS class, b.id % 4 = 0 AS cul, sum(len) AS length FROM bs b JOIN sl USING (id) GROUP BY ALL), dg AS (SELECT node, count(*) AS n FROM (SELECT u AS node FROM st UNION ALL SELECT v FROM st) GROUP BY 1)"


@query("dead_ends", "seg", f"{_STREETS} SELECT node FROM dg WHERE n = 1")
def dead_ends(spark, d):
    """Nodes of the streets with one edge."""
    return g.dead_ends(_bent_streets(spark, d)[1])


@query("connected_components", "edges", f"{_CC} SELECT node, component FROM comp")
def connected_components(spark, d):
    return cc(v.edges(spark, d))


@query("largest_component_ratio", "trade", f"{_CC.replace('FROM edges', 'FROM trade')} SELECT round(max(n) / (SELECT count(*) FROM comp)::DOUBLE, 6) AS ratio FROM (SELECT component, count(*) AS n FROM comp GROUP BY 1)")
def largest_component_ratio(spark, d):
    t = cc(v.trade(spark, d)).groupBy("component").agg(F.count("*").alias("n"))
    return t.agg(F.round(F.max("n") / F.sum("n"), 6).alias("ratio"))


@query("network_metrics", "edges", f"""{_CC}, dg AS (SELECT node, count(*) AS n FROM adj GROUP BY 1) SELECT (SELECT count(*) FROM dg) AS nodes, (SELECT count(*) FROM edges) AS edges, (SELECT round(avg(weight), 4) FROM edges) AS mean_weight,
    (SELECT count(*) FROM dg WHERE n = 1) AS dead_ends, (SELECT count(DISTINCT component) FROM comp) = 1 AS connected,
    (SELECT round(max(n) / sum(n)::DOUBLE, 6) FROM (SELECT count(*) AS n FROM comp GROUP BY component)) AS connectivity""")
def network_metrics(spark, d):
    e = v.edges(spark, d)
    one = e.agg(F.count("*").alias("edges"), r4(F.avg("weight")).alias("mean_weight"))
    deg = g.degrees(e).agg(F.count("*").alias("nodes"), F.count_if(F.col("degree") == 1).alias("dead_ends"))
    comp = cc(e).groupBy("component").agg(F.count("*").alias("n")).agg((F.count("*") == 1).alias("connected"), F.round(F.max("n") / F.sum("n"), 6).alias("connectivity"))
    return one.join(F.broadcast(deg)).join(F.broadcast(comp)).select("nodes", "edges", "mean_weight", "dead_ends", "connected", "connectivity")


@query("shortest_paths", "edges", f"{_SP} SELECT src, node, round(dist, 4) AS dist FROM sp")
def shortest_paths(spark, d):
    e = v.edges(spark, d)
    return g.shortest_paths(e, g.degrees(e).select("node")).select("src", "node", r4("dist").alias("dist"))


@query("minimum_spanning_tree")
def minimum_spanning_tree(spark, d):
    return g.minimum_spanning_tree(v.edges(spark, d)).select("id", "u", "v", "weight")


@query("loop_edge_top_k", "edges")
def loop_edge_top_k(spark, d):
    return g.loop_edges(v.edges(spark, d), 6).withColumn("gain", r4("gain"))


@query("backbone", "edges")
def backbone(spark, d):
    return g.backbone(v.edges(spark, d), 6)


@query("bridge_components", "edges")
def bridge_components(spark, d):
    """The arterials, and the other edges that connect their parts."""
    e = v.edges(spark, d)
    return g.bridge_components(e.where("road_class = 'arterial'"), v.hubs(spark, d), e.select("u", "v", "weight"))


_BET = f"""{_SP}, {"cn(n, src, node, k) AS (SELECT 0, src, src, 1.0::DOUBLE FROM sp WHERE src = node UNION ALL SELECT cn.n + 1, cn.src, adj.other, cn.k FROM cn JOIN adj ON adj.node = cn.node JOIN sp a ON a.src = cn.src AND a.node = cn.node JOIN sp b ON b.src = cn.src AND b.node = adj.other WHERE abs(a.dist + adj.weight - b.dist) < 1e-9 AND cn.n < 26)"},
    ct AS (SELECT src, node, sum(k) AS c FROM cn GROUP BY ALL),
    bt AS (SELECT e.u, e.v, sum(x.c * y.c / t.c) / 2 AS score FROM edges e, LATERAL (VALUES (e.u, e.v), (e.v, e.u)) o(a, b) JOIN ct x ON x.node = o.a JOIN sp sx ON sx.src = x.src AND sx.node = o.a JOIN ct y ON y.src = o.b JOIN ct t ON t.src = x.src AND t.node = y.node JOIN sp sy ON sy.src = o.b AND sy.node = y.node
      JOIN sp st ON st.src = x.src AND st.node = y.node WHERE abs(sx.dist + e.weight + sy.dist - st.dist) < 1e-9 GROUP BY ALL)"""


@query("edge_betweenness", "edges", f"{_BET} SELECT e.u, e.v, round(coalesce(score, 0), 4) AS score FROM edges e LEFT JOIN bt USING (u, v)")
def edge_betweenness(spark, d):
    return g.edge_betweenness(v.edges(spark, d)).select("u", "v", r4("score").alias("score"))


@query("width_guidance", "edges", f"{_BET}, sc AS (SELECT e.u, e.v, round(coalesce(score, 0), 4) AS score FROM edges e LEFT JOIN bt USING (u, v)), q AS (SELECT quantile_cont(score, 0.15) AS lo, quantile_cont(score, 0.85) AS hi FROM sc) SELECT u, v, CASE WHEN score >= hi THEN 'widen' WHEN score <= lo THEN 'narrow' ELSE 'keep' END AS guidance FROM sc, q")
def width_guidance(spark, d):
    return g.width_guidance(g.edge_betweenness(v.edges(spark, d)).withColumn("score", r4("score"))).select("u", "v", "guidance")


@query("prune_dangles", "seg", f"{_STREETS} SELECT id FROM st JOIN dg a ON a.node = u JOIN dg b ON b.node = v WHERE NOT ((a.n = 1 OR b.n = 1) AND class <> 0 AND NOT (cul OR (class = 2 AND length >= 25)) AND length < 200)")
def prune_dangles(spark, d):
    """The streets without their short dead ends."""
    from meridion.operators.topology import path_length

    edges = _bent_streets(spark, d)[1]
    return g.prune_dangles(edges.withColumn("length_m", path_length(F.col("path"))), 200.0).select("id")


_INC = "inc AS (SELECT node, id FROM (SELECT id, u AS node FROM edges UNION ALL SELECT id, v FROM edges))"


@query("incident_pairs", "edges", f"WITH {_INC} SELECT a.node, a.id AS a, b.id AS b FROM inc a JOIN inc b ON a.node = b.node AND a.id <> b.id")
def incident_pairs(spark, d):
    return g.incident_pairs(v.edges(spark, d))


def _lanes(spark, d):
    """Streets upwards over a lattice of 100 m, with a bend, a width and flags: three directions, so that some go on in others."""
    k = F.col("id")
    dx = k % 3 - 1
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x, y = F.floor(F.col("x0") / 100) * 100, F.floor(F.col("y0") / 100) * 100
    name = lambda x, y: (x * 1000000 + y).cast("long")
    path = F.array(at(x, y), at(x + dx * 40 + k % 7, y + 50), at(x + dx * 100, y + 100))
    c = F.floor(k / 3).cast("long") % 3
    flags = F.array_compact(F.array(F.when(k % 4 == 0, "culdesac"), F.when(F.floor(k / 9).cast("long") % 5 < 2, "local_spine")))
    t = v.seg(spark, d).select(
        "id", name(x, y).alias("u"), name(x + dx * 100, y + 100).alias("v"), path.alias("path"), (6 + F.floor(k / 45).cast("long") % 5).cast("double").alias("width_m"), flags.alias("flags"),
        F.when(c == 0, "arterial").when(c == 1, "major_local").otherwise("minor_local").alias("road_class"),
    )
    return t.withColumn("length_m", path_length(F.col("path")))


_LANES = """ln AS (SELECT id, x * 1000000 + y AS u, (x + dx * 100) * 1000000 + y + 100 AS v, x, y, dx, id % 7 AS m, (6 + id // 45 % 5)::DOUBLE AS width_m, id // 9 % 5 < 2 AS sp, id % 4 = 0 AS cul, CASE id // 3 % 3 WHEN 0 THEN 'arterial' WHEN 1 THEN 'major_local' ELSE 'minor_local' END AS road_class
      FROM (SELECT id, floor(x0/100)::BIGINT*100 AS x, floor(y0/100)::BIGINT*100 AS y, id % 3 - 1 AS dx FROM seg)),
    le AS (SELECT *, sqrt(pow(dx*40+m,2)+2500) + sqrt(pow(dx*60-m,2)+2500) AS length_m FROM ln)"""
_CONT = f"""{_LANES}, fr AS (SELECT u AS node, id, road_class, width_m, sp, (dx*40+m)::DOUBLE AS dx, 50.0::DOUBLE AS dy FROM ln UNION ALL SELECT v, id, road_class, width_m, sp, (m-dx*60)::DOUBLE, -50.0::DOUBLE FROM ln),
    sc AS (SELECT a.node, a.id AS a, b.id AS b, 180 - degrees(acos(least(1.0, greatest(-1.0, (a.dx*b.dx+a.dy*b.dy) / (sqrt(a.dx*a.dx+a.dy*a.dy)*sqrt(b.dx*b.dx+b.dy*b.dy)))))) AS turn,
      greatest(CASE a.road_class WHEN 'arterial' THEN 15 WHEN 'major_local' THEN 18 ELSE CASE WHEN a.sp OR b.sp THEN 12 ELSE 22 END END, CASE b.road_class WHEN 'arterial' THEN 15 WHEN 'major_local' THEN 18 ELSE CASE WHEN a.sp OR b.sp THEN 12 ELSE 22 END END)::DOUBLE AS mt,
      CASE WHEN a.road_class = b.road_class THEN 1.0 ELSE 0.3 END::DOUBLE AS m, greatest(0.0, 1 - abs(a.width_m - b.width_m) / greatest(a.width_m, b.width_m) / 0.35::DOUBLE) AS w, CASE WHEN a.sp AND b.sp THEN 1.5 ELSE 1.0 END::DOUBLE AS bonus FROM fr a JOIN fr b ON a.node = b.node AND a.id <> b.id),
    co AS (SELECT node, a, b, turn, round((1 - turn/mt) * m * w * bonus, 6) AS score FROM sc WHERE turn < mt AND round((1 - turn/mt) * m * w * bonus, 6) > 0), be AS (SELECT node, a, arg_min(b, (-score, b)) AS b FROM co GROUP BY ALL),
    mb AS (SELECT x.node, x.a, x.b FROM be x JOIN be y ON x.node = y.node AND x.a = y.b AND x.b = y.a WHERE x.a < x.b)"""


@query("continuation_score", "seg", f"WITH {_CONT} SELECT node, a, b, score, round(turn, 4) AS turn FROM co")
def continuation_score(spark, d):
    return g.continuation_scores(_lanes(spark, d)).select("node", "a", "b", "score", r4("turn").alias("turn"))


@query("mutual_best", "seg", f"WITH {_CONT} SELECT node, a, b FROM mb")
def mutual_best(spark, d):
    return g.mutual_best(materialize(g.best_continuations(_lanes(spark, d))))


_STROKE = f"RECURSIVE WITH {_CONT}, sy AS (SELECT a, b FROM mb UNION ALL SELECT b, a FROM mb), wk(id, c) AS (SELECT id, id FROM ln UNION SELECT sy.b, wk.c FROM wk JOIN sy ON sy.a = wk.id), st AS (SELECT id, min(c) AS stroke FROM wk GROUP BY 1)"


@query("build_strokes", "seg", f"{_STROKE} SELECT id, stroke FROM st")
def build_strokes(spark, d):
    return g.strokes(_lanes(spark, d))


_RUNS = f"""{_STROKE}, j AS (SELECT * FROM le JOIN st USING (id)), dm AS (SELECT stroke, arg_min(road_class, (-n, road_class)) AS dominant FROM (SELECT stroke, road_class, sum(length_m) AS n FROM j GROUP BY ALL) GROUP BY 1),
    df AS (SELECT stroke, sum(turn) AS deflection FROM mb JOIN co USING (node, a, b) JOIN st ON st.id = mb.a GROUP BY 1),
    rs AS (SELECT stroke, count(*) AS n_edges, sum(length_m) AS length_m, any_value(dominant) AS road_class, degrees(atan2(sum(50 / sqrt(pow(dx*40+m,2)+2500)), sum((dx*40+m) / sqrt(pow(dx*40+m,2)+2500)))) AS bearing, coalesce(any_value(deflection), 0.0) AS deflection, bool_or(sp) OR sum(length_m) >= 500 AS spine,
      concat(CASE WHEN bool_or(cul) THEN 'culdesac ' ELSE '' END, CASE WHEN bool_or(sp) THEN 'local_spine' WHEN sum(length_m) >= 500 THEN 'local_spine_run' ELSE '' END) AS flags FROM j JOIN dm USING (stroke) LEFT JOIN df USING (stroke) GROUP BY stroke)"""


@query("stroke_summary", "seg", f"{_RUNS} SELECT stroke, n_edges, round(length_m, 4) AS length, road_class AS dominant, round(bearing, 4) AS bearing, round(deflection, 4) AS deflection, spine, trim(flags) AS flags FROM rs")
def stroke_summary(spark, d):
    s = g.stroke_summary(_lanes(spark, d))
    return s.select("stroke", "n_edges", r4("length_m").alias("length"), F.col("road_class").alias("dominant"), r4("bearing").alias("bearing"), r4("deflection").alias("deflection"), "spine", F.concat_ws(" ", "flags").alias("flags"))


@query("stroke_metrics", "seg", f"""{_RUNS}, sk AS (SELECT *, unnest(CASE WHEN spine THEN ['all', 'spine', road_class] ELSE ['all', road_class] END) AS scope FROM rs)
    SELECT scope, count(*) AS n, round(quantile_cont(length_m, 0.5), 4) AS p50, round(quantile_cont(length_m, 0.9), 4) AS p90, round(quantile_cont(length_m, 0.99), 4) AS p99, round(avg(n_edges), 4) AS mean_edges, round(quantile_cont(deflection, 0.9), 4) AS deflection_p90, round(avg(CASE WHEN length_m BETWEEN 1000 AND 2000 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS in_band FROM sk GROUP BY scope""")
def stroke_metrics(spark, d):
    m = g.stroke_metrics(materialize(g.stroke_summary(_lanes(spark, d))))
    return m.select("scope", "n", *(r4(c).alias(c) for c in ("p50", "p90", "p99", "mean_edges", "deflection_p90")), F.round("in_band", 6).alias("in_band"))


_OD = """nh AS (SELECT a.id, a.tier, arg_min(b.id, (sqrt(pow(a.x-b.x,2)+pow(a.y-b.y,2)), b.id)) AS higher FROM hubs a JOIN hubs b ON b.tier < a.tier GROUP BY ALL),
    od AS (SELECT a.id AS src, b.id AS dst, (CASE WHEN least(a.tier,b.tier)=1 AND greatest(a.tier,b.tier)=2 THEN 180 WHEN least(a.tier,b.tier)=1 AND greatest(a.tier,b.tier)=3 THEN 90 WHEN a.tier=2 AND b.tier=2 THEN 70 WHEN least(a.tier,b.tier)=2 AND greatest(a.tier,b.tier)=3 THEN 45 WHEN a.tier=3 AND b.tier=3 THEN 20 ELSE 30 END)::DOUBLE AS demand
      FROM hubs a JOIN hubs b ON a.id < b.id UNION ALL SELECT id, higher, 35.0 FROM nh WHERE tier = 3)"""


@query("od_cross", "hubs", "SELECT a.id AS a, b.id AS b FROM hubs a JOIN hubs b ON a.id < b.id")
def od_cross(spark, d):
    h = v.hubs(spark, d)
    return h.select(F.col("id").alias("a")).join(h.select(F.col("id").alias("b")), F.col("a") < F.col("b"))


@query("nearest_where", "hubs", f"WITH {_OD} SELECT id, higher FROM nh")
def nearest_where(spark, d):
    return g.nearest_higher(v.hubs(spark, d)).select("id", "higher")


@query("od_demand", "hubs", f"WITH {_OD} SELECT src, dst, demand FROM od")
def od_demand(spark, d):
    return g.od_demand(v.hubs(spark, d))


_FLOW = f"""{_SP}, {_PREV}, {_OD}, dd AS (SELECT src, dst, sum(demand) AS demand FROM od GROUP BY ALL),
    tr(n, src, dst, demand, node) AS (SELECT 0, src, dst, demand, dst FROM dd UNION ALL SELECT n + 1, tr.src, tr.dst, tr.demand, pv.prev FROM tr JOIN pv ON pv.src = tr.src AND pv.node = tr.node WHERE n < 30),
    us AS (SELECT least(tr.node, pv.prev) AS u, greatest(tr.node, pv.prev) AS v, sum(demand) AS flow FROM tr JOIN pv ON pv.src = tr.src AND pv.node = tr.node GROUP BY ALL),
    fl AS (SELECT e.id, e.u, e.v, e.road_class, e.length_m, coalesce(flow, 0) AS flow FROM edges e LEFT JOIN us USING (u, v))"""


@query("assign_flows", "edges hubs", f"{_FLOW} SELECT id, u, v, round(flow, 4) AS flow FROM fl")
def assign_flows(spark, d):
    return g.assign_flows(v.edges(spark, d), g.od_demand(v.hubs(spark, d))).withColumn("flow", r4("flow"))


@query("congestion", "edges hubs", f"{_FLOW} SELECT id, round(flow / (CASE WHEN road_class = 'arterial' THEN 1200 ELSE 420 END * least(1.8, greatest(0.6, length_m / 140)))::DOUBLE, 4) AS ratio FROM fl")
def congestion(spark, d):
    e = v.edges(spark, d)
    t = g.assign_flows(e, g.od_demand(v.hubs(spark, d))).join(e.select("id", "road_class", "length_m"), "id")
    return t.select("id", r4(F.col("flow") / g.capacity(F.col("road_class"), F.col("length_m"))).alias("ratio"))


@query("hub_features", "edges hubs sites", f"""WITH {_ADJ}, dg AS (SELECT node, count(*) AS n FROM adj GROUP BY 1), nr AS (SELECT h.id, min(sqrt(pow(h.x-s.x,2)+pow(h.y-s.y,2))) AS dist FROM hubs h, sites s GROUP BY 1)
    SELECT h.id, h.tier, dist < 180 AS near_river, coalesce(dg.n, 0) AS degree, round(coalesce(dg.n, 0) / (max(coalesce(dg.n, 0)) OVER ())::DOUBLE, 4) AS centrality FROM hubs h LEFT JOIN dg ON dg.node = h.id JOIN nr ON nr.id = h.id""")
def hub_features(spark, d):
    from meridion.operators.spatial import nearest_distance

    h = v.hubs(spark, d)
    t = h.join(g.degrees(v.edges(spark, d)), h["id"] == F.col("node"), "left").select(h["id"], "tier", F.coalesce("degree", F.lit(0)).alias("degree"))
    t = t.join(nearest_distance(h.select("id", "x", "y"), v.sites(spark, d).select("id", "x", "y"), 500.0, v.EXTENT), "id")
    top = t.agg(F.max("degree").alias("top"))
    return t.join(F.broadcast(top)).select("id", "tier", (F.col("dist") < 180).alias("near_river"), "degree", r4(F.col("degree") / F.col("top")).alias("centrality"))


@query("lineage", "edges", "SELECT coalesce(CASE WHEN id % 3 > 0 THEN 'c' || (u % 6)::VARCHAR END, 'local-auto-' || id::VARCHAR) AS continuity, count(*) AS n_edges, round(sum(length_m), 4) AS length FROM edges GROUP BY 1")
def lineage(spark, d):
    e = v.edges(spark, d).withColumn("continuity_id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), (F.col("u") % 6).cast("string"))))
    return g.lineage(e).withColumn("length", r4("length"))


@query("orphan_check", "edges", "SELECT id FROM edges WHERE (id % 40) NOT IN (SELECT u FROM edges)")
def orphan_check(spark, d):
    e = v.edges(spark, d).withColumn("continuity_id", F.col("u")).withColumn("parent_continuity_id", F.col("id") % 40)
    return g.orphans(e).select("id")


@query("used_nodes", "edges hubs", "SELECT id FROM hubs WHERE id IN (SELECT u FROM edges WHERE road_class = 'arterial' UNION SELECT v FROM edges WHERE road_class = 'arterial')")
def used_nodes(spark, d):
    ends = v.edges(spark, d).where("road_class = 'arterial'").select(F.explode(F.array("u", "v")).alias("id"))
    return v.hubs(spark, d).join(ends, "id", "left_semi").select("id")


@query("edge_endpoints", "edges hubs", "SELECT e.id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM edges e LEFT JOIN hubs a ON a.id = u LEFT JOIN hubs b ON b.id = v")
def edge_endpoints(spark, d):
    n = v.hubs(spark, d)
    e = v.edges(spark, d).join(n.select(F.col("id").alias("u"), F.col("x").alias("x0"), F.col("y").alias("y0")), "u", "left")
    return e.join(n.select(F.col("id").alias("v"), F.col("x").alias("x1"), F.col("y").alias("y1")), "v", "left").select("id", "x0", "y0", "x1", "y1")


@query("provider_names", "hubs", "SELECT id, CASE WHEN tier = 1 THEN 'Capital' WHEN tier = 2 THEN 'Town' ELSE 'Village' END || ' ' || id::VARCHAR AS name FROM hubs")
def provider_names(spark, d):
    from meridion.functions.providers import names_by

    return v.hubs(spark, d).select("id", names_by("tiered", "id", "tier").alias("name"))


@query("snap_network", "edges hubs", """WITH b AS (SELECT id, min(id) OVER (PARTITION BY floor(x/3000), floor(y/3000)) AS alias FROM hubs), t AS (SELECT e.*, a.alias AS u2, c.alias AS v2 FROM edges e JOIN b a ON a.id = e.u JOIN b c ON c.id = e.v WHERE a.alias <> c.alias)
    SELECT least(u2, v2) AS u, greatest(u2, v2) AS v, road_class, min(id) AS id, count(*) AS merged FROM t GROUP BY ALL""")
def snap_network(spark, d):
    return stats.snap_network(v.hubs(spark, d), v.edges(spark, d), 3000.0).select("u", "v", "road_class", "id", "merged")


@query("hub_hulls", "")
def hub_hulls(spark, d):
    t = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id")).join(v.pts(spark, d), "id")
    return stats.convex_hulls(t, "g").select("g", F.size("ring").alias("corners"), r4("area").alias("area"))


_TRADE = _ADJ.replace("FROM edges", "FROM trade")


@query("trade_degree", "trade", f"WITH {_TRADE} SELECT node, count(*) AS degree FROM adj GROUP BY node")
def trade_degree(spark, d):
    return g.degrees(v.trade(spark, d))


@query("trade_components", "trade", f"{_CC.replace('FROM edges', 'FROM trade')} SELECT node, component FROM comp")
def trade_components(spark, d):
    return cc(v.trade(spark, d))


@query("trade_paths", "trade trade_hubs", f"""RECURSIVE WITH {_TRADE}, p(n, src, node, dist) AS (SELECT 0, node, node, 0.0::DOUBLE FROM trade_hubs UNION ALL
    SELECT n + 1, src, node, min(dist) FROM (SELECT p.n, p.src, adj.other AS node, p.dist + adj.weight AS dist FROM p JOIN adj USING (node) UNION ALL SELECT n, src, node, dist FROM p) WHERE n < 40 GROUP BY n, src, node)
    SELECT src, node, round(dist, 4) AS dist FROM p WHERE n = 40""")
def trade_paths(spark, d):
    return g.shortest_paths(v.trade(spark, d), v.trade_hubs(spark, d)).select("src", "node", r4("dist").alias("dist"))


@query("trade_spanning_tree")
def trade_spanning_tree(spark, d):
    return g.minimum_spanning_tree(v.trade(spark, d)).select("id", "u", "v", "weight")
