"""Counts, distributions and notes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.operators import polyline as p
from meridion.operators import stats
from meridion.plans import views as v
from meridion.plans.registry import query
from meridion.session import table


def r4(c):
    return F.round(c, 4)


@query("count_by_class", "edges", "SELECT string_agg(road_class || '=' || n::VARCHAR, ',' ORDER BY road_class) AS counts FROM (SELECT road_class, count(*) AS n FROM edges GROUP BY 1)")
def count_by_class(spark, d):
    m = stats.count_map(v.edges(spark, d).withColumn("k", F.lit(1)), ["k"], "road_class")
    return m.select(F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("percentiles", "", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 3) AS p50, round(quantile_cont(l_extendedprice, 0.9), 3) AS p90, round(quantile_cont(l_extendedprice, 0.99), 3) AS p99 FROM lineitem GROUP BY 1")
def percentiles(spark, d):
    t = stats.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return t.select("l_returnflag", *(F.round(c, 3).alias(c) for c in ("p50", "p90", "p99")))


@query("nearest_rank_quantile", "", "SELECT l_shipmode_ AS flag, any_value(q) AS q FROM (SELECT l_returnflag AS l_shipmode_, l_quantity AS q, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WINDOW w AS (PARTITION BY l_returnflag ORDER BY l_quantity)) WHERE k = round_even((n - 1) * 0.85::DOUBLE, 0) GROUP BY 1")
def nearest_rank_quantile(spark, d):
    return stats.nearest_rank(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", 0.85).select(F.col("l_returnflag").alias("flag"), "q")


@query("band_rates", "", "SELECT l_linestatus, round(avg((l_quantity < 10)::INT), 6)::DOUBLE AS short, round(avg((l_quantity BETWEEN 10 AND 40)::INT), 6)::DOUBLE AS in_band, round(avg((l_quantity > 40)::INT), 6)::DOUBLE AS long FROM lineitem GROUP BY 1")
def band_rates(spark, d):
    return stats.band_rates(table(spark, d, "lineitem"), ["l_linestatus"], "l_quantity", 10, 40)


@query("dominant_class", "", "SELECT n AS nation, arg_min(seg, (-c, seg)) AS dominant, max(c) AS weight FROM (SELECT c_nationkey AS n, c_mktsegment AS seg, count(*) AS c FROM customer GROUP BY ALL) GROUP BY n")
def dominant_class(spark, d):
    return stats.dominant(table(spark, d, "customer"), ["c_nationkey"], "c_mktsegment").select(F.col("c_nationkey").alias("nation"), "dominant", "weight")


@query("median_area", "zones", "SELECT zone_class, round(quantile_cont(area, 0.5), 4) AS median FROM zones WHERE area > 0 GROUP BY 1")
def median_area(spark, d):
    return v.zones(spark, d).where("area > 0").groupBy("zone_class").agg(r4(F.percentile("area", 0.5)).alias("median"))


@query("circular_mean_bearing", "verts", """WITH s AS (SELECT line_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq)), b AS (SELECT line_id, atan2(y1-y0, x1-x0) AS a FROM s WHERE x1 IS NOT NULL AND sqrt(pow(x1-x0,2)+pow(y1-y0,2)) > 1e-6),
    m AS (SELECT line_id, degrees(atan2(sum(sin(a)), sum(cos(a)))) AS m FROM b GROUP BY 1) SELECT line_id, round(CASE WHEN m < 0 THEN m + 360 ELSE m END, 2) AS mean FROM m""")
def circular_mean_bearing(spark, d):
    from meridion.functions.geometry import bearing

    s = p.segmentize(v.verts(spark, d)).withColumn("b", bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    return stats.circular_mean(s, ["line_id"], "b").select("line_id", F.round("mean", 2).alias("mean"))


@query("area_share", "cells verts", """WITH s AS (SELECT line_id, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    l AS (SELECT line_id, sum(sqrt(pow(x1-x0,2)+pow(y1-y0,2))) AS length, count(*) AS flow FROM s WHERE x1 IS NOT NULL AND sqrt(pow(x1-x0,2)+pow(y1-y0,2)) > 1e-6 GROUP BY 1)
    SELECT round(count(*) FILTER (WHERE h > 4500) / count(*)::DOUBLE, 6) AS share, count(*) FILTER (WHERE h > 4500) * 250000.0::DOUBLE AS area, (SELECT round(arg_max(length, (flow, length)), 3) FROM l) AS main_length FROM cells""")
def area_share(spark, d):
    """Covered share and area, and the length of the line of most flow (ties: the longer)."""
    high = F.count_if(F.col("h") > 4500)
    lines = p.segmentize(v.verts(spark, d)).groupBy("line_id").agg(F.sum("len").alias("length"), F.count("*").alias("flow"))
    main = lines.agg(F.round(F.max(F.struct("flow", "length"))["length"], 3).alias("main_length"))
    return v.cells(spark, d).agg(F.round(high / F.count("*"), 6).alias("share"), (high * 250000.0).alias("area")).join(F.broadcast(main))


@query("stage_metrics", "edges cells", "SELECT 'traffic' AS stage, count(*) AS n, round(max(weight), 4) AS top, round(avg(weight), 4) AS mean FROM edges UNION ALL SELECT 'terrain', count(*), round(max(h), 4), round(avg(h), 4) FROM cells")
def stage_metrics(spark, d):
    one = lambda t, name, c: t.agg(F.count("*").alias("n"), r4(F.max(c)).alias("top"), r4(F.avg(c)).alias("mean")).select(F.lit(name).alias("stage"), "n", "top", "mean")
    return one(v.edges(spark, d), "traffic", "weight").unionByName(one(v.cells(spark, d), "terrain", "h"))


@query("notes_rollup", "edges", "SELECT road_class, 'edges:' || count(*)::VARCHAR || CASE WHEN max(weight) > 90 THEN '; heavy:' || max(weight)::BIGINT::VARCHAR ELSE '' END AS notes FROM edges GROUP BY 1")
def notes_rollup(spark, d):
    t = v.edges(spark, d).groupBy("road_class").agg(F.count("*").alias("n"), F.max("weight").cast("long").alias("w"))
    return stats.notes(t, [("edges:%s", F.col("n"), F.lit(True)), ("heavy:%s", F.col("w"), F.col("w") > 90)]).select("road_class", F.array_join("notes", "; ").alias("notes"))


@query("priority_select", "edges", """SELECT id, priority FROM (SELECT id, (CASE WHEN u % 3 = 0 THEN 3000 ELSE 0 END + CASE WHEN v % 4 = 0 THEN 2000 ELSE 0 END + least(1000, length_m) - CASE WHEN id % 2 = 0 THEN 250 ELSE 0 END)::DOUBLE AS priority FROM edges WHERE length_m >= 60 OR u % 3 = 0 OR v % 4 = 0) ORDER BY priority DESC, id LIMIT 20""")
def priority_select(spark, d):
    t = v.edges(spark, d).withColumns({"connector": F.col("u") % 3 == 0, "spine": F.col("v") % 4 == 0, "grid": F.col("id") % 2 == 0})
    return stats.priority_select(t, 20, 60.0, True).select("id", "priority")


@query("sort_by_area", "zones", "SELECT zone_id, row_number() OVER (ORDER BY area DESC, zone_id) AS place FROM zones")
def sort_by_area(spark, d):
    return stats.numbered(v.zones(spark, d).select("zone_id", "area"), [F.desc("area"), F.asc("zone_id")], "place").select("zone_id", "place")


@query("recombine", "edges", "SELECT id, CASE WHEN road_class = 'arterial' THEN weight * 2 ELSE weight END AS weight FROM edges")
def recombine(spark, d):
    e = v.edges(spark, d).select("id", "road_class", "weight")
    return e.where("road_class = 'arterial'").withColumn("weight", F.col("weight") * 2).unionByName(e.where("road_class <> 'arterial'")).select("id", "weight")


@query("flag_union", "edges", "SELECT u, coalesce(array_to_string(list_sort(list_distinct(flatten(list(flags)))), ','), '') AS flags FROM edges GROUP BY u")
def flag_union(spark, d):
    return v.edges(spark, d).groupBy("u").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))), ",").alias("flags"))
