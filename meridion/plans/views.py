"""Layers derived from the given tables by integer arithmetic, so that every engine builds the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import table

CELL = 500
#: The study area is [0, EXTENT] squared.
EXTENT = 10240.0
# Fixed value: rows whose repeats are looked for in one task.
TASK_ROWS = 1_000_000


def _hashed(key: str) -> tuple:
    return ((F.col(key) * 7919) % 10007).cast("double").alias("x"), ((F.col(key) * 104729) % 10009).cast("double").alias("y")


def pts(spark: SparkSession, d: str) -> DataFrame:
    """points: id, x, y, v."""
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), *_hashed("c_custkey"), F.col("c_acctbal").alias("v"))


def cells(spark: SparkSession, d: str) -> DataFrame:
    """raster: ix, iy, h."""
    from meridion.operators.raster import bin_points

    return bin_points(pts(spark, d), CELL).select("ix", "iy", "h")


def surface(spark: SparkSession, d: str) -> DataFrame:
    """dense raster, four cells an order, as wide as high: ix, iy, h, open; grows with the tables."""
    o = table(spark, d, "orders").select("o_orderkey")
    width = o.agg(F.floor(F.sqrt(F.count("*") * 4)).cast("long").alias("w"))
    t = o.select(F.col("o_orderkey"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j")).select("o_orderkey", (F.col("o_orderkey") * 4 + F.col("j")).alias("i"), "j")
    t = t.join(F.broadcast(width), F.col("i") < F.col("w") * F.col("w")).select("o_orderkey", "j", (F.col("i") % F.col("w")).alias("ix"), F.expr("i div w").alias("iy"))
    ridge = lambda c, n: F.abs(c % (2 * n) - n)
    h = 3 * ridge(F.col("ix") * 2 + F.col("iy"), 97) + 2 * ridge(F.abs(F.col("ix") - F.col("iy") * 3), 61) + (F.col("o_orderkey") * 7919) % 13
    return t.select("ix", "iy", h.cast("double").alias("h"), ((F.col("o_orderkey") * 31 + F.col("j") * 17) % 97 >= 12).alias("open"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    q = (F.pmod(F.col("s_acctbal"), F.lit(100.0)) / 100).alias("quality")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), *_hashed("s_suppkey"), (F.col("s_suppkey") % 4).alias("kind"), F.round(q, 4).alias("quality"), F.lit(700.0).alias("radius"))


def hubs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    t = table(spark, d, "nation").select(k.alias("id"))
    return t.select("id", *_hashed("id"), F.when(F.col("id") == 0, 1).when(F.col("id") <= 4, 2).otherwise(3).cast("long").alias("tier"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """undirected network between nations: id, u, v, road_class, weight, length_m, flags."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("a"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("b"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey")
    t = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == c["c_custkey"]).join(s, F.col("l_suppkey") == s["s_suppkey"]).where("a <> b")
    g = t.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("n"))
    kind = (F.col("u") + F.col("v")) % 3
    return g.select(
        (F.col("u") * 100 + F.col("v")).alias("id"), "u", "v",
        F.when(kind == 0, "arterial").when(kind == 1, "major_local").otherwise("minor_local").alias("road_class"),
        (1 + (F.col("u") * 31 + F.col("v") * 17) % 97).cast("double").alias("weight"),
        (20 + (F.col("u") * 13 + F.col("v") * 29) % 400).cast("double").alias("length_m"),
        F.when((F.col("u") * F.col("v")) % 4 == 0, F.array(F.lit("culdesac"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


def trade(spark: SparkSession, d: str) -> DataFrame:
    """undirected network of suppliers (even nodes) and the parts that they sold (odd nodes): id, u, v, weight; grows with the tables."""
    t = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("long").alias("s"), F.col("l_partkey").cast("long").alias("p"))
    # Dealt before repeats are looked for, to as many tasks as the rows need: a task's table of them does not grow with a file.
    tasks = t.count() // TASK_ROWS + 1
    t = (t.repartition(tasks, "s", "p") if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else t.repartition("s", "p")).distinct()
    return t.select((F.col("s") * 10000000000 + F.col("p")).alias("id"), (F.col("s") * 2).alias("u"), (F.col("p") * 2 + 1).alias("v"), (1 + (F.col("s") * 31 + F.col("p") * 17) % 97).cast("double").alias("weight"))


def trade_hubs(spark: SparkSession, d: str) -> DataFrame:
    """node: each nation's supplier of the highest balance (ties: the larger key)."""
    t = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.max(F.struct("s_acctbal", "s_suppkey")).alias("m"))
    return t.select((F.col("m.s_suppkey").cast("long") * 2).alias("node"))


def seg(spark: SparkSession, d: str) -> DataFrame:
    """segments: id, x0, y0, x1, y1."""
    k = F.col("o_orderkey")
    t = table(spark, d, "orders").select(k.alias("id"), *_hashed("o_orderkey"))
    return t.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + (F.col("id") * 13) % 301 - 150).alias("x1"), (F.col("y") + (F.col("id") * 17) % 307 - 153).alias("y1"))


def verts(spark: SparkSession, d: str) -> DataFrame:
    """polyline vertices: line_id, seq (from 0), x, y."""
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("line_id"), "ts", "event_id")
    w = Window.partitionBy("line_id").orderBy("ts", "event_id")
    t = e.withColumn("seq", (F.row_number().over(w) - 1).cast("long")).withColumn("k", F.col("event_id"))
    x, y = ((F.col("k") * 37) % 1009).cast("double"), ((F.col("k") * 53) % 1013).cast("double")
    return t.select("line_id", "seq", x.alias("x"), y.alias("y"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    """squares: zone_id, cx, cy, half, area."""
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_size", F.col("p_brand").alias("zone_class"))
    t = t.select("id", *_hashed("id"), (F.col("p_size") * 10).cast("double").alias("half"), "zone_class")
    return t.select(F.col("id").alias("zone_id"), F.col("x").alias("cx"), F.col("y").alias("cy"), "half", (4 * F.col("half") * F.col("half")).alias("area"), "zone_class")


def runlog(spark: SparkSession, d: str) -> DataFrame:
    """run-log records: run_id, seq (from 1), ts, event_id, kind, level, duration_ms, props."""
    from meridion.operators.events import assign_seq

    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("kind"), F.col("value").alias("duration_ms"), "props")
    e = e.withColumn("level", F.when(F.col("kind") == "error", "ERROR").when(F.col("kind") == "click", "WARNING").otherwise("INFO"))
    return assign_seq(e, ["run_id"], ["ts", "event_id"])


#: The same layers in SQL; a text between braces names the layers that one needs.
SQL = {
    "pts": "SELECT c_custkey AS id, ((c_custkey * 7919) % 10007)::DOUBLE AS x, ((c_custkey * 104729) % 10009)::DOUBLE AS y, c_acctbal AS v FROM customer",
    "cells": "SELECT floor(x / 500)::BIGINT AS ix, floor(y / 500)::BIGINT AS iy, round(avg(v), 4) AS h FROM pts GROUP BY ALL",
    "surface": """SELECT ix, iy, (3 * abs((ix * 2 + iy) % 194 - 97) + 2 * abs(abs(ix - iy * 3) % 122 - 61) + (k * 7919) % 13)::DOUBLE AS h, (k * 31 + j * 17) % 97 >= 12 AS open
        FROM (SELECT k, j, (k * 4 + j) % w AS ix, (k * 4 + j) // w AS iy FROM (SELECT o_orderkey AS k, unnest(range(4)) AS j FROM orders), (SELECT floor(sqrt(count(*) * 4))::BIGINT AS w FROM orders) WHERE k * 4 + j < w * w)""",
    "sites": "SELECT s_suppkey AS id, ((s_suppkey * 7919) % 10007)::DOUBLE AS x, ((s_suppkey * 104729) % 10009)::DOUBLE AS y, s_suppkey % 4 AS kind, round(((s_acctbal % 100) + 100) % 100 / 100, 4) AS quality, 700.0::DOUBLE AS radius FROM supplier",
    "hubs": "SELECT n_nationkey::BIGINT AS id, ((n_nationkey::BIGINT * 7919) % 10007)::DOUBLE AS x, ((n_nationkey::BIGINT * 104729) % 10009)::DOUBLE AS y, (CASE WHEN n_nationkey = 0 THEN 1 WHEN n_nationkey <= 4 THEN 2 ELSE 3 END)::BIGINT AS tier FROM nation",
    "edges": """SELECT u * 100 + v AS id, u, v, CASE (u + v) % 3 WHEN 0 THEN 'arterial' WHEN 1 THEN 'major_local' ELSE 'minor_local' END AS road_class,
        (1 + (u * 31 + v * 17) % 97)::DOUBLE AS weight, (20 + (u * 13 + v * 29) % 400)::DOUBLE AS length_m, CASE WHEN (u * v) % 4 = 0 THEN ['culdesac'] ELSE []::VARCHAR[] END AS flags
        FROM (SELECT least(c_nationkey, s_nationkey)::BIGINT AS u, greatest(c_nationkey, s_nationkey)::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY ALL)""",
    "trade": "SELECT s * 10000000000 + p AS id, s * 2 AS u, p * 2 + 1 AS v, (1 + (s * 31 + p * 17) % 97)::DOUBLE AS weight FROM (SELECT DISTINCT l_suppkey::BIGINT AS s, l_partkey::BIGINT AS p FROM lineitem)",
    "trade_hubs": "SELECT arg_max(s_suppkey, (s_acctbal, s_suppkey))::BIGINT * 2 AS node FROM supplier GROUP BY s_nationkey",
    "seg": "SELECT id, x AS x0, y AS y0, x + (id * 13) % 301 - 150 AS x1, y + (id * 17) % 307 - 153 AS y1 FROM (SELECT o_orderkey AS id, ((o_orderkey * 7919) % 10007)::DOUBLE AS x, ((o_orderkey * 104729) % 10009)::DOUBLE AS y FROM orders)",
    "verts": "SELECT line_id, seq, ((k * 37) % 1009)::DOUBLE AS x, ((k * 53) % 1013)::DOUBLE AS y FROM (SELECT user_id AS line_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, event_id AS k FROM events)",
    "zones": "SELECT p_partkey AS zone_id, ((p_partkey * 7919) % 10007)::DOUBLE AS cx, ((p_partkey * 104729) % 10009)::DOUBLE AS cy, (p_size * 10)::DOUBLE AS half, 4.0 * (p_size * 10)::DOUBLE * (p_size * 10)::DOUBLE AS area, p_brand AS zone_class FROM part",
    "runlog": "SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ts, event_id, event_type AS kind, value AS duration_ms, props, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level FROM events",
}
NEEDS = {"cells": ("pts",)}


def with_views(names: str, sql: str) -> str:
    """``sql`` behind the layers that it names (separated by spaces); RECURSIVE where it asks for it."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in (*NEEDS.get(n, ()), n) if x not in wanted]
    recursive = "RECURSIVE " if sql.lstrip().startswith("RECURSIVE ") else ""
    body = sql.lstrip().removeprefix("RECURSIVE ")
    more = body.lstrip().startswith("WITH ")
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    if not head:
        return f"WITH {recursive}{body.lstrip()[5:]}" if more else body
    return f"WITH {recursive}{head}{', ' + body.lstrip()[5:] if more else ' ' + body}"
