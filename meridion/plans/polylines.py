"""Windows over the event polylines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from meridion.operators import polyline as p
from meridion.operators import stats
from meridion.plans import views as v
from meridion.plans.registry import query


def r4(c):
    return F.round(c, 4)


_SEG = """s AS (SELECT line_id, seq, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    g AS (SELECT *, sqrt(pow(x1-x0,2)+pow(y1-y0,2)) AS len FROM s WHERE x1 IS NOT NULL AND sqrt(pow(x1-x0,2)+pow(y1-y0,2)) > 1e-6)"""
_CUM = """st AS (SELECT *, coalesce(sqrt(pow(x-lag(x) OVER w,2)+pow(y-lag(y) OVER w,2)), 0) AS step FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    cu AS (SELECT line_id, seq, x, y, sum(step) OVER (PARTITION BY line_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS cum FROM st),
    sp AS (SELECT *, max(cum) OVER (PARTITION BY line_id) AS total FROM (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1, lead(cum) OVER w AS cum1 FROM cu WINDOW w AS (PARTITION BY line_id ORDER BY seq)))"""


@query("segmentize", "verts", f"WITH {_SEG} SELECT line_id, seq, x0, y0, x1, y1, round(len, 4) AS len FROM g")
def segmentize(spark, d):
    return p.segmentize(v.verts(spark, d)).withColumn("len", r4("len"))


@query("polyline_length", "verts", f"""WITH {_SEG}, e AS (SELECT line_id, arg_min(x, seq) AS ax, arg_min(y, seq) AS ay, arg_max(x, seq) AS bx, arg_max(y, seq) AS by_ FROM verts GROUP BY 1),
    l AS (SELECT line_id, sum(len) AS length FROM g GROUP BY 1) SELECT line_id, round(coalesce(length, 0), 3) AS length, round(sqrt(pow(bx-ax,2)+pow(by_-ay,2)), 4) AS span FROM e LEFT JOIN l USING (line_id)""")
def polyline_length(spark, d):
    return p.measures(v.verts(spark, d)).select("line_id", F.round("length", 3).alias("length"), r4("span").alias("span"))


@query("interpolate_along", "verts", f"""WITH {_CUM}, h AS (SELECT *, total/3 AS d, row_number() OVER (PARTITION BY line_id ORDER BY seq) AS n FROM sp WHERE cum1 > cum AND cum <= total/3 AND total/3 <= cum1)
    SELECT line_id, round(x + (d-cum)/(cum1-cum)*(x1-x), 3) AS px, round(y + (d-cum)/(cum1-cum)*(y1-y), 3) AS py FROM h WHERE n = 1""")
def interpolate_along(spark, d):
    return p.interpolate(v.verts(spark, d), F.col("total") / 3).select("line_id", F.round("px", 3).alias("px"), F.round("py", 3).alias("py"))


_W = "coalesce(least(1.0, greatest(0.0, ((500-x)*(x1-x)+(500-y)*(y1-y)) / nullif((x1-x)*(x1-x)+(y1-y)*(y1-y), 0))), 0)"


@query("locate_along", "verts", f"""WITH {_CUM}, q AS (SELECT line_id, seq, cum + {_W}*(cum1-cum) AS along, sqrt(pow(500-(x+{_W}*(x1-x)),2)+pow(500-(y+{_W}*(y1-y)),2)) AS dist FROM sp WHERE cum1 > cum)
    SELECT line_id, round(along, 3) AS along, round(dist, 4) AS dist, seq FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY dist, seq) AS n FROM q) WHERE n = 1""")
def locate_along(spark, d):
    return p.locate(v.verts(spark, d), 500.0, 500.0).select("line_id", F.round("along", 3).alias("along"), r4("dist").alias("dist"), "seq")


@query("cumulative_length", "verts", f"WITH {_CUM} SELECT line_id, seq, round(cum, 3) AS cum FROM cu")
def cumulative_length(spark, d):
    return p.cumulative(v.verts(spark, d)).select("line_id", "seq", F.round("cum", 3).alias("cum"))


@query("moving_average_3", "verts", "SELECT line_id, seq, round(avg(x) OVER w, 4) AS x, round(avg(y) OVER w, 4) AS y FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)")
def moving_average_3(spark, d):
    return p.moving_average(v.verts(spark, d)).select("line_id", "seq", r4("x").alias("x"), r4("y").alias("y"))


@query("clamp_turn", "verts", f"""WITH {_SEG}, l AS (SELECT line_id, seq, x1-x0 AS dx, y1-y0 AS dy, lag(x1-x0) OVER w AS px, lag(y1-y0) OVER w AS py FROM g WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    a AS (SELECT line_id, seq, degrees(acos(least(1.0, greatest(-1.0, (px*dx+py*dy)/(sqrt(px*px+py*py)*sqrt(dx*dx+dy*dy)))))) AS turn FROM l WHERE px IS NOT NULL)
    SELECT line_id, seq, round(turn, 3) AS turn, round(least(turn, 35.0), 3) AS clamped FROM a""")
def clamp_turn(spark, d):
    return p.turns(v.verts(spark, d), 35.0).select("line_id", "seq", F.round("turn", 3).alias("turn"), F.round("clamped", 3).alias("clamped"))


@query("resample", "verts", f"""WITH {_CUM}, k AS (SELECT *, unnest(range(ceil(cum/150)::BIGINT, ceil(cum1/150)::BIGINT)) AS k FROM sp WHERE cum1 > cum)
    SELECT line_id, k, round(x + (k*150-cum)/(cum1-cum)*(x1-x), 2) AS x, round(y + (k*150-cum)/(cum1-cum)*(y1-y), 2) AS y FROM k""")
def resample(spark, d):
    return p.resample(v.verts(spark, d), 150.0).select("line_id", "k", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("chunk_by_length", "verts", f"""WITH {_CUM}, t AS (SELECT line_id, max(cum) AS total, greatest(1, ceil(max(cum)/600))::BIGINT AS n FROM cu GROUP BY 1),
    m AS (SELECT *, n > 1 AND total - (n-1)*600 < 8 AS dropped, n > 1 AND total - (n-1)*600 >= 8 AND total - (n-1)*600 < 14 AS merged FROM t),
    g AS (SELECT sp.*, n, dropped, merged FROM sp JOIN m USING (line_id) WHERE cum1 > cum),
    c AS (SELECT *, unnest(range((floor(cum/600) + 1)::BIGINT, least(floor(cum1/600)::BIGINT, n-1) + 1)) AS k FROM g),
    p AS (SELECT line_id, k*600.0::DOUBLE AS pos, x + (k*600.0::DOUBLE-cum)/(cum1-cum)*(x1-x) AS x, y + (k*600.0::DOUBLE-cum)/(cum1-cum)*(y1-y) AS y, unnest([k-1, k]) AS k, n, dropped, merged FROM c
      UNION ALL SELECT line_id, cum, x, y, least(floor(cum/600)::BIGINT, n-1), n, dropped, merged FROM g WHERE NOT (cum % 600 = 0 AND cum > 0)
      UNION ALL SELECT line_id, cum1, x1, y1, n-1, n, dropped, merged FROM g WHERE cum1 = total),
    d AS (SELECT DISTINCT line_id, pos, first_value(x) OVER w AS x, first_value(y) OVER w AS y, CASE WHEN merged AND k = n-1 THEN k-1 ELSE k END AS chunk FROM p WHERE NOT (dropped AND k = n-1) WINDOW w AS (PARTITION BY line_id, pos, CASE WHEN merged AND k = n-1 THEN k-1 ELSE k END))
    SELECT line_id, chunk, row_number() OVER (PARTITION BY line_id, chunk ORDER BY pos) - 1 AS seq, round(x, 2) AS x, round(y, 2) AS y FROM d""")
def chunk_by_length(spark, d):
    return p.chunks(v.verts(spark, d), 600.0).select("line_id", "chunk", "seq", F.round("x", 2).alias("x"), F.round("y", 2).alias("y"))


@query("chaikin_smooth", "verts", """WITH l AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, row_number() OVER w AS n FROM verts WINDOW w AS (PARTITION BY line_id ORDER BY seq)),
    q AS (SELECT line_id, n, 0 AS k, x, y FROM l WHERE n = 1 OR nx IS NULL UNION ALL SELECT line_id, n, 1, x*0.75+nx*0.25::DOUBLE, y*0.75+ny*0.25::DOUBLE FROM l WHERE nx IS NOT NULL UNION ALL SELECT line_id, n, 2, x*0.25+nx*0.75::DOUBLE, y*0.25+ny*0.75::DOUBLE FROM l WHERE nx IS NOT NULL)
    SELECT line_id, row_number() OVER (PARTITION BY line_id ORDER BY n, k) - 1 AS seq, round(x, 4) AS x, round(y, 4) AS y FROM q""")
def chaikin_smooth(spark, d):
    return p.chaikin(v.verts(spark, d)).select("line_id", "seq", r4("x").alias("x"), r4("y").alias("y"))


@query("drop_repeats", "verts", """WITH r AS (SELECT line_id, seq, floor(x/400)*400 AS x, floor(y/400)*400 AS y FROM verts), l AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM r WINDOW w AS (PARTITION BY line_id ORDER BY seq))
    SELECT line_id, seq, x, y FROM l WHERE NOT (px IS NOT NULL AND px = x AND py = y)""")
def drop_repeats(spark, d):
    t = v.verts(spark, d).select("line_id", "seq", *((F.floor(F.col(c) / 400) * 400).cast("double").alias(c) for c in ("x", "y")))
    return p.drop_repeats(t)


@query("simplify_rdp", "verts")
def simplify_rdp(spark, d):
    return p.simplify(v.verts(spark, d), 250.0)


@query("transition_count", "verts", """WITH l AS (SELECT line_id, x < 505 AS wet, lag(x < 505) OVER (PARTITION BY line_id ORDER BY seq) AS was FROM verts)
    SELECT line_id, sum(CASE WHEN was IS NOT NULL AND was <> wet THEN 1 ELSE 0 END)::BIGINT AS changes, (sum(CASE WHEN was IS NOT NULL AND was <> wet THEN 1 ELSE 0 END) // 2)::BIGINT AS crossings FROM l GROUP BY 1""")
def transition_count(spark, d):
    return p.transitions(v.verts(spark, d).withColumn("wet", F.col("x") < 505), "wet")


@query("first_per_bucket", "pts", """WITH b AS (SELECT id, floor(x/50)::BIGINT AS bx, floor(y/50)::BIGINT AS by_ FROM pts) SELECT id, min(id) OVER (PARTITION BY bx, by_) AS alias FROM b""")
def first_per_bucket(spark, d):
    return stats.first_per_bucket(v.pts(spark, d), 50.0).select("id", "alias")


@query("assign_tiers", "pts", """WITH k AS (SELECT id, row_number() OVER (ORDER BY v DESC, id) AS n FROM pts) SELECT id, (CASE WHEN n <= 1 THEN 1 WHEN n <= 5 THEN 2 ELSE 3 END)::BIGINT AS tier FROM k WHERE n <= 25""")
def assign_tiers(spark, d):
    return stats.assign_tiers(v.pts(spark, d), F.col("v"), (1, 4, 20)).select("id", F.col("tier").cast("long").alias("tier"))


@query("segment_order", "edges")
def segment_order(spark, d):
    from meridion.operators.graph import segment_order as op

    return op(v.edges(spark, d).withColumn("continuity_id", F.concat(F.lit("c"), (F.col("u") % 6).cast("string"))))


@query("phase_progress", "runlog", """WITH k AS (SELECT run_id, seq, kind, duration_ms, (CASE kind WHEN 'view' THEN 0.0 WHEN 'click' THEN 0.3 ELSE 0.6 END)::DOUBLE AS a, (CASE kind WHEN 'view' THEN 0.3 WHEN 'click' THEN 0.6 ELSE 1.0 END)::DOUBLE AS b FROM runlog)
    SELECT run_id, seq, round(max(least(1.0, greatest(0.0, a + (b - a) * least(1.0, greatest(0.0, duration_ms / 100))))) OVER (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING), 6) AS progress FROM k""")
def phase_progress(spark, d):
    from meridion.operators.events import phase_progress as op

    ranges = {"view": (0.0, 0.3), "click": (0.3, 0.6)}
    return op(v.runlog(spark, d), "kind", F.col("duration_ms") / 100, ranges, (0.6, 1.0)).select("run_id", "seq", F.round("progress", 6).alias("progress"))


@query("main_and_branches", "verts", f"""WITH {_SEG}, l AS (SELECT line_id, sum(len) AS length, count(*) AS flow FROM g GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY flow DESC, length DESC, line_id) AS n FROM l),
    m AS (SELECT k.*, first_value(length) OVER (ORDER BY n) AS ml, first_value(flow) OVER (ORDER BY n) AS mf FROM k)
    SELECT line_id, flow, n = 1 AS main FROM (SELECT *, row_number() OVER (ORDER BY n) AS r FROM m WHERE n = 1 OR (length >= greatest(120, 0.2*ml) AND flow >= greatest(2, 0.06*mf))) WHERE r <= 5""")
def main_and_branches(spark, d):
    t = p.segmentize(v.verts(spark, d)).groupBy("line_id").agg(F.sum("len").alias("length"), F.count("*").alias("flow"))
    return stats.main_and_branches(t, "line_id", 4).select("line_id", "flow", "main")


@query("water_site_pick", "verts", f"""WITH c AS (SELECT line_id, count(*) AS n FROM verts GROUP BY 1), q AS (SELECT line_id, seq, round(least(1.0, log10(1 + n) / 4), 4) AS quality FROM verts JOIN c USING (line_id) WHERE seq % greatest(1, n // 4) = 0)
    SELECT line_id, seq, quality FROM (SELECT *, row_number() OVER (ORDER BY quality DESC, line_id, seq) AS k FROM q) WHERE k <= 8""")
def water_site_pick(spark, d):
    t = v.verts(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("line_id")))
    t = t.where(F.col("seq") % F.greatest(F.lit(1), F.expr("n div 4")) == 0).select("line_id", "seq", r4(F.least(F.lit(1.0), F.log10(1 + F.col("n")) / 4)).alias("quality"))
    return t.orderBy(F.desc("quality"), "line_id", "seq").limit(8)
