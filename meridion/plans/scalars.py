"""Projections, predicates, configuration and string functions over the layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.functions import geometry as g
from meridion.functions import text as s
from meridion.plans import views as v
from meridion.plans.registry import query
from meridion.session import table
from meridion.sources import documents as docs

E = v.EXTENT


def r4(c):
    return F.round(c, 4)


@query("world_to_cell", "pts", f"""SELECT id, least(63, greatest(0, round_even(x / {E} * 63, 0)))::BIGINT AS ix, least(63, greatest(0, round_even(y / {E} * 63, 0)))::BIGINT AS iy,
    round(least(63, greatest(0, round_even(x / {E} * 63, 0))) / 63.0::DOUBLE * {E}, 4) AS cx FROM pts""")
def world_to_cell(spark, d):
    p = v.pts(spark, d)
    ix, iy = g.world_to_cell(F.col("x"), E, 64), g.world_to_cell(F.col("y"), E, 64)
    return p.select("id", ix.alias("ix"), iy.alias("iy"), r4(g.cell_to_world(ix, E, 64)).alias("cx"))


@query("vec_ops", "seg", """SELECT id, round(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)), 4) AS len,
    round(CASE WHEN sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) <= 1e-6 THEN 0.0 ELSE (x1-x0)/sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)) END, 4) AS ux,
    round(x0*x1+y0*y1, 2) AS dot, round(x0*y1-y0*x1, 2) AS cr, x0+x1 AS sx, (x0-x1)*2 AS dx2 FROM seg""")
def vec_ops(spark, d):
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return v.seg(spark, d).select(
        "id", r4(g.length(dx, dy)).alias("len"), r4(g.unit(dx, dy)[0]).alias("ux"), F.round(g.dot("x0", "y0", "x1", "y1"), 2).alias("dot"),
        F.round(g.cross("x0", "y0", "x1", "y1"), 2).alias("cr"), (F.col("x0") + F.col("x1")).alias("sx"), ((F.col("x0") - F.col("x1")) * 2).alias("dx2"),
    )


@query("bbox", "verts", "SELECT line_id, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM verts GROUP BY line_id")
def bbox(spark, d):
    return v.verts(spark, d).groupBy("line_id").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


@query("bbox_overlaps", "zones", """SELECT zone_id, (cx-half <= 6000+1e-6 AND 4000 <= cx+half+1e-6 AND cy-half <= 7000+1e-6 AND 3000 <= cy+half+1e-6) AS hit FROM zones""")
def bbox_overlaps(spark, d):
    z = v.zones(spark, d)
    z = z.select("zone_id", *[e.alias(n) for n, e in (("a_min_x", F.col("cx") - F.col("half")), ("a_max_x", F.col("cx") + F.col("half")), ("a_min_y", F.col("cy") - F.col("half")), ("a_max_y", F.col("cy") + F.col("half")))],
                 *[F.lit(x).alias(n) for n, x in (("b_min_x", 4000.0), ("b_max_x", 6000.0), ("b_min_y", 3000.0), ("b_max_y", 7000.0))])
    return z.select("zone_id", g.boxes_overlap("a_", "b_").alias("hit"))


_LINE = (1000.0, 900.0, 9000.0, 9100.0)


@query("segment_intersection", "seg", f"""WITH k AS (SELECT *, {_LINE[2]-_LINE[0]} AS sx, {_LINE[3]-_LINE[1]} AS sy, (x1-x0)*{_LINE[3]-_LINE[1]} - (y1-y0)*{_LINE[2]-_LINE[0]} AS den FROM seg),
    t AS (SELECT *, (({_LINE[0]}-x0)*sy - ({_LINE[1]}-y0)*sx) / nullif(den, 0) AS t, (({_LINE[0]}-x0)*(y1-y0) - ({_LINE[1]}-y0)*(x1-x0)) / nullif(den, 0) AS u FROM k)
    SELECT id, CASE WHEN abs(den) > 1e-6 AND t BETWEEN -1e-6 AND 1+1e-6 AND u BETWEEN -1e-6 AND 1+1e-6 THEN 'point' ELSE 'none' END AS kind,
    CASE WHEN abs(den) > 1e-6 AND t BETWEEN -1e-6 AND 1+1e-6 AND u BETWEEN -1e-6 AND 1+1e-6 THEN round(x0+t*(x1-x0), 4) END AS x FROM t""")
def segment_intersection(spark, d):
    t = v.seg(spark, d).select("*", *[F.lit(x).alias(n) for n, x in zip(("cx", "cy", "dx", "dy"), _LINE, strict=True)])
    kind, x, _ = g.meeting(("x0", "y0", "x1", "y1"), ("cx", "cy", "dx", "dy"))
    return t.select("id", kind.alias("kind"), r4(x).alias("x"))


_T = "least(1.0, greatest(0.0, ((5000-x0)*(x1-x0)+(5000-y0)*(y1-y0)) / nullif((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0), 0)))"


@query("project_to_segment", "seg", f"""SELECT id, round(x0+coalesce({_T},0)*(x1-x0), 4) AS px, round(y0+coalesce({_T},0)*(y1-y0), 4) AS py,
    round(sqrt(pow(5000-(x0+coalesce({_T},0)*(x1-x0)),2)+pow(5000-(y0+coalesce({_T},0)*(y1-y0)),2)), 4) AS dist FROM seg""")
def project_to_segment(spark, d):
    t = g.along_segment(5000.0, 5000.0, "x0", "y0", "x1", "y1")
    x, y = F.col("x0") + t * (F.col("x1") - F.col("x0")), F.col("y0") + t * (F.col("y1") - F.col("y0"))
    return v.seg(spark, d).select("id", r4(x).alias("px"), r4(y).alias("py"), r4(g.segment_distance(5000.0, 5000.0, "x0", "y0", "x1", "y1")).alias("dist"))


@query("bearing", "seg", """SELECT id, round(CASE WHEN degrees(atan2(y1-y0, x1-x0)) < 0 THEN degrees(atan2(y1-y0, x1-x0)) + 360 ELSE degrees(atan2(y1-y0, x1-x0)) END, 4) AS bearing FROM seg""")
def bearing(spark, d):
    return v.seg(spark, d).select("id", r4(g.bearing(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("bearing"))


_N = "(sqrt((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0)))"


@query("angle_between", "seg", f"""SELECT id, round(CASE WHEN {_N} <= 1e-6 THEN 180.0 ELSE degrees(acos(least(1.0, greatest(-1.0, (x1-x0) / {_N})))) END, 4) AS angle FROM seg""")
def angle_between(spark, d):
    return v.seg(spark, d).select("id", r4(g.angle_between(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), 1.0, 0.0)).alias("angle"))


@query("polygon_area", "zones", "SELECT zone_id, round(area, 4) AS area, 2*half AS width, 2*half AS height, 1.0::DOUBLE AS aspect FROM zones")
def polygon_area(spark, d):
    corner = lambda i, j: F.struct((F.col("cx") + i * F.col("half")).alias("x"), (F.col("cy") + j * F.col("half")).alias("y"))
    z = v.zones(spark, d).withColumn("ring", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)))
    span = lambda k: F.array_max(F.transform("ring", lambda p: p[k])) - F.array_min(F.transform("ring", lambda p: p[k]))
    return z.select("zone_id", r4(g.ring_area(F.col("ring"))).alias("area"), span("x").alias("width"), span("y").alias("height"), r4(F.greatest(span("x"), span("y")) / F.least(span("x"), span("y"))).alias("aspect"))


@query("class_filter", "edges", "SELECT id, road_class, road_class IN ('arterial', 'major_local') AS target FROM edges")
def class_filter(spark, d):
    return v.edges(spark, d).select("id", "road_class", F.col("road_class").isin("arterial", "major_local").alias("target"))


@query("lod_filter", "edges", """SELECT id, road_class, row_number() OVER (ORDER BY CASE road_class WHEN 'minor_local' THEN 0 WHEN 'major_local' THEN 1 ELSE 2 END, length_m DESC, id) AS draw_order
    FROM edges WHERE road_class <> 'minor_local'""")
def lod_filter(spark, d):
    from meridion.operators.stats import lod_filter as op

    return op(v.edges(spark, d), scale=1.0).select("id", "road_class", "draw_order")


@query("within_extent", "pts", "SELECT id FROM pts WHERE x BETWEEN 250 AND 9750 AND y BETWEEN 250 AND 9750")
def within_extent(spark, d):
    return v.pts(spark, d).where(F.col("x").between(250.0, 9750.0) & F.col("y").between(250.0, 9750.0)).select("id")


@query("contact_mode", "seg", f"""SELECT id, CASE WHEN c <= -0.82 THEN 'opposing' WHEN abs(c) <= 0.34 THEN 'perpendicular' WHEN abs(c) >= 0.82 THEN 'parallel' ELSE 'oblique' END AS mode
    FROM (SELECT id, CASE WHEN {_N} <= 1e-6 THEN 0.0 ELSE (x1-x0) / {_N} END AS c FROM seg)""")
def contact_mode(spark, d):
    ux, _ = g.unit(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return v.seg(spark, d).select("id", g.contact_mode(ux).alias("mode"))


@query("blend_direction", "seg", f"""WITH u AS (SELECT id, CASE WHEN {_N} <= 1e-6 THEN 0.0 ELSE (x1-x0)/{_N} END AS ux, CASE WHEN {_N} <= 1e-6 THEN 0.0 ELSE (y1-y0)/{_N} END AS uy FROM seg),
    b AS (SELECT id, 0.7 + (CASE WHEN ux < 0 THEN -1 ELSE 1 END) * ux * 0.3::DOUBLE AS bx, (CASE WHEN ux < 0 THEN -1 ELSE 1 END) * uy * 0.3::DOUBLE AS by_ FROM u)
    SELECT id, round(bx / sqrt(bx*bx+by_*by_), 4) AS dx, round(by_ / sqrt(bx*bx+by_*by_), 4) AS dy FROM b""")
def blend_direction(spark, d):
    t = v.seg(spark, d)
    ux, uy = g.unit(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    t = t.select("id", ux.alias("ux"), uy.alias("uy"))
    bx, by = g.blend(1.0, 0.0, "ux", "uy", F.lit(0.3))
    return t.select("id", r4(bx).alias("dx"), r4(by).alias("dy"))


@query("tile_transform", "pts", "SELECT id, round((x - 5120) * 0.25 + 400, 4) AS sx, round(300 - (y - 5120) * 0.25, 4) AS sy FROM pts")
def tile_transform(spark, d):
    sx, sy = s.world_to_screen(F.col("x"), F.col("y"), 5120.0, 5120.0, 0.25, 800.0, 600.0)
    return v.pts(spark, d).select("id", r4(sx).alias("sx"), r4(sy).alias("sy"))


@query("validate_rules", "pts", """SELECT id, list_filter([CASE WHEN v < 0 THEN 'v_negative' END, CASE WHEN x > 9000 THEN 'x_range' END, CASE WHEN id % 10 = 7 THEN 'id_vocabulary' END], lambda r: r IS NOT NULL)::VARCHAR AS broken,
    NOT (v < 0 OR x > 9000 OR id % 10 = 7) AS valid FROM pts""")
def validate_rules(spark, d):
    rules = {"v_negative": F.col("v") < 0, "x_range": F.col("x") > 9000, "id_vocabulary": F.col("id") % 10 == 7}
    t = docs.validate(v.pts(spark, d), rules)
    return t.select("id", F.concat(F.lit("["), F.array_join("broken", ", "), F.lit("]")).alias("broken"), "valid")


@query("normalize_config", "", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 'buy' ELSE event_type END AS kind, coalesce(value, 0.0) AS amount FROM events")
def normalize_config(spark, d):
    t = table(spark, d, "events").withColumnRenamed("value", "legacy_value").withColumn("deprecated_flag", F.lit(1))
    t = docs.normalize(t, deprecated=("deprecated_",), renamed={"legacy_value": "amount", "event_type": "kind"}, defaults={"amount": 0.0})
    return t.select("event_id", F.when(F.col("kind") == "purchase", "buy").otherwise(F.col("kind")).alias("kind"), "amount")


@query("config_fingerprint", "", "SELECT event_id, substr(sha256('event_type=' || event_type || ';user_id=' || user_id::VARCHAR || ';value_cents=' || round(value * 100)::BIGINT::VARCHAR), 1, 16) AS fingerprint FROM events")
def config_fingerprint(spark, d):
    t = table(spark, d, "events").withColumn("value_cents", F.round(F.col("value") * 100).cast("long"))
    return t.select("event_id", s.fingerprint(["value_cents", "user_id", "event_type"]).alias("fingerprint"))


@query("sanitize_payload", "", """SELECT doc_id, CASE WHEN length(text) > 512 THEN substr(text, 1, 512) || '...(truncated:' || length(text)::VARCHAR || ')' ELSE text END AS text,
    len(list_slice(string_split(text, ' '), 1, 50)) + CASE WHEN len(string_split(text, ' ')) > 50 THEN 1 ELSE 0 END AS items FROM documents""")
def sanitize_payload(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", s.truncate(F.col("text"), 512).alias("text"), F.size(s.truncate_list(F.split("text", " "), 50)).cast("long").alias("items"))


@query("presets", "pts", """WITH p(preset, band, low) AS (VALUES ('default', 0.2, 0.0), ('river_valley', 0.3, -500.0), ('hills', 0.1, 2500.0))
    SELECT preset, count(*) AS n, round(max(v) * band, 4) AS top FROM pts JOIN p ON v >= low GROUP BY preset, band""")
def presets(spark, d):
    return docs.under_presets(v.pts(spark, d), docs.presets(spark)).groupBy("preset", "band").agg(F.count("*").alias("n"), r4(F.max("v") * F.col("band")).alias("top")).select("preset", "n", "top")


@query("level_normalize", "", "SELECT event_id, CASE upper(trim(event_type)) WHEN 'CLICK' THEN 'WARN' WHEN '' THEN NULL ELSE upper(trim(event_type)) END AS level FROM events")
def level_normalize(spark, d):
    t = table(spark, d, "events").withColumn("raw", F.concat(F.lit(" "), F.when(F.col("event_type") == "click", "warning").otherwise(F.col("event_type")), F.lit(" ")))
    return t.select("event_id", s.normal_level(F.col("raw")).alias("level"))


@query("phase_alias", "", """SELECT event_id, CASE lower(trim(event_type)) WHEN 'view' THEN 'terrain' WHEN 'click' THEN 'roads' ELSE lower(trim(event_type)) END AS phase FROM events""")
def phase_alias(spark, d):
    return table(spark, d, "events").select("event_id", s.alias_of(F.col("event_type"), {"view": "terrain", "click": "roads"}).alias("phase"))


@query("stage_expand", "", """WITH m(event_type, stage, place) AS (VALUES ('view','terrain',1), ('view','rivers',2), ('click','hubs',3), ('click','roads',4))
    SELECT e.event_id, coalesce(m.stage, e.event_type) AS stage, coalesce(m.place, 1000) AS place FROM events e LEFT JOIN m USING (event_type)""")
def stage_expand(spark, d):
    stages = {"view": ["terrain", "rivers"], "click": ["hubs", "roads"]}
    t = s.expand_stages(table(spark, d, "events"), "event_type", stages)
    return t.select("event_id", "stage", "place")


@query("note_parse", "", "SELECT event_id, split_part(event_type || ':' || value::VARCHAR, ':', 1) AS key, (event_type || '-cul') AS flagged, contains(event_type, '-cul') AS had FROM events")
def note_parse(spark, d):
    t = table(spark, d, "events")
    note = F.concat_ws(":", "event_type", F.col("value").cast("string"))
    return t.select("event_id", s.reason_key(note).alias("key"), s.append_suffix(F.col("event_type"), "-cul").alias("flagged"), F.contains("event_type", F.lit("-cul")).alias("had"))


@query("epoch_ms", "", "SELECT event_id, (epoch_us(ts) // 1000)::BIGINT AS ms, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, length(props) AS n_json FROM events")
def epoch_ms(spark, d):
    ts = F.col("ts").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.unix_millis(ts).alias("ms"), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.length("props").cast("long").alias("n_json"))


@query("hash_jitter", "pts", "SELECT id, round((id * 31 % 997) / 997.0::DOUBLE - 0.5, 6) AS jitter FROM pts")
def hash_jitter(spark, d):
    return v.pts(spark, d).select("id", F.round(s.jitter(F.col("id") * 31), 6).alias("jitter"))


@query("metric_merge", "pts", "SELECT id, x AS a, v AS b, y AS c FROM pts")
def metric_merge(spark, d):
    first, second = {"a": F.col("x"), "b": F.col("x")}, {"b": F.col("v"), "c": F.col("y")}
    return v.pts(spark, d).select("id", s.merge_metrics(first, second).alias("m")).select("id", F.col("m.a").alias("a"), F.col("m.b").alias("b"), F.col("m.c").alias("c"))


@query("width_from_flow", "pts", "SELECT id, round(least(48, greatest(22, 22 + 8.5 * ln(1 + abs(v)))), 4) AS main, round(least(20, greatest(8, 8 + 4.2 * ln(1 + abs(v)))), 4) AS branch FROM pts")
def width_from_flow(spark, d):
    return v.pts(spark, d).select("id", r4(s.river_width(F.abs("v"), main=True)).alias("main"), r4(s.river_width(F.abs("v"), main=False)).alias("branch"))


@query("parse_sse_frames", "", """WITH b AS (SELECT conv_id, turn, 'event: ' || role || chr(13) || chr(10) || ': note' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) || 'event: end' || chr(10) || 'data: x' || chr(10) || chr(10) AS body FROM conversations)
    SELECT conv_id, turn, 0::BIGINT AS frame, role AS event, text AS data FROM conversations UNION ALL SELECT conv_id, turn, 1::BIGINT, 'end', 'x' FROM conversations""")
def parse_sse_frames(spark, d):
    t = table(spark, d, "conversations")
    body = F.concat(F.lit("event: "), "role", F.lit("\r\n: note\ndata: "), F.replace("text", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\nevent: end\ndata: x\n\n"))
    return docs.parse_event_stream(t.withColumn("body", body), "body").select("conv_id", "turn", F.col("frame").cast("long").alias("frame"), "event", "data")


@query("read_event_stream", "", "SELECT event_id, event_type AS kind, (props::JSON->>'k')::BIGINT AS k FROM events")
def read_event_stream(spark, d):
    from meridion.operators.events import typed_payload

    return typed_payload(table(spark, d, "events"), "props", "k long").select("event_id", F.col("event_type").alias("kind"), F.col("payload.k").alias("k"))


@query("event_meta", "", "SELECT event_id, event_type AS kind, length(props) AS payload_bytes, (props::JSON->>'k')::BIGINT % 7 AS point_count FROM events")
def event_meta(spark, d):
    from meridion.operators.events import event_meta as op

    t = table(spark, d, "events").withColumn("points", F.sequence(F.lit(1).cast("long"), F.get_json_object("props", "$.k").cast("long") % 7 + 1))
    t = t.withColumn("points", F.slice("points", 1, F.size("points") - 1))
    return op(t, "event_type", "props", "points").select("event_id", "kind", "payload_bytes", "point_count")
