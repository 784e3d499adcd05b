"""Documents of layers, written and read back, and streams of events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridion.plans import views as v
from meridion.plans.registry import query
from meridion.session import ScratchTables
from meridion.sources import documents as docs


def _document(spark, d):
    return docs.assemble(v.verts(spark, d), ["line_id"], ["seq"], "vertices")


@query("assemble_document", "verts", "SELECT line_id, count(*) AS n, string_agg(seq::VARCHAR || ':' || x::BIGINT::VARCHAR, ' ' ORDER BY seq) AS path FROM verts GROUP BY 1")
def assemble_document(spark, d):
    path = F.array_join(F.transform("vertices", lambda s: F.concat_ws(":", s["seq"].cast("string"), s["x"].cast("long").cast("string"))), " ")
    return _document(spark, d).select("line_id", F.size("vertices").cast("long").alias("n"), path.alias("path"))


@query("explode_layers", "verts", "SELECT line_id, seq, x, y FROM verts")
def explode_layers(spark, d):
    return docs.explode_layer(_document(spark, d), "vertices", "line_id")


@query("read_layers", "verts", "SELECT line_id, count(*) AS n, sum(x) AS sx FROM verts GROUP BY 1")
def read_layers(spark, d):
    """Documents written as JSON, read back under a declared schema."""
    whole = _document(spark, d)
    tables = ScratchTables(spark)
    path = f"{tables.root}/layers"
    whole.write.json(path)
    good, _ = docs.read_layers_lines(spark, path, whole.schema)
    return good.select("line_id", F.size("vertices").cast("long").alias("n"), F.aggregate("vertices", F.lit(0.0), lambda a, s: a + s["x"]).alias("sx"))


@query("write_layers", "edges", "SELECT road_class, count(*) AS n, sum(id)::BIGINT AS ids FROM edges GROUP BY 1")
def write_layers(spark, d):
    """A folder per layer, read back with its layer from the path."""
    path = f"{ScratchTables(spark).root}/by_class"
    docs.write_layers(v.edges(spark, d).select("id", "road_class", "weight"), path, "road_class", "parquet")
    return spark.read.parquet(path).groupBy("road_class").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


_TRACES = T.StructType().add("run_id", "long").add("traces", T.ArrayType(T.StructType().add("trace_id", "long").add("accepted", "boolean").add("steps", T.ArrayType(T.StructType().add("x", "double").add("y", "double")))))


def _logs(spark, d):
    t = v.verts(spark, d).select(F.expr("line_id div 10").alias("run_id"), F.col("line_id").alias("trace_id"), "seq", "x", "y")
    t = t.groupBy("run_id", "trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("steps"))
    t = t.withColumn("accepted", F.col("trace_id") % 3 == 0)
    t = t.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("trace_id", "accepted", "steps"))).alias("traces"))
    path = f"{ScratchTables(spark).root}/logs"
    t.write.json(path)
    return docs.read_trace_logs(spark, path, _TRACES, lines=True)


@query("read_trace_logs", "verts", "SELECT line_id // 10 AS run_id, count(DISTINCT line_id) AS n FROM verts GROUP BY 1")
def read_trace_logs(spark, d):
    return _logs(spark, d).select("run_id", F.size("traces").cast("long").alias("n"))


@query("explode_traces", "verts", "SELECT line_id AS trace_id, seq AS step_no, x, y FROM verts")
def explode_traces(spark, d):
    _, steps = docs.explode_traces(_logs(spark, d).drop("run_id"))
    return steps.select("trace_id", F.col("step_no").cast("long").alias("step_no"), "x", "y")


def _streamed(spark, d, transform):
    """The run log through a file stream to its end; the rows of its sink."""
    from meridion.streaming import feeds

    path = f"{ScratchTables(spark).root}/feed"
    v.runlog(spark, d).write.parquet(path)
    return feeds.run_once(spark, path, transform)


@query("stream_sequence_dedupe", "runlog", "SELECT run_id, seq FROM runlog")
def stream_sequence_dedupe(spark, d):
    from meridion.streaming import feeds

    return _streamed(spark, d, lambda s: (feeds.deduped(s.unionByName(s)), "append")).select("run_id", "seq")


@query("stream_job_status", "runlog", "SELECT run_id, max(seq) AS last_seq, arg_max(kind, seq) AS phase, count(*) AS n FROM runlog GROUP BY 1")
def stream_job_status(spark, d):
    from meridion.streaming import feeds

    return _streamed(spark, d, lambda s: (feeds.status(s), "complete"))


@query("stream_idle_gaps", "runlog", """WITH g AS (SELECT run_id, seq, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM runlog WINDOW w AS (PARTITION BY run_id ORDER BY seq)) SELECT run_id, sum(b)::BIGINT AS sessions, count(*) AS events FROM g GROUP BY 1""")
def stream_idle_gaps(spark, d):
    from meridion.streaming import feeds

    t = _streamed(spark, d, lambda s: (feeds.sessions(s, "2 hours"), "complete"))
    return t.groupBy("run_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("stream_ring_buffer", "runlog", "SELECT run_id, seq, n - 5 AS dropped FROM (SELECT run_id, seq, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS b FROM runlog) WHERE b <= 5 AND n >= 5")
def stream_ring_buffer(spark, d):
    from meridion.streaming import feeds

    t = _streamed(spark, d, lambda s: (feeds.ring_buffer(s, 5), "update"))
    last = t.groupBy("run_id").agg(F.max_by(F.struct("seqs", "dropped"), "total").alias("s"))
    return last.where(F.size("s.seqs") >= 5).select("run_id", F.explode("s.seqs").alias("seq"), F.col("s.dropped").alias("dropped"))


@query("stream_event_meta", "runlog", "SELECT run_id, seq, kind, strlen(props)::BIGINT AS payload_bytes FROM runlog")
def stream_event_meta(spark, d):
    """What each event is about, without its payload, as a stream."""
    t = _streamed(spark, d, lambda s: (s.select("run_id", "seq", "kind", F.octet_length("props").cast("long").alias("payload_bytes")), "append"))
    return t


@query("stream_latest_state", "runlog", """WITH k AS (SELECT run_id, (event_id % 9)::VARCHAR AS entity, max(seq) FILTER (kind <> 'purchase') AS open_seq, max(seq) FILTER (kind = 'purchase') AS done_seq, count(*) FILTER (kind = 'purchase') AS completions, max(seq) AS seq, arg_max(kind, seq) AS value FROM runlog GROUP BY ALL)
    SELECT run_id, entity, CASE WHEN done_seq IS NULL OR open_seq > done_seq THEN 'partial' ELSE 'complete' END AS state, seq, value, completions FROM k""")
def stream_latest_state(spark, d):
    """Entities of each run with their latest event; those that a purchase completes are no longer partial."""
    from meridion.streaming import stateful

    stateful.use_rocksdb(spark)
    marked = lambda s: s.select("run_id", "seq", "ts", (F.col("event_id") % 9).cast("string").alias("entity"), F.col("kind").alias("value"), (F.col("kind") == "purchase").alias("complete"))
    t = _streamed(spark, d, lambda s: (stateful.fold_latest_state(marked(s)), "update"))
    last = t.groupBy("run_id", "entity").agg(F.max(F.struct("completions", "seq", "state", "value")).alias("m"))
    return last.select("run_id", "entity", "m.state", "m.seq", "m.value", "m.completions")


@query("stream_flush_batches", "runlog", """RECURSIVE WITH e AS (SELECT run_id, seq, epoch_ms(ts) AS ms, level = 'ERROR' AS urgent FROM runlog),
    r(run_id, seq, n, since, batch, reason) AS (SELECT run_id, 0::BIGINT, 0::BIGINT, min(ms), 0::BIGINT, NULL::VARCHAR FROM e GROUP BY run_id UNION ALL
      SELECT run_id, seq, CASE WHEN reason IS NULL THEN n ELSE 0 END, CASE WHEN reason IS NULL THEN since ELSE ms END, CASE WHEN reason IS NULL THEN batch ELSE batch + 1 END, reason FROM (
        SELECT e.run_id, e.seq, r.n + 1 AS n, r.since, r.batch, e.ms, CASE WHEN e.urgent THEN 'urgent' WHEN r.n + 1 >= 8 THEN 'full' WHEN e.ms - r.since >= 14400000 THEN 'interval' END AS reason FROM r JOIN e ON e.run_id = r.run_id AND e.seq = r.seq + 1))
    SELECT run_id, batch - 1 AS batch, seq AS last_seq, seq - coalesce(lag(seq) OVER (PARTITION BY run_id ORDER BY seq), 0) AS n, reason FROM r WHERE reason IS NOT NULL""")
def stream_flush_batches(spark, d):
    """Batches of at most 8 events or four hours, at once when one is an error."""
    from meridion.streaming import stateful

    stateful.use_rocksdb(spark)
    t = _streamed(spark, d, lambda s: (stateful.flush_batches(s.withColumn("urgent", F.col("level") == "ERROR"), 8, 14_400_000), "append"))
    return t.where("reason <> 'timer'").select("run_id", "batch", F.element_at("seqs", -1).alias("last_seq"), "n", "reason")
