"""Run-log reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridion.operators import events as e
from meridion.plans import views as v
from meridion.plans.registry import query


@query("assign_seq", "runlog", "SELECT run_id, event_id, seq FROM runlog")
def assign_seq(spark, d):
    return v.runlog(spark, d).select("run_id", "event_id", "seq")


@query("ring_buffer_tail", "runlog", "SELECT run_id, seq, greatest(n - 5, 0) AS dropped FROM (SELECT run_id, seq, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS b FROM runlog) WHERE b <= 5")
def ring_buffer_tail(spark, d):
    return e.ring_tail(v.runlog(spark, d), 5).select("run_id", "seq", "dropped")


@query("run_eviction", "runlog", "SELECT run_id, epoch_us(max(ts)) AS last_us FROM runlog GROUP BY run_id ORDER BY max(ts) DESC, run_id DESC LIMIT 32")
def run_eviction(spark, d):
    return e.recent_runs(v.runlog(spark, d), 32).select("run_id", F.unix_micros("last_ts").alias("last_us"))


@query("poll_since", "runlog", "SELECT run_id, seq, kind, level FROM runlog WHERE run_id = (SELECT min(run_id) FROM runlog) AND seq > 3 AND level = 'INFO' ORDER BY seq LIMIT 20")
def poll_since(spark, d):
    log = v.runlog(spark, d)
    first = log.agg(F.min("run_id")).head()[0]
    return e.poll(log, first, 3, "INFO", None, 20).select("run_id", "seq", "kind", "level")


@query("job_status", "runlog", "SELECT run_id, max(seq) AS last_seq, arg_max(CASE WHEN level = 'ERROR' THEN 'failed' WHEN kind = 'purchase' THEN 'completed' ELSE 'running' END, seq) AS status, arg_max(kind, seq) AS phase, count(*) AS n FROM runlog GROUP BY run_id")
def job_status(spark, d):
    state = F.when(F.col("level") == "ERROR", "failed").when(F.col("kind") == "purchase", "completed").otherwise("running")
    return e.job_status(v.runlog(spark, d), state)


_PHASES = ("view", "click", "purchase")


@query("phase_durations", "runlog", """WITH l AS (SELECT *, lead(ts) OVER w AS nx, lead(kind) OVER w AS nk FROM runlog WINDOW w AS (PARTITION BY run_id ORDER BY seq))
    SELECT run_id, seq, kind, epoch_us(nx) - epoch_us(ts) AS micros, list_position(['view', 'click', 'purchase'], nk) >= list_position(['view', 'click', 'purchase'], kind) AS in_order FROM l WHERE nx IS NOT NULL""")
def phase_durations(spark, d):
    """Durations up to the next record; whether that keeps the order of the phases (null where one is no phase)."""
    log = v.runlog(spark, d)
    place = lambda c: F.array_position(F.array(*map(F.lit, _PHASES)), c)
    following = log.select("run_id", (F.col("seq") - 1).alias("seq"), place(F.col("kind")).alias("next"))
    t = e.phase_durations(log).join(following, ["run_id", "seq"])
    return t.select("run_id", "seq", "kind", "micros", (F.nullif("next", F.lit(0)) >= F.nullif(place(F.col("kind")), F.lit(0))).alias("in_order"))


@query("phase_timings", "runlog", "SELECT run_id, kind, count(*) AS n, round(sum(duration_ms), 2) AS total_ms, round(sum(duration_ms) / sum(sum(duration_ms)) OVER (PARTITION BY run_id), 4) AS share FROM runlog GROUP BY run_id, kind")
def phase_timings(spark, d):
    from pyspark.sql import Window

    t = v.runlog(spark, d).groupBy("run_id", "kind").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("s"))
    return t.select("run_id", "kind", "n", F.round("s", 2).alias("total_ms"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy("run_id")), 4).alias("share"))


@query("fold_latest_state", "runlog", "SELECT run_id, event_id % 9 AS entity, max(seq) AS seq, bool_or(kind = 'purchase') AS done, arg_max(kind, seq) AS kind FROM runlog GROUP BY run_id, event_id % 9")
def fold_latest_state(spark, d):
    return e.fold_latest(v.runlog(spark, d), F.col("event_id") % 9, F.col("kind") == "purchase")


@query("micro_batches", "runlog", "SELECT run_id, epoch_us(time_bucket(INTERVAL 1 hour, ts)) AS start_us, count(*) AS n, ceil(count(*) / 8.0)::BIGINT AS batches FROM runlog GROUP BY run_id, time_bucket(INTERVAL 1 hour, ts)")
def micro_batches(spark, d):
    return e.micro_batches(v.runlog(spark, d), "1 hour", 8).select("run_id", F.unix_micros("start").alias("start_us"), "n", "batches")


@query("idle_gaps", "runlog", """WITH g AS (SELECT run_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 hour OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b, seq FROM runlog WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
    s AS (SELECT run_id, ts, sum(b) OVER (PARTITION BY run_id ORDER BY seq) AS k FROM g) SELECT run_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY run_id, k""")
def idle_gaps(spark, d):
    return e.idle_gaps(v.runlog(spark, d), "2 hours").select("run_id", F.unix_micros("start").alias("start_us"), "n")


@query("stream_summary", "runlog", """WITH b AS (SELECT run_id, time_bucket(INTERVAL 1 hour, ts) AS start, count(*) AS n, min(ts) AS a, max(ts) AS z FROM runlog GROUP BY ALL), k AS (SELECT run_id, count(DISTINCT kind) AS kinds FROM runlog GROUP BY 1)
    SELECT run_id, sum(n)::BIGINT AS events, any_value(kinds) AS kinds, sum(ceil(n / 8.0))::BIGINT AS batches, max(least(n, 8)) AS max_batch, epoch_us(max(z)) - epoch_us(min(a)) AS elapsed_us FROM b JOIN k USING (run_id) GROUP BY run_id""")
def stream_summary(spark, d):
    log = v.runlog(spark, d)
    runs = log.groupBy("run_id").agg(F.count("*").alias("events"), F.countDistinct("kind").alias("kinds"), (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))).alias("elapsed_us"))
    batches = e.micro_batches(log, "1 hour", 8).groupBy("run_id").agg(F.sum("batches").alias("batches"), F.max(F.least("n", F.lit(8))).cast("long").alias("max_batch"))
    return runs.join(batches, "run_id")


@query("sequence_dedupe", "runlog", "SELECT run_id, seq // 2 AS pair, min(event_id) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq // 2 ORDER BY event_id) AS n FROM runlog) WHERE n = 1 GROUP BY ALL")
def sequence_dedupe(spark, d):
    t = v.runlog(spark, d).withColumn("pair", F.expr("seq div 2"))
    return e.sequence_dedupe(t, ["run_id", "pair"], ["event_id"]).select("run_id", "pair", "event_id")


@query("reason_histogram", "runlog", "SELECT kind || '/' || level AS reason, count(*) AS n FROM runlog GROUP BY ALL ORDER BY n DESC, reason LIMIT 4")
def reason_histogram(spark, d):
    return e.reason_histogram(v.runlog(spark, d), F.concat_ws("/", "kind", "level"), 4)


@query("trace_summary", "runlog", """WITH r AS (SELECT run_id, string_agg(kind || '=' || n::VARCHAR, ',' ORDER BY kind) AS reasons FROM (SELECT run_id, kind, count(*) AS n FROM runlog WHERE level <> 'INFO' GROUP BY ALL) GROUP BY 1),
    t AS (SELECT run_id, sum(CASE WHEN level = 'INFO' THEN 1 ELSE 0 END)::BIGINT AS accepted, sum(CASE WHEN level <> 'INFO' THEN 1 ELSE 0 END)::BIGINT AS rejected, sum(CASE WHEN duration_ms > 50 THEN 1 ELSE 0 END)::BIGINT AS slow FROM runlog GROUP BY run_id)
    SELECT run_id, accepted, rejected, slow, coalesce(reasons, '') AS reasons FROM t LEFT JOIN r USING (run_id)""")
def trace_summary(spark, d):
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    # One row for each run and kind comes out of the partial sums, so that a run's reasons are a short list.
    t = v.runlog(spark, d).groupBy("run_id", "kind").agg(n(F.col("level") == "INFO").alias("accepted"), n(F.col("level") != "INFO").alias("rejected"), n(F.col("duration_ms") > 50).alias("slow"))
    reason = F.when(F.col("rejected") > 0, F.struct("kind", "rejected"))
    text = F.transform(F.array_sort(F.collect_list(reason)), lambda r: F.concat_ws("=", r["kind"], r["rejected"].cast("string")))
    return t.groupBy("run_id").agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected", "slow")), F.array_join(text, ",").alias("reasons"))
