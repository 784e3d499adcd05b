"""Run-log and progress events, in batch; the streaming forms of the same reductions are in meridion.streaming.feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def assign_seq(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(.., seq): 1, 2, .. within each run."""
    return log.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def typed_payload(log: DataFrame, column: str, schema: str) -> DataFrame:
    return log.withColumn("payload", F.from_json(column, schema))


def event_meta(log: DataFrame, kind: str, payload: str, points: str) -> DataFrame:
    """(.., kind, payload_bytes, point_count): what an event is about, its geometry replaced by its size."""
    return log.withColumn("kind", F.col(kind)).withColumn("payload_bytes", F.length(payload).cast("long")).withColumn("point_count", F.greatest(F.size(points), F.lit(0)).cast("long")).drop(points)


def ring_tail(log: DataFrame, keep: int, runs: int | None = None) -> DataFrame:
    """The last ``keep`` records of each run, and of the ``runs`` most recently active runs only; with dropped."""
    part = Window.partitionBy("run_id")
    t = log.withColumn("_back", F.row_number().over(part.orderBy(F.desc("seq")))).withColumn("dropped", F.greatest(F.count("*").over(part) - keep, F.lit(0)))
    t = t.where(F.col("_back") <= keep).drop("_back")
    if runs is not None:
        t = t.join(recent_runs(log, runs).select("run_id"), "run_id", "left_semi")
    return t


def recent_runs(log: DataFrame, runs: int) -> DataFrame:
    return log.groupBy("run_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), F.desc("run_id")).limit(runs)


def poll(log: DataFrame, run: int, since: int, level: str | None = None, kind: str | None = None, limit: int = 200) -> DataFrame:
    """The first records of a run behind a sequence number; the limit is kept within 1 and 2000."""
    t = log.where((F.col("run_id") == run) & (F.col("seq") > since))
    t = t.where(F.col("level") == level) if level else t
    t = t.where(F.col("kind") == kind) if kind else t
    return t.orderBy("seq").limit(min(2000, max(1, limit)))


def job_status(log: DataFrame, state: Column) -> DataFrame:
    """(run_id, last_seq, status, phase, n): the latest state of each run."""
    return log.groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.max_by(state, "seq").alias("status"), F.max_by("kind", "seq").alias("phase"), F.count("*").alias("n"))


def phase_durations(log: DataFrame) -> DataFrame:
    """(run_id, seq, kind, seconds): time from each phase event to the next of its run."""
    nxt = F.lead("ts").over(Window.partitionBy("run_id").orderBy("seq"))
    return log.select("run_id", "seq", "kind", (F.unix_micros(nxt) - F.unix_micros("ts")).alias("micros")).where("micros is not null")


def phase_progress(log: DataFrame, phase: str, share: Column, ranges: dict[str, tuple[float, float]], otherwise: tuple[float, float]) -> DataFrame:
    """(.., progress): a phase's own share put into its range; never falls within a run."""
    pick = lambda i: F.coalesce(*(F.when(F.col(phase) == k, r[i]) for k, r in ranges.items()), F.lit(otherwise[i]))
    clip = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    now = clip(pick(0) + (pick(1) - pick(0)) * clip(share))
    return log.withColumn("_now", now).withColumn("progress", F.max("_now").over(Window.partitionBy("run_id").orderBy("seq"))).drop("_now")


def fold_latest(log: DataFrame, entity: Column, finished: Column) -> DataFrame:
    """(run_id, entity, seq, done): the last event of each entity; one that finished stays finished."""
    t = log.withColumn("entity", entity)
    return t.groupBy("run_id", "entity").agg(F.max("seq").alias("seq"), F.max(finished.cast("int")).cast("boolean").alias("done"), F.max_by("kind", "seq").alias("kind"))


def micro_batches(log: DataFrame, width: str, at_most: int) -> DataFrame:
    """(run_id, start, n, batches): events per window, and the flushes that at most ``at_most`` events a batch make."""
    t = log.groupBy("run_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
    return t.select("run_id", F.col("w.start").alias("start"), "n", F.ceil(F.col("n") / at_most).cast("long").alias("batches"))


def idle_gaps(log: DataFrame, gap: str) -> DataFrame:
    """(run_id, start, n): sessions that an idle time ends."""
    return log.groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("run_id", F.col("w.start").alias("start"), "n")


def sequence_dedupe(log: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    first = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return log.withColumn("_n", first).where("_n = 1").drop("_n")


def reason_histogram(log: DataFrame, reason: Column, top: int) -> DataFrame:
    return log.groupBy(reason.alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason").limit(top)
