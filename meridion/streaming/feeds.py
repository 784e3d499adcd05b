"""Structured Streaming forms of the run-log reductions.

The event feed has run_id, seq, ts and kind.  State is bounded by a watermark; rows later than it are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from meridion.session import shared_folder

WATERMARK = "10 minutes"


def read_feed(spark: SparkSession, path: str, schema, form: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(form).load(path)


def deduped(stream: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """One row per run and sequence number."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["run_id", "seq"])


def micro_batches(stream: DataFrame, width: str, watermark: str = WATERMARK) -> DataFrame:
    return stream.withWatermark("ts", watermark).groupBy("run_id", F.window("ts", width)).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, gap: str, watermark: str = WATERMARK) -> DataFrame:
    t = stream.withWatermark("ts", watermark).groupBy("run_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return t.select("run_id", F.col("w.start").alias("start"), "n")


def status(stream: DataFrame) -> DataFrame:
    return stream.groupBy("run_id").agg(F.max("seq").alias("last_seq"), F.max_by("kind", "seq").alias("phase"), F.count("*").alias("n"))


def summary(stream: DataFrame) -> DataFrame:
    return stream.groupBy("run_id").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def fold_latest(stream: DataFrame, entity) -> DataFrame:
    return stream.withColumn("entity", entity).groupBy("run_id", "entity").agg(F.max("seq").alias("seq"), F.max_by("kind", "seq").alias("kind"))


def ring_buffer(stream: DataFrame, keep: int) -> DataFrame:
    """(run_id, seqs, total, dropped): the last ``keep`` sequence numbers of each run, as state of that size."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, total = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for f in frames:
            total += len(f)
            seqs = sorted([*seqs, *f["seq"].tolist()])[-keep:]
        state.update((seqs, total))
        yield pd.DataFrame({"run_id": [key[0]], "seqs": [seqs], "total": [total], "dropped": [max(0, total - keep)]})

    return stream.select("run_id", "seq").groupBy("run_id").applyInPandasWithState(
        update, "run_id long, seqs array<long>, total long, dropped long", "seqs array<long>, total long", "update", GroupStateTimeout.NoTimeout
    )


def run_once(spark: SparkSession, path: str, transform: Callable[[DataFrame], tuple[DataFrame, str]]) -> DataFrame:
    """All that a folder holds through a stream; the rows that the sink got, as a table.

    Each micro-batch is a folder of its own in the shared folder, written over when the batch is run again, so that no
    row is kept in the driver or twice.  In mode "complete" the last batch is the result.
    """
    stream, mode = transform(read_feed(spark, path, spark.read.parquet(path).schema))
    root = f"{shared_folder(spark)}/feed_{uuid.uuid4().hex}"
    to_sink(stream, lambda rows, n: rows.write.mode("overwrite").parquet(f"{root}/rows/batch={n}"), f"{root}/state", mode, once=True).awaitTermination()
    ran = _batches(spark, f"{root}/rows")
    if not ran:
        return spark.createDataFrame([], stream.schema)
    kept = [max(ran)] if mode == "complete" else ran
    return spark.read.schema(stream.schema).parquet(*(f"{root}/rows/batch={n}" for n in kept))


def _batches(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the batches written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getName().removeprefix("batch=")) for f in fs.listStatus(path)) if fs.exists(path) else []


def to_sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update", once: bool = False):
    """Each micro-batch to the caller's function, with its number, by which a batch run again is known; ``once``: end with the input."""
    writer = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
