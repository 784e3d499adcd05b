"""Layer documents, configuration rows and event-stream bodies as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_layers(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, corrupt): documents of a declared schema, and the raw text of those that are no JSON or break it."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    t = spark.read.schema(whole).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path).cache()
    return t.where(F.col(CORRUPT).isNull()).drop(CORRUPT), t.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def read_layers_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As read_layers, for files with one document per line."""
    whole = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    t = spark.read.schema(whole).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path).cache()
    return t.where(F.col(CORRUPT).isNull()).drop(CORRUPT), t.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def write_layers(df: DataFrame, path: str, layer: str = "layer", form: str = "json") -> None:
    """One folder per layer."""
    df.write.mode("overwrite").partitionBy(layer).format(form).save(path)


def to_document(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("document"))


def explode_layer(df: DataFrame, layer: str, *keys: str) -> DataFrame:
    """One row per element of a document's layer."""
    return df.select(*keys, F.inline(layer))


def assemble(df: DataFrame, by: list[str], order: list[str], layer: str) -> DataFrame:
    """Rows to one document per key, its elements in order."""
    rest = [c for c in df.columns if c not in by and c not in order]
    return df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(layer))


def validate(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(.., broken, valid): the names of the rules that a row breaks; a rule is the condition that breaks it."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules.items())))
    return df.withColumn("broken", broken).withColumn("valid", F.size("broken") == 0)


def unknown_fields(df: DataFrame, known: list[str]) -> list[str]:
    return [c for c in df.columns if c not in known]


def normalize(df: DataFrame, deprecated: tuple[str, ...] = (), renamed: dict[str, str] | None = None, defaults: dict | None = None) -> DataFrame:
    """Columns with a deprecated prefix go, old names become new ones, nulls become defaults."""
    df = df.drop(*(c for c in df.columns if c.startswith(deprecated))) if deprecated else df
    df = df.withColumnsRenamed(renamed or {})
    return df.fillna({k: x for k, x in (defaults or {}).items() if k in df.columns})


# Preset, share of covered cells that is aimed at, lowest value.
PRESETS = [("default", 0.2, 0.0), ("river_valley", 0.3, -500.0), ("hills", 0.1, 2500.0)]


def presets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRESETS, "preset string, band double, low double")


def under_presets(df: DataFrame, rows: DataFrame, value: str = "v") -> DataFrame:
    """Rows under each preset whose lowest value they reach; presets are a handful of rows."""
    return df.join(F.broadcast(rows), F.col(value) >= F.col("low"))


def read_trace_logs(spark: SparkSession, path: str, schema: T.StructType, lines: bool = False) -> DataFrame:
    """Trace logs (a file each, or one per line) with their file's name, size and time, newest first."""
    t = spark.read.schema(schema).option("multiLine", not lines).json(path)
    t = t.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_size").alias("file_size"), F.col("_metadata.file_modification_time").alias("modified"))
    return t.orderBy(F.desc("modified"), "file_name")


def explode_traces(logs: DataFrame, traces: str = "traces", steps: str = "steps") -> tuple[DataFrame, DataFrame]:
    """(traces, steps): one row per trace, and per step with its place from 0."""
    each = logs.select("file_name", F.posexplode(traces).alias("trace_no", "trace"))
    flat = each.select("file_name", "trace_no", "trace.*")
    return flat.drop(steps), flat.select("file_name", "trace_no", "trace_id", F.posexplode(steps).alias("step_no", "step")).select("file_name", "trace_no", "trace_id", "step_no", "step.*")


def parse_event_stream(df: DataFrame, body: str) -> DataFrame:
    """(.., frame, event, data): frames of text/event-stream bodies; comments are skipped, data lines joined."""
    rest = [c for c in df.columns if c != body]
    plain = F.regexp_replace(F.col(body), "\r\n?", "\n")
    t = df.select(*rest, F.posexplode(F.split(plain, "\n\n")).alias("frame", "block"))
    lines = F.split("block", "\n")
    of = lambda name: F.transform(F.filter(lines, lambda x: x.startswith(f"{name}:")), lambda x: F.regexp_replace(x, f"^{name}: ?", ""))
    t = t.withColumn("data", F.array_join(of("data"), "\n")).withColumn("event", F.coalesce(F.try_element_at(of("event"), F.lit(-1)), F.lit("message")))
    return t.where(F.size(of("data")) > 0).select(*rest, "frame", "event", "data")
