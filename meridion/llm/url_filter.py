"""URL filters by a sort-merge range join (operator 7).

A host is turned round into the key ``net.example.www.``, so that a rule's host and all its subdomains are one interval
of keys, and intervals are nested or apart.  Rules and urls are sorted together by key over range partitions; a sweep
over each partition keeps the stack of the rules whose interval is open, innermost last, and looks the url's path up in
it.  A rule whose interval began in an earlier partition is copied to the head of each partition that begins inside it:
those are the rules at the labels of the partition's first key, so there are few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridion.session import materialize, table

# Fixed values of the contract: (host, path, allowed).
RULES = [("net", "/", False), ("example.net", "/en/", True), ("example.com", "/de/", False), ("org", "/fr/", True)]
DEFAULT = "allow"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _CAPITALS, _CAPITALS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


class _Stack:
    """Open rules, a level per host: (key, host, verdicts by path, lengths of those paths)."""

    def __init__(self):
        self.levels: list[tuple[str, str, dict[str, bool], set[int]]] = []

    def close(self, key: str) -> None:
        while self.levels and not key.startswith(self.levels[-1][0]):
            self.levels.pop()

    def open(self, key: str, host: str, path: str, allowed: bool) -> None:
        if not self.levels or self.levels[-1][0] != key:
            self.levels.append((key, host, {}, set()))
        _, _, verdicts, lengths = self.levels[-1]
        verdicts[path] = verdicts.get(path, True) and allowed
        lengths.add(len(path))

    def find(self, path: str) -> tuple[str | None, bool | None]:
        best, size = (None, None), -1
        for _, host, verdicts, lengths in reversed(self.levels):
            for n in lengths:
                if len(host) + n > size and n <= len(path) and path[:n] in verdicts:
                    best, size = (host + path[:n], verdicts[path[:n]]), len(host) + n
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, stack = None, _Stack()
    for b in batches:
        rules, verdicts, urls = [], [], []
        columns = (b.column(c).to_pylist() for c in ("bucket", "is_url", "key", "host", "path", "allowed"))
        for k, (at, is_url, key, host, path, allowed) in enumerate(zip(*columns, strict=True)):
            if at != bucket:
                bucket, stack = at, _Stack()
            stack.close(key)
            if is_url:
                rule, verdict = stack.find(path)
                urls.append(k)
                rules.append(rule)
                verdicts.append(DEFAULT if verdict is None else "allow" if verdict else "block")
            else:
                stack.open(key, host, path, allowed)
        kept = pa.array(urls, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(kept) for c in ("row", "host", "path")), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], ["row", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(row, host, path, rule, verdict): each row of ``pages`` under the longest rule that fits its url.

    ``rules``: (host, path, allowed).  A rule fits its host and all subdomains if the url's path starts with the
    rule's; the longest (host and path) wins, of equally long ones the one with the longer host, and of the same rule
    given twice ``block``.  No rule: ``allow``.  A null url, or one without ``://``, has an empty host and path and
    fits no rule; rules without a host or path or verdict are not used; repeated rows are judged each; empty tables
    give their natural results.  The row is kept in a struct of its own, so no column name can clash.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in pages.columns))
    url = F.col(f"`{url_col}`")
    urls = pages.select(row.alias("row"), host_of(url).alias("host"), path_of(url).alias("path"))
    urls = urls.select("row", _key(F.col("host")).alias("key"), F.lit(True).alias("is_url"), "host", "path", F.lit(None).cast("boolean").alias("allowed"))
    usable = rules.where("host is not null and host <> '' and path is not null and allowed is not null")
    events = usable.select(F.lit(None).cast(urls.schema["row"].dataType).alias("row"), _key(F.col("host")).alias("key"), F.lit(False).alias("is_url"), "host", "path", "allowed")
    order = ["key", "is_url", "path", F.xxhash64("row")]  # the last spreads a url that is there many times
    dealt = urls.unionByName(events).repartitionByRange(*order).withColumn("bucket", F.spark_partition_id())
    dealt = materialize(dealt)
    first = dealt.where("is_url").groupBy("bucket").agg(F.min("key").alias("first"))
    labels = F.split(F.expr("left(first, length(first) - 1)"), r"\.")
    heads = first.select(F.col("bucket").alias("to"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("key"))
    carried = dealt.where("not is_url").join(heads, "key").where(F.col("bucket") < F.col("to")).drop("bucket").withColumnRenamed("to", "bucket")
    swept = dealt.unionByName(carried).repartition("bucket").sortWithinPartitions("bucket", "key", "is_url", "path")
    schema = T.StructType([urls.schema["row"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict"))])
    return swept.mapInArrow(_sweep, schema)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, allowed boolean")
    out = judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return out.select("row.page_id", "host", "path", "rule", "verdict")


OP7_SQL = f"""
WITH r(host, path, allowed) AS (VALUES {", ".join(f"('{h}', '{p}', {a})" for h, p, a in RULES)}),
u AS (SELECT row_number() OVER () AS rid, page_id,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_CAPITALS}', '{_CAPITALS.lower()}'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
m AS (SELECT u.*, r.host || r.path AS rule, r.allowed, row_number() OVER (PARTITION BY rid ORDER BY length(r.host || r.path) DESC NULLS LAST, length(r.host) DESC) AS k
      FROM u LEFT JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
SELECT page_id, host, path, rule, CASE WHEN allowed IS NULL OR allowed THEN 'allow' ELSE 'block' END AS verdict FROM m WHERE k = 1
"""
