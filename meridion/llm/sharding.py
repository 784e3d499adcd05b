"""Shards of bounded bytes by extendible hashing (operator 8).

The directory is indexed by prefixes of a 60-bit digest of the document's id.  A bucket is split on one more bit only
while its rows take more bytes than the limit, so a shard is the shortest prefix whose rows fit.  Bytes are summed once
per cell of a few more bits than the shards need, and the directory is worked out on those sums; rows are looked at
again only in cells that are still too large.  Rows that share the whole digest (repeats of one id) go on being split,
on a digest of their text.  What is equal even then, or is one row over the limit, is a shard that says it does not fit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.session import materialize, table

SHARD_BYTES = 256 << 10
#: Bytes that a row takes besides its text.
ROW_BYTES = 64
DIGEST_BITS = 60
#: Bits that a pass over the rows adds.
STEP_BITS = 14


def _digest(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, DIGEST_BITS // 4), 16, 10).cast("long")


def _prefix(digest: Column, depth: int) -> Column:
    return F.shiftright(digest, DIGEST_BITS - depth)


def _grow(rows: DataFrame, limit: int, first_bits: int, step_bits: int) -> DataFrame:
    """(family, depth, prefix, bytes, docs): the shards of ``rows`` (family, digest, size), each family by itself."""
    done, base, top, left = None, 0, min(DIGEST_BITS, first_bits), rows
    while True:
        cells = materialize(left.groupBy("family", _prefix(F.col("digest"), top).alias("cell")).agg(F.sum("size").alias("bytes"), F.count("*").alias("docs")))
        each = cells.select("family", "cell", "bytes", "docs", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth"))
        sums = each.groupBy("family", "depth", F.expr(f"shiftright(cell, {top} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        sums = materialize(sums)
        large = sums.where(F.col("bytes") > limit)
        parents = large.select("family", (F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        end = F.col("bytes") <= limit if top < DIGEST_BITS else (F.col("bytes") <= limit) | (F.col("depth") == DIGEST_BITS)
        halves = sums.where(end & (F.col("depth") > base)).withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["family", "depth", "parent"], "left_semi")
        shards = halves.select("family", "depth", "prefix", "bytes", "docs")
        if not base:  # all rows fit one shard
            shards = shards.unionByName(sums.where((F.col("depth") == 0) & (F.col("bytes") <= limit)))
        done = shards if done is None else done.unionByName(shards)
        still = large.where(F.col("depth") == top).select("family", F.col("prefix").alias("cell"))
        if top == DIGEST_BITS or still.isEmpty():
            return materialize(done)
        left = left.withColumn("cell", _prefix(F.col("digest"), top)).join(still, ["family", "cell"], "left_semi").drop("cell")
        base, top = top, min(DIGEST_BITS, top + step_bits)


def _place(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """Each row meets the shards below its prefix of the smallest depth there is, and lies in one of them."""
    least = shards.agg(F.min("depth")).head()[0] or 0
    near = shards.select(F.col("family"), F.expr(f"shiftright(prefix, depth - {least})").alias("near"), "depth", "prefix", F.col("bytes").alias("shard_bytes"))
    inside = F.expr(f"shiftright(digest, {DIGEST_BITS} - depth) = prefix")
    keyed = rows.withColumn("near", _prefix(F.col("digest"), least)).alias("r")
    on = (F.col("r.family") == F.col("s.family")) & (F.col("r.near") == F.col("s.near")) & inside
    return keyed.join(near.alias("s"), on).select("r.row", "r.size", "r.family", "depth", "prefix", "shard_bytes")


def shard(docs: DataFrame, limit: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", row_bytes: int = ROW_BYTES, step_bits: int = STEP_BITS) -> DataFrame:
    """(row, size, shard, depth, shard_bytes, fits): each row of ``docs`` with its shard.

    ``shard`` is the prefix, as bits.  A null id is hashed as the empty text; a null text takes only ``row_bytes``;
    equal rows share a shard, which may then not fit; an empty table gives an empty one.  The row is kept in a struct
    of its own, so no column name can clash.
    """
    key, text = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), (F.octet_length(text).cast("long") + row_bytes).alias("size"), F.lit(0).cast("long").alias("family"), _digest(key).alias("digest"), text.alias("t")
    )
    total = rows.agg(F.sum("size")).head()[0] or 0
    wanted = max(1, math.ceil(math.log2(max(1.0, total / limit))) + 3)
    found = _grow(rows.select("family", "digest", "size"), limit, wanted, step_bits)
    stuck = found.where((F.col("depth") == DIGEST_BITS) & (F.col("bytes") > limit) & (F.col("docs") > 1)).select(F.col("prefix").alias("digest"))
    bits = lambda: F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    out = _place(rows, found)
    if not stuck.isEmpty():
        second = rows.join(stuck, "digest", "left_semi").select("row", "size", F.col("digest").alias("family"), _digest(F.col("t")).alias("digest"))
        deeper = _grow(second.select("family", "digest", "size"), limit, STEP_BITS, step_bits)
        apart = F.concat(F.expr(f"lpad(bin(family), {DIGEST_BITS}, '0')"), bits())
        below = _place(second, deeper).withColumn("shard", apart).withColumn("depth", F.col("depth") + DIGEST_BITS)
        met = found.join(stuck, (found["depth"] == DIGEST_BITS) & (found["prefix"] == stuck["digest"]), "left_anti")
        out = _place(rows, met).withColumn("shard", bits()).unionByName(below)
    else:
        out = out.withColumn("shard", bits())
    return out.select("row", "size", "shard", "depth", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "size", "shard", F.col("depth").cast("long").alias("depth"), "shard_bytes", "fits")


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, (coalesce(strlen(text), 0) + {ROW_BYTES})::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS digest FROM documents),
p AS (SELECT *, digest >> ({DIGEST_BITS} - depth) AS prefix FROM (SELECT *, unnest(range(0, 31)) AS depth FROM d)),
s AS (SELECT depth, prefix, sum(size)::BIGINT AS bytes, count(*) AS docs FROM p GROUP BY ALL),
f AS (SELECT p.*, s.bytes, row_number() OVER (PARTITION BY rid ORDER BY p.depth) AS k FROM p JOIN s USING (depth, prefix) WHERE s.bytes <= {SHARD_BYTES})
SELECT doc_id, size, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::BIGINT AS depth, bytes AS shard_bytes, true AS fits FROM f WHERE k = 1
"""
