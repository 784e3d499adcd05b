"""Mixing sources to target weights by Pfair scheduling (operator 2).

The documents of a source, in the order of a digest of their ids, are one stream of bytes, which is cut into blocks of
BLOCK_BYTES; a document belongs to the block in which it begins.  With weight p of Q, block i (from 1) of a source is
released at slot floor((i - 1) * Q / p) and due at slot ceil(i * Q / p); each slot takes the released block that is due
first.  As the weights add up to Q, every block meets its window, so that after any number of slots a source has had
less than one block more or less than its share.  The schedule repeats after Q slots, so only Q slots are ever worked
out; where a block falls follows from its number by arithmetic.

A source whose blocks run out starts again with its first one, MAX_EPOCHS times at most; then it leaves, and its slots
stay empty, so that nothing changes between the others.  The mix ends with the slot by which every source has been
through all of its blocks: no document is left out, and none comes more than MAX_EPOCHS times.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from meridion.session import table

#: Slots of a period, at least; also the unit of the weights.  With many sources there are SLOTS_A_SOURCE for each.
PERIOD, SLOTS_A_SOURCE = 1000, 8
BLOCK_BYTES = 64 << 10
MAX_EPOCHS = 4
#: Documents that are numbered together, on average.
NUMBERED = 500
#: Slots of a schedule that is sent to all tasks; a longer one is joined by shuffles.
SENT_SLOTS = 1 << 16
_DIGEST_BITS = 48


def target_weights(sizes: DataFrame, period: int = PERIOD) -> DataFrame:
    """(site, bytes, weight): integer weights of sum ``period`` that follow the sources' bytes to the power 7/8.

    The power favours small sources a little.  It is made of square roots of whole KiB, which engines round alike; it is
    cut to thousandths; each source has one slot at least, and what rounding leaves goes to the largest source (the
    first by name among equals).  One row per source is looked at in one task, as by the schedule.
    """
    everything = Window.partitionBy()
    half = F.sqrt(1 + F.floor(F.col("bytes") / 1024))
    root = F.floor(half * F.sqrt(half) * F.sqrt(F.sqrt(half)) * 1000).cast("long")
    t = sizes.withColumn("root", root).withColumn("sources", F.count("*").over(everything)).withColumn("roots", F.sum("root").over(everything))
    t = t.withColumn("share", F.lit(1).cast("long") + F.floor((F.lit(period) - F.col("sources")) * F.col("root") / F.col("roots")).cast("long"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("bytes"), F.asc_nulls_first("site")))
    left = F.lit(period).cast("long") - F.sum("share").over(everything)
    return t.withColumn("weight", F.col("share") + F.when(rank == 1, left).otherwise(0)).select("site", "bytes", "weight")


def _edf(period: int):
    """One period, slot by slot: the released block with the earliest deadline, ties to the smaller source number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = pd.concat(batches)
        weights = dict(sorted(zip(weights["number"].tolist(), weights["weight"].tolist(), strict=True)))
        done, ready, rows = dict.fromkeys(weights, 0), [], []
        released = {0: list(weights)}
        for slot in range(period if weights else 0):
            for s in released.pop(slot, []):
                heapq.heappush(ready, (-(-(done[s] + 1) * period // weights[s]), s))
            _, s = heapq.heappop(ready)
            rows.append((s, done[s], slot))
            done[s] += 1
            if done[s] < weights[s]:
                released.setdefault(max(slot + 1, done[s] * period // weights[s]), []).append(s)
        yield pd.DataFrame(rows, columns=["number", "turn", "slot"]).astype("int64")

    return run


def period_schedule(weights: DataFrame, period: int = PERIOD) -> DataFrame:
    """(site, bytes, weight, turn, slot): for each source its turns within a period; ``period`` rows in all."""
    numbered = weights.withColumn("number", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("site"))).cast("long"))
    slots = numbered.select("number", "weight").coalesce(1).mapInPandas(_edf(period), "number long, turn long, slot long")
    return slots.join(numbered, "number").select("site", "bytes", "weight", "turn", "slot")


def _given(sizes: DataFrame, weights: DataFrame, period: int) -> DataFrame:
    """Weights from outside, after they have been looked through."""
    given = weights.select(F.col("site").alias("w_site"), F.col("weight").cast("long").alias("weight"))
    met = sizes.join(given, F.col("site").eqNullSafe(F.col("w_site")), "left").select("site", "bytes", "weight")
    n, total, bad, rows = met.agg(F.count("*"), F.sum("weight"), F.count_if(F.coalesce(F.col("weight") < 1, F.lit(True))), F.count_distinct(F.struct("site"))).head()
    if n and (bad or n != rows or total != period):
        raise ValueError(f"each of {rows} sources needs one whole weight of 1 or more and all of them a sum of {period}; {bad} have none and the sum is {total}")
    return met


def mix(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: DataFrame | None = None, period: int | None = None,
    block_bytes: int = BLOCK_BYTES, max_epochs: int = MAX_EPOCHS, numbered: int = NUMBERED, sent_slots: int = SENT_SLOTS,
) -> DataFrame:
    """(row, site, block, epoch, slot, place): each row of ``docs`` as often as the mix takes it.

    ``block`` is the block's number within its source (from 0), ``epoch`` how often the source had been used up
    before, ``slot`` the block's place in the mix and ``place`` the byte of the block at which the row begins; a text
    counts one byte more than it has, so that no two rows begin together, and one longer than a block runs on through
    the next ones.  ``weights``: (site, weight) with integers of sum ``period``, one for each source, else ValueError;
    if not given, target_weights().  A null source is a source of its own; a null text is empty; rows with a null id
    and repeated rows are taken like others (equal digests by the row's hash); an empty table gives an empty mix.  The
    row is kept in a struct of its own, so no column name can clash.  There can be any number of sources: the period
    grows with it, and one task works it out.
    """
    size = (F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))) + 1).cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{source_col}`").cast("string").alias("site"), F.col(f"`{id_col}`").cast("string").alias("key"), size.alias("size"))
    sizes = rows.groupBy("site").agg(F.sum("size").alias("bytes"), F.count("*").alias("docs"))
    n_docs, n_sites = sizes.agg(F.sum("docs"), F.count("*")).head()
    sizes = sizes.select("site", "bytes")
    period = period or max(PERIOD, SLOTS_A_SOURCE * n_sites)
    # Digest ranges, by first bits, so that a source of any size is numbered by many tasks.
    bits = min(_DIGEST_BITS, max(0, -(-(n_docs or 0) // numbered) - 1).bit_length())
    digest = F.md5(F.coalesce("key", F.lit("")))
    head = F.conv(F.substring(digest, 1, _DIGEST_BITS // 4), 16, 10).cast("long")
    # A name that is never null, so that the join by it finds the rows dealt as the window left them: rows are dealt once.
    named = F.when(F.col("site").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("site")))
    # The hash is taken before, so that the columns of a row that nobody asks for need not be dealt.
    rows = rows.select("row", "site", named.alias("named"), "key", "size", digest.alias("digest"), F.xxhash64("row").alias("hash"), F.shiftright(head, _DIGEST_BITS - bits).alias("range"))
    by_range = rows.groupBy("named", "range").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select("named", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    up_to_here = F.sum("size").over(Window.partitionBy("named", "range").orderBy("digest", F.asc_nulls_first("key"), "hash").rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("within", up_to_here - F.col("size")).join(offsets, ["named", "range"])
    at = F.col("before") + F.col("within")
    placed = placed.select("row", "site", F.floor(at / block_bytes).cast("long").alias("block"), (at % block_bytes).cast("long").alias("place"))

    weighed = target_weights(sizes, period) if weights is None else _given(sizes, weights, period)
    sent = F.broadcast if period <= sent_slots else lambda small: small
    schedule = period_schedule(weighed, period).withColumn("blocks", F.ceil(F.col("bytes") / block_bytes).cast("long"))
    # The slot of a source's last block is in its last turn, and a turn is one slot of the period.
    last = F.col("blocks") - 1
    ending = schedule.where(F.col("turn") == last % F.col("weight")).agg((F.max(F.floor(last / F.col("weight")).cast("long") * period + F.col("slot")) + 1).alias("end"))
    in_part = F.count_if(F.col("slot") < F.col("end") % period)
    taken = F.least(F.floor(F.col("end") / period).cast("long") * F.col("weight") + F.col("in_part"), F.col("blocks") * max_epochs)
    sources = schedule.crossJoin(F.broadcast(ending)).groupBy("site", "weight", "blocks", "end").agg(in_part.alias("in_part"))  # one row is sent
    sources = sources.select(F.col("site").alias("s_site"), "weight", "blocks", taken.alias("taken"))
    met = placed.join(sent(sources), F.col("site").eqNullSafe(F.col("s_site")))
    # Passes of the source that reach this block: block + epoch * blocks < taken.
    epochs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1 - F.col("block")) / F.col("blocks")).cast("long"))
    each = met.withColumn("epoch", F.explode(epochs)).withColumn("i", F.col("block") + F.col("epoch") * F.col("blocks")).withColumn("turn", F.col("i") % F.col("weight"))
    turns = schedule.select(F.col("site").alias("t_site"), F.col("turn").alias("t_turn"), F.col("slot").alias("t_slot"))
    each = each.join(sent(turns), F.col("site").eqNullSafe(F.col("t_site")) & (F.col("turn") == F.col("t_turn")))
    slot = F.floor(F.col("i") / F.col("weight")).cast("long") * period + F.col("t_slot")
    return each.select("row", "site", "block", "epoch", slot.alias("slot"), "place")


def op2_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("row.doc_id", F.col("site").alias("source"), "block", "epoch", "slot", "place")


OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, strlen(coalesce(text, '')) + 1 AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
z AS (SELECT source, sum(size)::BIGINT AS bytes, sqrt(1 + sum(size)::BIGINT // 1024) AS half FROM d GROUP BY source),
c AS (SELECT source, bytes, floor(half * sqrt(half) * sqrt(sqrt(half)) * 1000)::BIGINT AS root FROM z),
q AS (SELECT greatest({PERIOD}, {SLOTS_A_SOURCE} * count(*))::BIGINT AS q FROM c),
s AS (SELECT *, 1 + floor((q - (SELECT count(*) FROM c)) * root / (SELECT sum(root)::BIGINT FROM c))::BIGINT AS share FROM c, q),
w AS (SELECT source, bytes, row_number() OVER (ORDER BY source NULLS FIRST) AS number, ceil(bytes / {BLOCK_BYTES}.0)::BIGINT AS blocks,
             share + CASE WHEN row_number() OVER (ORDER BY bytes DESC, source NULLS FIRST) = 1 THEN q - (SELECT sum(share)::BIGINT FROM s) ELSE 0 END AS weight FROM s),
p AS (SELECT list(weight::BIGINT ORDER BY number) AS p FROM w),
e(slot, pick, done) AS (
  SELECT -1::BIGINT, 0::BIGINT, list_transform(p, lambda x: 0::BIGINT) FROM p
  UNION ALL
  SELECT slot, pick, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END) FROM (
    SELECT e.slot + 1 AS slot, e.done, list_min(list_filter(list_transform(range(1, len(p.p) + 1),
        lambda i: CASE WHEN e.done[i] < p.p[i] AND (e.done[i] * q) // p.p[i] <= e.slot + 1
                       THEN (((e.done[i] + 1) * q + p.p[i] - 1) // p.p[i]) * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
    FROM e, p, q WHERE e.slot + 1 < q)),
t AS (SELECT pick AS number, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS turn FROM e WHERE slot >= 0),
r AS (SELECT max(((blocks - 1) // weight) * q + t.slot) + 1 AS finish FROM q, w JOIN t ON t.number = w.number AND t.turn = (blocks - 1) % weight),
i AS (SELECT doc_id, source, (sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS i FROM d),
b AS (SELECT i.doc_id, i.source, i // {BLOCK_BYTES} AS block, i % {BLOCK_BYTES} AS place, w.number, w.weight, w.blocks,
             least((r.finish // q) * w.weight + (SELECT count(*) FROM t WHERE t.number = w.number AND t.slot < r.finish % q), w.blocks * {MAX_EPOCHS}) AS taken
      FROM i JOIN w ON i.source IS NOT DISTINCT FROM w.source, r, q),
x AS (SELECT *, unnest(range(0, (taken - 1 - block) // blocks + 1)) AS epoch FROM b)
SELECT x.doc_id, x.source, x.block::BIGINT AS block, x.epoch::BIGINT AS epoch,
       (((x.block + x.epoch * x.blocks) // x.weight) * q + t.slot)::BIGINT AS slot, x.place::BIGINT AS place
FROM q, x JOIN t ON t.number = x.number AND t.turn = (x.block + x.epoch * x.blocks) % x.weight
"""
