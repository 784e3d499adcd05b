"""SimHash near-duplicates by pigeonhole blocks (operator 5).

A fingerprint of 64 bits is split into ``radius + 2`` blocks.  Two fingerprints that differ in at most ``radius``
bits agree in at least two whole blocks, so each pair of blocks is a join key, and every candidate's Hamming
distance is verified.  Copies count once: the join is over distinct fingerprints.

A key that more than ``PAIR_LIMIT`` fingerprints share is not joined with itself.  There two fingerprints within
``radius`` bits are linked through the values between them: each one files itself under every value at most
``radius // 2`` bits (and, for an odd radius, one more) from the part outside the key, and whoever meets under a
value is close.  This finds the same components with rows in proportion to the group.

``near_copies`` is the same search for edited copies, which 3-word shingles put many bits apart: the candidates come
from a fingerprint of single words (an edit changes few of them) within WORD_RADIUS bits, and a pair is kept if the
fingerprints of shingles are within CHECK_RADIUS bits too, as those of unrelated texts in one language never are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridion.operators.components import connected_components
from meridion.session import materialize, table

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints under one key that are still compared pair by pair.
PAIR_LIMIT = 24
#: Of ``near_copies``: bits between fingerprints of words and of shingles, blocks in a key, fingerprints under one key
#: that are joined, and those of a larger key that are compared at a time.
WORD_RADIUS, CHECK_RADIUS = 6, 12
KEY_BLOCKS = 3
JOINED, COMPARED = 32, 2048


def _fingerprint(words: list[bytes], size: int, digest) -> int:
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)]
    total, done, block = np.zeros(64, np.int64), 0, []
    hashes = np.fromiter((digest(s, SEED) for s in joined), np.uint64, n)
    while done < n:  # bits of a bounded number of shingles at a time
        block = hashes[done : done + 65536]
        total += np.unpackbits(block.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        done += len(block)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            texts = b.column("text").to_pylist()
            # bytes.lower() maps A-Z only; bytes.split() cuts at 09-0D and 20 only.
            out = [_fingerprint(t.encode().lower().split(), size, digest) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.int64())], ["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each whole text as a signed long; a null text counts as empty."""
    ddl = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), f"id {ddl}, fp long")


def _blocks(count: int) -> list[tuple[int, int]]:
    """(shift, width) of each block."""
    cuts = [64 * k // count for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def _mask(blocks: list[tuple[int, int]]) -> int:
    return sum(((1 << w) - 1) << s for s, w in blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keyed(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, part, key): the key holds the bits of two blocks."""
    pairs = list(combinations(_blocks(radius + 2), 2))
    keys = F.array(*(F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(list(p))))).alias("key")) for i, p in enumerate(pairs)))
    return fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.part", "k.key")


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _between(radius: int) -> Column:
    """The masks of at most radius // 2 bits (rounded up) outside the key of a part."""
    steps = (radius + 1) // 2
    out = []
    for p in combinations(_blocks(radius + 2), 2):
        free = [i for i in range(64) if not _mask(list(p)) >> i & 1]
        masks = [0, *(_signed(sum(1 << i for i in c)) for k in range(1, steps + 1) for c in combinations(free, k))]
        out.append(F.array(*map(F.lit, masks)))
    return F.array(*out)


def links(fps: DataFrame, radius: int = RADIUS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(u, v): edges between the distinct fingerprints of ``fps`` whose components are those of all pairs within ``radius``."""
    keyed = _keyed(fps, radius)
    shared = keyed.groupBy("part", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(keyed.join(shared, ["part", "key"]))
    few, many = met.where(F.col("n") <= pair_limit), met.where(F.col("n") > pair_limit)
    other = few.select("part", "key", F.col("fp").alias("other"))
    near = few.join(other, ["part", "key"]).where(F.col("fp") < F.col("other")).where(_distance(F.col("fp"), F.col("other")) <= radius)
    pairs = near.select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if radius % 2 == 0:
        filed = many.select("fp", F.explode(_between(radius)[F.col("part")]).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"))
        # Two under one value differ from it in radius / 2 bits at most each, so they are close.
        first = filed.groupBy("value").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1")
        stars = filed.join(first, "value").where("fp <> v").select(F.col("fp").alias("u"), "v")
    else:
        # An odd radius: a value at distance (radius + 1) / 2 of one and (radius - 1) / 2 of the other.
        filed = many.select("fp", F.explode(_between(radius)[F.col("part")]).alias("m")).select(
            "fp", F.col("fp").bitwiseXOR(F.col("m")).alias("value"), (F.bit_count("m") <= radius // 2).alias("close")
        )
        first = filed.where("close").groupBy("value").agg(F.min("fp").alias("v"))
        stars = filed.join(first, "value").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionByName(stars.distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(id, fp, component_id): for each row the smallest id that can be reached over links, its own included.

    A null text counts as empty; texts without a word all have fingerprint 0 and are one group.  A row with a null
    id takes part in links, keeps its null id, and is never the smallest; its component is null only if no row of
    the group has an id.  Repeated rows give repeated rows.  An empty table gives an empty one.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle))
    first = materialize(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    grouped = connected_components(links(first.select("fp"), radius, pair_limit))
    of = first.join(grouped.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(least, "component").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _word_fingerprint(words: list[bytes], digest) -> int:
    """Different words, weighted by the length of their counts in bits."""
    if not words:
        return 0
    counts = Counter(words)
    hashes = np.fromiter((digest(w, SEED) for w in counts), np.uint64, len(counts))
    weights = np.fromiter((n.bit_length() for n in counts.values()), np.int64, len(counts))
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # bits of a bounded number of words at a time
        total += weights[at : at + 65536] @ np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(total * 2 > weights.sum(), bitorder="little").view("<i8")[0])


def _both_fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            texts = [t.encode().lower().split() for t in b.column("text").to_pylist()]
            fps = [pa.array(list(f), pa.int64()) for f in ((_word_fingerprint(t, digest) for t in texts), (_fingerprint(t, size, digest) for t in texts))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *fps], ["id", "fp", "shingles"])

    return run


def _forest(radius: int, check: int):
    """Links that join what is close within one block of a key, or between two: a star for each component.

    Rows that have the same ``comp`` already are joined from the start.
    """

    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("side").to_numpy()
        comp, fp, shingles = (np.concatenate([np.array(x, np.int64) for x in rows.column(c).to_pylist()]) for c in ("comps", "fps", "checks"))
        fp, shingles = fp.view(np.uint64), shingles.view(np.uint64)  # bits of a negative number are those of its absolute value
        lens = [len(x) for x in rows.column("comps").to_pylist()]
        of = np.repeat(side, lens)
        order = np.argsort(comp, kind="stable")
        comp, fp, shingles, of = comp[order], fp[order], shingles[order], of[order]
        names, first = np.unique(comp, return_index=True)
        last = np.append(first[1:], len(comp))
        number = np.repeat(np.arange(len(names)), last - first)
        left, u, v = np.ones(len(names), bool), [], []
        for root in range(len(names)):
            if not left[root]:
                continue
            left[root], reached = False, [root]
            for c in reached:  # grows
                for k in range(first[c], last[c]):
                    rest = np.nonzero(left[number])[0]
                    if not len(rest):
                        break
                    met = (np.bitwise_count(fp[rest] ^ fp[k]) <= radius) & (np.bitwise_count(shingles[rest] ^ shingles[k]) <= check)
                    if len(lens) > 1:  # pairs inside a block are compared elsewhere
                        met &= of[rest] != of[k]
                    found = np.unique(number[rest[met]])
                    left[found] = False
                    reached.extend(found.tolist())
            u += [int(names[root])] * (len(reached) - 1)
            v += names[reached[1:]].tolist()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _parts(radius: int, blocks: int) -> tuple[list[int], list[int]]:
    """Masks of the keys: the first ones, which find most links, and all others.

    With nine blocks on a three by three grid the first ones are its lines, and any five blocks hold a line: the first
    keys find every pair within four bits.
    """
    cut, first, other = _blocks(radius + blocks), [], []
    for c in combinations(range(radius + blocks), blocks):
        line = sum(k // blocks for k in c) % blocks == 0 and sum(k % blocks for k in c) % blocks == 0
        (first if line else other).append(_signed(_mask([cut[k] for k in c])))
    return first, other


def _wide_links(nodes: DataFrame, masks: list[int], radius: int, check: int, joined: int, compared: int) -> DataFrame:
    """(u, v): links between different ``comp`` of ``nodes`` (node, fp, shingles, comp) by the keys of some masks."""
    mask = F.posexplode(F.array(*map(F.lit, masks))).alias("part", "mask")
    keyed = nodes.select("node", "comp", "fp", mask).select("node", "comp", F.xxhash64("part", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    # Keys of one row, or of rows that are joined already, have nothing to add.
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a < b").select("key", "n")
    met = materialize(keyed.select("node", "key").join(shared, "key").join(nodes, "node"))
    few = met.where(F.col("n") <= joined)
    other = few.select("key", *(F.col(c).alias(f"o_{c}") for c in ("comp", "fp", "shingles")))
    near = (_distance(F.col("fp"), F.col("o_fp")) <= radius) & (_distance(F.col("shingles"), F.col("o_shingles")) <= check)
    pairs = few.join(other, "key").where(near & (F.col("comp") < F.col("o_comp"))).select(F.col("comp").alias("u"), F.col("o_comp").alias("v"))
    many = met.where(F.col("n") > joined).withColumn("of", F.ceil(F.col("n") / compared))
    many = many.withColumn("block", F.pmod(F.xxhash64("node"), F.col("of")))
    lists = (F.collect_list(c).alias(name) for c, name in (("comp", "comps"), ("fp", "fps"), ("shingles", "checks")))
    packed = many.groupBy("key", "block", "of").agg(*lists)  # about ``compared`` rows each
    each = packed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("with"))
    each = each.select("key", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), F.col("block").alias("side"), "comps", "fps", "checks")
    forest = each.groupBy("key", "a", "b").applyInArrow(_forest(radius, check), "u long, v long")
    return pairs.unionByName(forest).distinct()


def wide_components(nodes: DataFrame, radius: int = WORD_RADIUS, check: int = CHECK_RADIUS, blocks: int = KEY_BLOCKS, joined: int = JOINED, compared: int = COMPARED) -> DataFrame:
    """(node, comp): the component of each of ``nodes`` (node, fp, shingles) under links between close pairs.

    Of ``radius + blocks`` blocks two close fingerprints share ``blocks``, which make a key.  Rows under a key that
    more than ``joined`` share are compared in blocks of ``compared`` rows, each of which gives a forest of links
    instead of its pairs.  The first keys find nearly all; the others look for links between components only, so that
    a large group of copies is not linked again under each of its keys.
    """
    nodes = nodes.withColumn("comp", F.col("node"))
    for masks in _parts(radius, blocks):
        if masks:
            grouped = connected_components(_wide_links(nodes, masks, radius, check, joined, compared)).withColumnsRenamed({"node": "comp", "component": "new"})
            nodes = materialize(nodes.join(grouped, "comp", "left").select("node", "fp", "shingles", F.coalesce("new", "comp").alias("comp")))
    return nodes.select("node", "comp")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = WORD_RADIUS, check: int = CHECK_RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(id, component_id): for each row the smallest id among the copies and edited copies it is linked to, its own included.

    Nulls, empty texts, repeated rows and empty tables are taken as by ``near_duplicates``; a text of any length counts
    whole; other columns are not looked at.
    """
    ddl = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marked = materialize(rows.mapInArrow(_both_fingerprints(shingle), f"id {ddl}, fp long, shingles long"))
    nodes = materialize(marked.groupBy("fp", "shingles").agg(F.min("id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()))
    of = nodes.join(wide_components(nodes.drop("first_id"), radius, check), "node").select("fp", "shingles", "first_id", F.col("comp").alias("component"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = of.join(least, "component").select("fp", "shingles", "component_id")
    return marked.join(named, ["fp", "shingles"]).select(F.col("id").alias(id_col), "component_id")
