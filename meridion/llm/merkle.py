"""A Merkle manifest of a table: one tree per group, a tree over their roots, and a proof for every row (operator 13).

Method: a postorder append log.  Leaves are numbered within their tree and cut into aligned blocks of ``2 ** levels``.
A builder reads one block and appends each node as soon as it is complete, so its part of the log is the postorder
of the block's subtree, and it keeps no more than a node a level open.  Roots of blocks are the leaves of the next
band of blocks, until one block is left; roots of trees are the leaves of one more tree, built the same way.

Where a node stands in the log follows from sizes of subtrees alone: ``c`` whole leaves leave ``2 c - ones(c)`` nodes
behind them, and two siblings are as far apart as the right one's subtree is large.  A proof is read out of the log at
those positions, band by band from the top, so that a leaf is joined with one block of its own band only.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.session import ScratchTables, materialize, table

#: Leaves of a block as a power of two; its part of the log takes 64 KiB.
BLOCK_LEVELS = 10
_DIGEST = 32
# How a step of a path is made: alone, with the sibling before it, with the sibling behind it.
_ALONE, _BEFORE, _BEHIND = b"\0", b"\1", b"\2"


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, n - 1).bit_length()


def _zeros(n: int) -> int:
    return (n & -n).bit_length() - 1


def subtree_size(level: int, leaves: int) -> int:
    """Nodes of a subtree that is ``level`` high and has 1 to ``2 ** level`` leaves."""
    return 2 * leaves - leaves.bit_count() + level - _zeros(leaves)


def position(level: int, index: int, n: int) -> int:
    """Where the node stands in the postorder of a tree of ``n`` leaves, from 0."""
    end = (index + 1) << level
    if end <= n:  # all that ends before it, without the nodes above that end with it
        return 2 * end - end.bit_count() - (_zeros(end) - level) - 1
    return 2 * n - n.bit_count() + level - _zeros(n) - 1


def join_digests(*digests: bytes) -> bytes:
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def append_log(leaves: list[bytes], top: int) -> bytes:
    """The nodes of a subtree of ``top`` levels in the order in which they are complete."""
    log, open_nodes = [], []
    for node in leaves:
        level = 0
        log.append(node)
        while open_nodes and open_nodes[-1][0] == level:
            node, level = join_digests(open_nodes.pop()[1], node), level + 1
            log.append(node)
        open_nodes.append((level, node))
    level, node = open_nodes.pop()
    while level < top:  # the right edge is complete only now
        node = join_digests(open_nodes.pop()[1], node) if open_nodes and open_nodes[-1][0] == level else join_digests(node)
        level += 1
        log.append(node)
    return b"".join(log)


def path_of(log: bytes, index: int, n: int, top: int) -> bytes:
    """The steps from a leaf to the root of a block of ``n`` leaves, read out of its log."""
    at, steps = position(0, index, n), []
    for level in range(top):
        width, i = 1 << level, index >> level
        if i & 1:
            side, to = _BEFORE, at - subtree_size(level, min(width, n - i * width))
            at += 1
        elif (i + 1) * width < n:
            side, to = _BEHIND, at + subtree_size(level, min(width, n - (i + 1) * width))
            at = to + 1
        else:
            steps.append(_ALONE)
            at += 1
            continue
        steps.append(side + log[_DIGEST * to : _DIGEST * (to + 1)])
    return b"".join(steps)


def _steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    k = 0
    while k < len(path):
        side = path[k : k + 1]
        k += 1
        if side == _ALONE:
            yield side, b""
        else:
            yield side, path[k : k + _DIGEST]
            k += _DIGEST


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for side, other in _steps(path):
        leaf = join_digests(leaf) if side == _ALONE else join_digests(other, leaf) if side == _BEFORE else join_digests(leaf, other)
    return leaf


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Batches of sorted rows, one list for each value of ``keys``."""
    now, parts = None, []
    for b in batches:
        names = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for k in range(1, len(names) + 1):
            if k == len(names) or names[k] != names[start]:
                if names[start] != now:
                    if parts:
                        yield now, parts
                    now, parts = names[start], []
                parts.append(b.slice(start, k - start))
                start = k
    if parts:
        yield now, parts


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place among those of their tree in this partition."""
    last, n = None, 0
    for b in batches:
        places = []
        for t in b.column("tree").to_pylist():
            last, n = t, n + 1 if t == last else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], [*b.schema.names, "place"])


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``, their place in the order of their ``tree``, and its ``n`` rows.

    Rows are dealt by ranges, so that a tree with most of them is in many tasks; counts of ranges give the ranks.
    """
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("part", F.spark_partition_id())
    dealt = materialize(dealt)
    counts = dealt.groupBy("tree", "part").agg(F.count("*").alias("size"))
    by_tree = Window.partitionBy("tree")
    before = F.sum("size").over(by_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("tree", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(by_tree).alias("n"))
    placed = dealt.mapInArrow(_number, f"{_ddl(dealt)}, place long")
    return placed.join(starts, ["tree", "part"]).withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def _top(n: int, levels: int) -> int:
    return min(levels, height(n))


def _build(levels: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), parts in _groups(batches, ["tree", "block"]):
            leaves = [x for p in parts for x in p.column("digest").to_pylist()]
            n = parts[0].column("n")[0].as_py()
            log = append_log(leaves, _top(n, levels))
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block], pa.int64()), pa.array([n], pa.int64()), pa.array([len(leaves)], pa.int64()), pa.array([log], pa.binary())], ["tree", "block", "n", "leaves", "log"])

    return run


def build(leaves: DataFrame, levels: int = BLOCK_LEVELS, tables: ScratchTables | None = None) -> list[DataFrame]:
    """The log by bands from the leaves up: (tree, block, n, leaves, log), for ``leaves`` (tree, rank, n, digest).

    ``n``: nodes of the tree on the band's lowest level, ``leaves``: those of the block.  A tree is in as many bands as it
    needs; the last block of its last band ends with its root.
    """
    tables, bands = tables or ScratchTables(leaves.sparkSession), []
    while True:
        blocks = leaves.select("tree", F.shiftright("rank", levels).alias("block"), "rank", "n", "digest").repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        band = tables.put(blocks.mapInArrow(_build(levels), "tree string, block long, n long, leaves long, log binary"))
        bands.append(band)
        leaves = band.where(F.col("n") > 1 << levels).select("tree", F.col("block").alias("rank"), F.ceil(F.col("n") / (1 << levels)).alias("n"), F.expr(f"substring(log, length(log) - {_DIGEST - 1})").alias("digest"))
        if leaves.isEmpty():
            return bands


def log_nodes(bands: list[DataFrame], levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, position, level, index, digest): the nodes of the log, each at its place in the postorder of its tree."""

    def explode(band: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    base, top = band * levels, _top(r["n"], levels)
                    found = sorted((position(k, i, r["leaves"]), k, i) for k in range(top + 1) for i in range(-(-r["leaves"] >> k)))
                    rows = [
                        (r["tree"], position(base + k, (r["block"] << levels - k) + i, r["total"]), base + k, (r["block"] << levels - k) + i, r["log"][_DIGEST * at : _DIGEST * (at + 1)].hex())
                        for at, k, i in found
                        if k or not band  # the lowest level of a higher band is the highest of the one below
                    ]
                    yield pa.RecordBatch.from_pylist([dict(zip(["tree", "position", "level", "index", "digest"], x, strict=True)) for x in rows], _NODES)

        return run

    totals = bands[0].groupBy("tree").agg(F.max("n").alias("total"))
    found = [b.join(totals, "tree").mapInArrow(explode(k), "tree string, position long, level long, index long, digest string") for k, b in enumerate(bands)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


_NODES = pa.schema([("tree", pa.string()), ("position", pa.int64()), ("level", pa.int64()), ("index", pa.int64()), ("digest", pa.string())])


def _walk(levels: int):
    """The path of each item: through the block that comes before it in the same group, then that block's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, log, n, top, upper, subroot = None, b"", 0, 0, b"", None
        for b in batches:
            keys = zip(*(b.column(c).to_pylist() for c in ("tree", "block", "is_item", "rank")), strict=True)
            items, paths, roots = [], [], []
            for k, (tree, at, is_item, rank) in enumerate(keys):
                if not is_item:
                    block = (tree, at)
                    log, upper, n, subroot = (b.column(c)[k].as_py() for c in ("log", "upper", "leaves", "subroot"))
                    top = _top(b.column("n")[k].as_py(), levels)
                    continue
                if block != (tree, at):
                    raise RuntimeError("a leaf without its block")
                items.append(k)
                paths.append(path_of(log, rank & (1 << levels) - 1, n, top) + upper)
                roots.append(subroot)
            yield pa.RecordBatch.from_arrays([b.column("item").take(pa.array(items, pa.int64())), pa.array(paths, pa.binary()), pa.array(roots, pa.binary())], ["item", "path", "subroot"])

    return run


def walk(items: DataFrame, blocks: DataFrame, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(item, path, subroot): items (tree, rank, item) with their way to the root.

    ``blocks``: those of the items' band, with ``upper``, the path of the block's own root, and ``subroot``.
    """
    kind = items.schema["item"].dataType
    head = blocks.select("tree", "block", F.lit(False).alias("is_item"), F.lit(-1).cast("long").alias("rank"), "n", "leaves", "log", "upper", "subroot", F.lit(None).cast(kind).alias("item"))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    tail = items.select("tree", F.shiftright("rank", levels).alias("block"), F.lit(True).alias("is_item"), "rank", none("n", "long"), none("leaves", "long"), none("log", "binary"), none("upper", "binary"), none("subroot", "binary"), "item")
    dealt = head.unionByName(tail).repartition("tree", "block").sortWithinPartitions("tree", "block", "is_item", "rank")
    return dealt.mapInArrow(_walk(levels), f"item {kind.simpleString()}, path binary, subroot binary")


def _paths_of_bands(bands: list[DataFrame], upper_of: DataFrame, levels: int, tables: ScratchTables) -> DataFrame:
    """The blocks of the lowest band with ``upper`` and ``subroot``; ``upper_of``: (tree, upper, subroot) of the roots."""
    above = None
    for k in range(len(bands) - 1, -1, -1):
        blocks = bands[k]
        ends = blocks.where(F.col("n") <= 1 << levels).join(upper_of, "tree").select("tree", "block", "n", "leaves", "log", "upper", "subroot")
        if above is not None:
            inner = blocks.where(F.col("n") > 1 << levels)
            found = walk(inner.select("tree", F.col("block").alias("rank"), F.struct("tree", "block", "n", "leaves", "log").alias("item")), above, levels)
            ends = ends.unionByName(found.select("item.*", F.col("path").alias("upper"), "subroot"))
        above = tables.put(ends) if k else ends
    return above


def _prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        item = b.column("item")
        leaves, others = (item.field(c).to_pylist() for c in ("leaf", "tampered"))
        proofs, folded = [], []
        for leaf, other, path in zip(leaves, others, b.column("path").to_pylist(), strict=True):
            proofs.append(join_digests(*(d for side, d in _steps(path) if side != _ALONE)).hex())
            folded.append(fold(other or leaf, path).hex())
        yield pa.RecordBatch.from_arrays([item, b.column("subroot"), pa.array(proofs), pa.array(folded)], ["item", "subroot", "proof", "folded"])


def field(c: Column) -> Column:
    """A value as it stands in a leaf: its UTF-8 bytes behind their count, or a dash for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(columns: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def manifest(rows: DataFrame, columns: list[str], tree_col: str, id_col: str, tampered: Column | None = None, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof, folded): a proof for each of ``rows``, digests in hex.

    A leaf is the digest of ``columns``.  Leaves of one ``tree_col`` stand by ``id_col`` (null first), then by leaf; every two
    that follow each other are hashed to one, the last of an odd number by itself, until one is left, the tree's
    ``subroot``.  Subroots stand by ``tree_col`` (null first, a tree of its own) and give ``root`` in the same way.
    ``proof`` is the digest of the siblings from leaf to root (of nothing, if there are none), ``folded`` the root that
    the siblings give for ``tampered``, a leaf like those of ``leaf_of``, or, where that is null, for the leaf.

    Repeated rows are leaves of their own, in any order among themselves; texts of any length are digested whole, in the
    JVM; an empty table gives an empty result; columns that are not named are not looked at.
    """
    other = F.lit(None).cast("binary") if tampered is None else tampered
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{tree_col}`")), F.lit("0"))
    leaves = rows.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), leaf_of([F.col(f"`{c}`") for c in columns]).alias("leaf"), other.alias("tampered"), F.monotonically_increasing_id().alias("row"))
    tables = ScratchTables(rows.sparkSession)
    leaves = materialize(numbered(materialize(leaves), ["id", "leaf", "row"]).drop("row"))
    bands = build(leaves.withColumnRenamed("leaf", "digest"), levels, tables)
    last = F.expr(f"substring(log, length(log) - {_DIGEST - 1})")
    roots, several = None, F.col("n") > 1 << levels
    for b in bands:
        found = b.where(~several).select("tree", last.alias("digest"))
        roots = found if roots is None else roots.unionByName(found)
    above = materialize(numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"]))
    tops = build(above, levels, tables)
    root = tops[-1].select(F.hex(last)).head()
    start = rows.sparkSession.createDataFrame([("", b"", b"")], "tree string, upper binary, subroot binary")
    heads = _paths_of_bands(tops, start, levels, tables)
    uppers = walk(above.select("tree", "rank", F.struct("name", "digest").alias("item")), heads, levels)
    uppers = tables.put(uppers.select(F.col("item.name").alias("tree"), F.col("path").alias("upper"), F.col("item.digest").alias("subroot")))
    blocks = _paths_of_bands(bands, uppers, levels, tables)
    walked = walk(leaves.select("tree", "rank", F.struct("id", "leaf", "tampered").alias("item")), blocks, levels)
    proved = walked.mapInArrow(_prove, f"item {walked.schema['item'].dataType.simpleString()}, subroot binary, proof string, folded string")
    low = lambda c: F.lower(F.hex(c))
    return proved.select(F.col("item.id").alias("id"), low("item.leaf").alias("leaf"), low("subroot").alias("subroot"), F.lit(root[0].lower() if root else "").alias("root"), "proof", "folded")


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    changed = leaf_of([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    found = manifest(docs, COLUMNS, "lang", "doc_id", F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, changed))
    return found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _sql_levels(name: str, leaves: str) -> str:
    """All nodes (tree, level, i, d, n) over ``leaves`` (tree, i, d, n)."""
    return f"""{name} AS (SELECT tree, 0 AS level, i, d, n FROM {leaves} UNION ALL
        SELECT tree, level + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY tree, level, i // 2, n)"""


def _sql_fold(name: str, start: str, nodes: str) -> str:
    """From ``start`` (doc_id, tree, i, level, d, proof) one level up at a time through ``nodes``."""
    return f"""{name} AS (SELECT doc_id, tree, i, level, d, proof FROM {start} UNION ALL
        SELECT f.doc_id, f.tree, f.i // 2, f.level + 1, sha256(CASE WHEN s.d IS NULL THEN f.d WHEN f.i % 2 = 1 THEN s.d || f.d ELSE f.d || s.d END), f.proof || coalesce(s.d, '')
        FROM {name} f JOIN (SELECT DISTINCT tree, level, n FROM {nodes}) w ON w.tree = f.tree AND w.level = f.level AND w.n > 1
        LEFT JOIN {nodes} s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.i, 1))"""


_CRC_BYTE = "CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::BIGINT, 1))) ELSE c END"
_CRC = f"list_reduce(range(8 * strlen(doc_id::VARCHAR)), lambda c, k: xor(({_CRC_BYTE}) >> 1, ({_CRC_BYTE}) % 2 * 3988292384), 4294967295::BIGINT)"

OP13_SQL = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('1' || lang, '0') AS tree, sha256({" || ".join(map(_sql_field, COLUMNS))}) AS d,
    CASE WHEN xor({_CRC}, 4294967295) % 7 = 0 THEN sha256({" || ".join(_sql_field("(n_chars + 1)" if c == "n_chars" else c) for c in COLUMNS)}) END AS other,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents),
{_sql_levels("low", "leaves")},
subroots AS (SELECT tree AS name, d, '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
{_sql_levels("high", "subroots")},
root AS (SELECT d AS root FROM high WHERE n = 1),
begun AS (SELECT doc_id, tree, i, 0 AS level, coalesce(other, d) AS d, '' AS proof FROM leaves),
{_sql_fold("up", "begun", "low")},
half AS (SELECT u.doc_id, s.tree, s.i, 0 AS level, u.d, u.proof FROM (SELECT doc_id, tree, arg_max(d, level) AS d, arg_max(proof, level) AS proof FROM up GROUP BY ALL) u JOIN subroots s ON s.name = u.tree),
{_sql_fold("on_up", "half", "high")},
folded AS (SELECT doc_id, arg_max(d, level) AS d, arg_max(proof, level) AS proof FROM on_up GROUP BY doc_id)
SELECT l.doc_id, l.d AS leaf, s.d AS subroot, root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = root AS verified
FROM leaves l JOIN subroots s ON s.name = l.tree JOIN folded f ON f.doc_id = l.doc_id, root
"""
