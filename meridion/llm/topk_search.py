"""Exact top-k by distributed histogram selection (operator 4).

Queries and candidates are packed into blocks, and every block of queries meets every block of candidates.  Each pass
scores everything and counts, per query, the scores that fall into each bin of the range that still can hold its k-th
best score; the bin that holds it is the next pass's range, until a bin is one score wide.  A last pass keeps what is
above that score, and of the candidates at it the smallest ids that are still wanted.

A block only reports scores that are not below its own k-th best: whatever is lower is below the global one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meridion.session import materialize, table

K = 20
SCALE = 64
QUERY_EVERY = 20
BINS = 256
#: Vectors in a block, on average.
CANDIDATES = 8192
QUERIES = 2048
#: Scores that a task holds at a time.
_SLAB = 1 << 21
_LONG = (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): floor(scale * x) of each component, as doubles; without rows that cannot take part."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(~odd, v).alias("v")).where("id is not null and v is not null")
    # floor() of doubles would give longs; whole parts of doubles stay exact at any size.
    return usable.select("id", F.transform("v", lambda x: F.rint(x * scale) - F.when(F.rint(x * scale) > x * scale, 1.0).otherwise(0.0)).alias("v"))


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """(name, dims, ids, data): rows by a hash of themselves; the number of blocks for each number of dimensions."""
    n = max(1, math.ceil(rows.count() / size))

    def pack(t: pa.Table) -> pa.Table:
        ids = t.column("id").to_numpy()
        v = t.column("v").combine_chunks()
        data = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.lexsort((*reversed(data.T), ids)) if data.shape[1] else np.argsort(ids, kind="stable")
        return pa.table({name: t.column(name)[:1], "dims": pa.array([data.shape[1]], pa.int32()), f"{name}_ids": pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), f"{name}_data": pa.array([data[order].astype("<f8").tobytes()], pa.binary())})

    dealt = rows.withColumn(name, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).withColumn("dims", F.size("v"))
    return materialize(dealt.groupBy(name, "dims").applyInArrow(pack, f"{name} int, dims int, {name}_ids binary, {name}_data binary")), n


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as longs; products that a double cannot hold exactly are worked out in whole numbers."""
    top = max(1, q.shape[1]) * (np.abs(q).max(initial=0.0) * np.abs(c).max(initial=0.0))
    if top < 1 << 53:
        return (q @ c.T).astype(np.int64)
    whole = [[max(-_LONG, min(_LONG, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in c] for x in q]
    return np.array(whole, np.int64).reshape(len(q), len(c))


def _slabs(b: pa.RecordBatch, i: int):
    """Query positions, query ids, candidate ids and scores of one pair of blocks, some queries at a time."""
    get = lambda c: b.column(c)[i].as_py()
    d = get("dims")
    qid, cid = np.frombuffer(get("qb_ids"), "<i8"), np.frombuffer(get("cb_ids"), "<i8")
    q, c = np.frombuffer(get("qb_data"), "<f8").reshape(len(qid), d), np.frombuffer(get("cb_data"), "<f8").reshape(len(cid), d)
    step = max(1, _SLAB // max(1, len(cid)))
    for at in range(0, len(qid), step):
        yield np.arange(at, min(at + step, len(qid))), qid[at : at + step], cid, _scores(q[at : at + step], c)


def _best(s: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query in this block; a query's own rows do not count."""
    if s.shape[1] <= k:
        return np.full(len(s), -_LONG - 1)
    masked = np.where(own, -_LONG - 1, s) if own.any() else s
    return np.partition(masked, s.shape[1] - k, axis=1)[:, s.shape[1] - k]


def _count(k: int, bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                low, high, width = (np.array(b.column(c)[i].as_py(), np.int64) for c in ("low", "high", "width"))
                for at, qid, cid, s in _slabs(b, i):
                    own = qid[:, None] == cid[None, :]
                    lo, w = low[at][:, None], width[at][:, None]
                    kept = (s >= np.maximum(lo, _best(s, own, k)[:, None])) & (s < high[at][:, None]) & ~own
                    row, col = np.nonzero(kept)
                    bin_ = (s[row, col] - lo[row, 0]) // w[row, 0]
                    n = np.bincount(row * bins + bin_, minlength=len(at) * bins)
                    full = np.nonzero(n)[0]
                    out.append((np.full(len(full), b.column("qb")[i].as_py()), np.full(len(full), b.column("dims")[i].as_py()), at[full // bins], full % bins, n[full]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out, strict=True), ("i4", "i4", "i4", "i4", "i8"), strict=True)], ["qb", "dims", "at", "bin", "n"])

    return run


def _keep(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                low, above = (np.array(b.column(c)[i].as_py(), np.int64) for c in ("low", "above"))
                for at, qid, cid, s in _slabs(b, i):
                    own = qid[:, None] == cid[None, :]
                    floor = low[at][:, None]
                    row, col = np.nonzero((s > floor) & ~own)
                    # Candidates are in the order of their ids: the first ties are the smallest ids.
                    equal = (s == floor) & ~own
                    equal &= np.cumsum(equal, axis=1) <= (k - above[at])[:, None]
                    tied = np.nonzero(equal)
                    row, col = np.concatenate([row, tied[0]]), np.concatenate([col, tied[1]])
                    out.append((np.full(len(row), b.column("qb")[i].as_py()), np.full(len(row), b.column("dims")[i].as_py()), at[row], qid[row], cid[col], s[row, col]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(t)) for x, t in zip(zip(*out, strict=True), ("i4", "i4", "i4", "i8", "i8", "i8"), strict=True)], ["qb", "dims", "at", "query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, bins: int = BINS, candidates: int = CANDIDATES, block_queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` for each row of ``queries``, all if fewer.

    Scores are integer inner products of quantised vectors, cut at the ends of a long.  Rows with a null id or a vector
    that is null or holds a null, NaN or infinite component take no part; vectors meet vectors of their own length
    only; rows that share a query's id are its own; repeated rows are candidates, and queries, as often as they occur;
    empty tables give an empty result.
    """
    usable = quantised(vectors, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale)
    norm = lambda df: df.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).head()[0] or 0.0
    # No score is larger than the product of the two longest vectors.
    reach = min(_LONG // 4, int(math.sqrt(norm(usable)) * math.sqrt(norm(asked))) + 2)
    cb, cn = _blocks(usable, candidates, "cb")
    qb, qn = _blocks(asked, block_queries, "qb")
    pairs_of = lambda df, other, n: df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = pairs_of(cb, "qb", qn)
    width = math.ceil((2 * reach + 1) / bins)
    size = (F.octet_length("qb_ids") / 8).cast("int")
    same = lambda x: F.array_repeat(F.lit(x).cast("long"), size)
    state = qb.select("qb", "dims", same(-reach).alias("low"), same(reach + 1).alias("high"), same(width).alias("width"), same(0).alias("above"))

    def pairs(now: DataFrame) -> DataFrame:
        right = pairs_of(qb.join(now, ["qb", "dims"]), "cb", cn)
        return left.join(right, ["qb", "cb", "dims"])

    while True:
        counts = pairs(state).mapInArrow(_count(k, bins), "qb int, dims int, at int, bin int, n long").groupBy("qb", "dims", "at", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("qb", "dims", "at").orderBy(F.desc("bin"))
        before = state.select("qb", "dims", F.posexplode(F.arrays_zip("low", "high", "width", "above")).alias("at", "s")).select("qb", "dims", "at", "s.*")
        run = counts.join(before, ["qb", "dims", "at"]).withColumn("sum", F.sum("n").over(down) + F.col("above"))
        hit = run.where((F.col("sum") >= k) & (F.col("sum") - F.col("n") < k)).select("qb", "dims", "at", "bin", (F.col("sum") - F.col("n")).alias("over"))
        # A query with fewer than k candidates takes all of them.
        joined = before.join(hit, ["qb", "dims", "at"], "left")
        next_width = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("width") / bins).cast("long"))
        found = F.col("bin").isNotNull()
        start = F.col("low") + F.col("bin") * F.col("width")
        moved = joined.select(
            "qb", "dims", "at",
            F.when(found, start).otherwise(-_LONG).alias("low"),
            F.when(found, F.least("high", start + F.col("width"))).otherwise(-_LONG).alias("high"),
            F.when(found, next_width).otherwise(F.lit(1)).cast("long").alias("width"),
            F.when(found, F.col("over")).otherwise(0).alias("above"),
        )
        by_place = F.sort_array(F.collect_list(F.struct("at", "low", "high", "width", "above")))
        state = moved.groupBy("qb", "dims").agg(by_place.alias("s")).select("qb", "dims", F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("s.width").alias("width"), F.col("s.above").alias("above"))
        state = materialize(state)
        if width == 1:
            break
        width = max(1, math.ceil(width / bins))
    kept = pairs(state).mapInArrow(_keep(k), "qb int, dims int, at int, query_id long, vec_id long, score long")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("qb", "dims", "at").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % QUERY_EVERY == 0))


OP4_SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
