"""Connected components of an edge table by alternating stars, for edge lists of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridion.session import materialize


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): each node that has an edge, with the smallest node that it can reach.

    Edges are undirected; loops, repeated edges and edges with a null end add nothing.  Iterative: a round hangs
    every node's larger neighbours, then its smaller ones, on the smallest of them, which leaves one star per
    component after a number of rounds that grows with the logarithm of the longest path.  Each round is written
    to the shared checkpoint folder.
    """
    pairs = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null and u <> v")
    loops = edges.select(F.col(u).alias("node")).unionByName(edges.select(F.col(v).alias("node"))).where("node is not null").distinct()
    now = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _signature(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("v", "u", "m")
        now = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        )
        before, seen = seen, _signature(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return loops.join(now, loops["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 20))).head())
