import math
import random

import pytest
from helpers import same
from meridion.llm.topk_search import OP4_SQL, op4_exact_top_k, top_k
from pyspark.sql import functions as F


def test_query_equals_sql(spark, sf_dir):
    same(op4_exact_top_k(spark, sf_dir), sf_dir, OP4_SQL, ("embeddings",))


def plain(rows, k, every=3):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % every == 0:
            scored = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for j, c in ok if j != i and len(c) == len(q))
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("case", ["plain", "ties", "huge"])
def test_equals_brute_force(spark, case):
    rng = random.Random(5)
    size = {"plain": 1.0, "ties": 0.02, "huge": 1e12}[case]
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(90)]
    rows += [(200 + i, [size, 0.0, -size, 0.5]) for i in range(40)]  # one very common vector
    rows += [(400, None), (402, []), (405, []), (None, [1.0] * 4), (403, [1.0, None, 1.0, 1.0]), (404, [1.0, float("nan"), 1.0, 1.0]), (408, [float("inf")] * 4), (410, [1.0, 2.0]), (411, [3.0, -2.0]), (3, [0.5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v")
    got = top_k(df, df.where(F.col("vec_id") % 3 == 0), k=7, bins=1000 if case == "huge" else 8, candidates=30, block_queries=16)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 7)
    if case == "ties":
        assert top_k(df.limit(0), df.limit(0)).count() == 0
