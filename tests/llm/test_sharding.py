from collections import defaultdict

from helpers import same
from meridion.llm.sharding import OP8_SQL, op8_extendible_shards, shard


def test_query_equals_sql(spark, sf_dir):
    same(op8_extendible_shards(spark, sf_dir), sf_dir, OP8_SQL)


def check(rows, limit):
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    for s in shards.values():
        assert {r.shard_bytes for r in s} == {sum(r.size for r in s)}
        assert {r.fits for r in s} == {sum(r.size for r in s) <= limit}
    for name in names:  # every shard was split off from a bucket that was too large
        if name:
            assert sum(r.size for n, s in shards.items() if n.startswith(name[:-1]) for r in s) > limit
    return shards


def test_skew_nulls_repeats_and_giants(spark):
    rows = [(i, "x" * (i % 40)) for i in range(300)] + [(7, f"copy {i}") for i in range(200)] + [(8, "same")] * 30 + [(None, None), (None, "a"), (301, "y" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS row", "3 AS shard")
    for bits in (3, 14):
        out = shard(df, limit=1000, step_bits=bits).collect()
        assert sorted(((r.row.doc_id, r.row.text) for r in out), key=repr) == sorted(rows, key=repr)
        shards = check(out, 1000)
        odd = [s for s in shards.values() if not s[0].fits]
        assert sorted({r.row.text[:4] for s in odd for r in s}) == ["same", "yyyy"] and len(odd) == 2
    assert shard(df.limit(0)).count() == 0
    assert {r.shard for r in shard(df, limit=10**9).collect()} == {""}
