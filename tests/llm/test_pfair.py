from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from helpers import same
from meridion.llm.pfair_mix import OP2_SQL, mix, op2_pfair_mix, period_schedule


def test_query_equals_sql(spark, sf_dir):
    same(op2_pfair_mix(spark, sf_dir), sf_dir, OP2_SQL)


@pytest.mark.parametrize("weights", [[1], [3, 4], [50, 30, 15, 5], [1, 1, 97, 1], [7, 13, 29, 51], [33, 33, 33, 1]])
def test_less_than_one_block_of_deviation(spark, weights):
    period = sum(weights)
    df = spark.createDataFrame([(f"s{k}", 1, w) for k, w in enumerate(weights)], "site string, bytes long, weight long")
    slots = {r.slot: r.site for r in period_schedule(df, period).collect()}
    assert sorted(slots) == list(range(period))
    had = Counter()
    for t in range(period):
        had[slots[t]] += 1
        assert all(abs(had[f"s{k}"] - Fraction(w * (t + 1), period)) < 1 for k, w in enumerate(weights))


def test_whole_mix(spark):
    rows = [(i, "a") for i in range(23)] + [(i, "b") for i in range(100, 104)] + [(None, "b"), (7, None), (7, None)]
    df = spark.createDataFrame([(*r, "x" * 9) for r in rows], "doc_id long, source string, text string").selectExpr("*", "1 AS slot", "2 AS `digest.a`")
    w = spark.createDataFrame([("a", 4), ("b", 3), (None, 3)], "site string, weight long")
    out = mix(df, weights=w, period=10, block_bytes=20, numbered=4).collect()
    assert {(r.row.doc_id, r.row.source) for r in out} == set(rows)
    by_slot = defaultdict(list)
    for r in out:
        by_slot[r.slot].append(r)
    # it ends with the last block that no slot has had yet
    last = max(by_slot)
    assert {(r.site, r.block) for r in by_slot[last]} - {(r.site, r.block) for t in by_slot if t < last for r in by_slot[t]}
    had, left = Counter(), set()
    blocks = {"a": 12, "b": 3, None: 1}
    for t in range(last + 1):
        if t not in by_slot:  # of a source that has left
            left.add(t)
            continue
        assert len({(r.site, r.block, r.epoch) for r in by_slot[t]}) == 1
        assert sorted(r.place for r in by_slot[t]) == list(range(0, 10 * len(by_slot[t]), 10))
        s = by_slot[t][0].site
        had[s] += 1
        if had[s] < 4 * blocks[s]:
            p = {"a": 4, "b": 3, None: 3}[s]
            assert abs(had[s] * 10 - p * (t + 1)) < 10
    assert all(had[s] <= 4 * blocks[s] for s in had) and had[None] == 4 and left
    # a source is used up before it starts again
    for s in ("a", "b", None):
        order = [(r[0].epoch, r[0].block) for _, r in sorted(by_slot.items()) if r[0].site == s]
        assert order == sorted(order)
    assert mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("sent", [1 << 16, 0])
def test_any_number_of_sources_and_long_texts(spark, sent):
    """More sources than a period has slots at least; a text over several blocks; none comes more than four times."""
    rows = [(i, f"s{i}", "x") for i in range(1200)] + [(5000 + i, "big", "y" * (300_000 if i == 3 else 100)) for i in range(300)] + [(9000, "nil", None)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), block_bytes=1000, sent_slots=sent).select("row.doc_id", "slot", "block", "epoch").collect()
    n = Counter(r.doc_id for r in out)
    assert set(n) == {r[0] for r in rows} and max(n.values()) <= 4
    assert len({(r.slot, r.block, r.epoch) for r in out}) == len({r.slot for r in out})
    assert max(r.block for r in out if r.doc_id >= 5000) >= 320


@pytest.mark.parametrize("weights", [[("a", 6), ("b", 4), ("c", 1)], [("a", 6)], [("a", 6), ("b", 5)], [("a", 10), ("b", 0)], [("a", 6), ("a", 2), ("b", 2)]])
def test_weights_have_to_cover_the_sources(spark, weights):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id long, source string, text string")
    given = spark.createDataFrame(weights, "site string, weight long")
    if weights[0] == ("a", 6) and len(weights) == 3 and weights[2][0] == "c":  # one more than there are sources
        assert {r.row.doc_id for r in mix(df, weights=given, period=10).collect()} == {1, 2}
    else:
        with pytest.raises(ValueError):
            mix(df, weights=given, period=10)


def test_any_number_of_digest_ranges_gives_one_order(spark):
    docs = spark.range(40_000).selectExpr("id AS doc_id", "concat('s', id % 3) AS source", "repeat('x', int(id % 7)) AS text")
    few, many = (mix(docs, numbered=n, block_bytes=4096).select("row.doc_id", "site", "block", "epoch", "slot", "place") for n in (40_000, 1))
    assert few.exceptAll(many).isEmpty() and few.count() == many.count() >= 40_000


def test_rows_are_dealt_once_whatever_the_joins(spark):
    docs = spark.createDataFrame([(k, f"s{k % 3}" if k % 4 else None, "a" * (k % 50)) for k in range(400)], "doc_id long, source string, text string")
    plans = {}
    for size in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        try:
            df = mix(docs, numbered=20).select("row.doc_id", "slot")
            plans[size] = df._jdf.queryExecution().executedPlan().toString(), sorted(tuple(r) for r in df.collect())
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    one, other = plans.values()
    assert one[1] == other[1] and len(one[1]) >= 400
    assert "SortMergeJoin [named" in one[0] and "hashpartitioning(coalesce(site" not in one[0]
