"""Ranked values of large groups."""

import random

from meridion.operators import stats


def test_nearest_rank_counts_equal_values_and_needs_no_group_in_one_task(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(5)), rng.random() * 9, None])) for _ in range(900)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 0.5, 0.85, 1.0):
        found = stats.nearest_rank(df, ["g"], "v", q)
        want = {}
        for g in ("a", "b", None, "c"):
            values = sorted(v for k, v in rows if k == g and v is not None)
            want[g] = values[round((len(values) - 1) * q)]
        assert {r.g: r.q for r in found.collect()} == want
    assert "row_number" not in found._jdf.queryExecution().executedPlan().toString()  # it ranked all rows of a group in one task
