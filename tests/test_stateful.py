"""Streams with lists, maps and timers: several micro-batches, out of order, and a restart from the checkpoint."""

import datetime as dt

import pytest
from meridion.streaming import feeds, stateful

T0 = dt.datetime(2024, 1, 1)
DDL = "run_id long, seq long, ts timestamp, entity string, value string, complete boolean, urgent boolean"


@pytest.fixture
def feed(spark, tmp_path):
    """(add(rows), run(transform, mode)): files of a feed, and the rows that a query writes from its checkpoint on."""
    stateful.use_rocksdb(spark)
    path = str(tmp_path / "feed")

    def add(*rows):
        full = [(r[0], r[1], T0 + dt.timedelta(minutes=r[2]), *r[3:]) for r in rows]
        spark.createDataFrame(full, DDL).coalesce(1).write.mode("append").parquet(path)

    def run(transform, mode):
        out = []
        stream = spark.readStream.schema(DDL).parquet(path)
        feeds.to_sink(transform(stream), lambda b, n: out.extend(map(tuple, b.collect())), str(tmp_path / "state"), mode, once=True).awaitTermination()
        return out

    return add, run


def test_completed_traces_leave_the_partial_ones_over_a_restart(feed):
    add, run = feed
    fold = lambda s: stateful.fold_latest_state(s, idle_ms=60_000)
    add((1, 1, 0, "t", "a", False, False), (1, 2, 1, "n", "x", False, False), (1, 3, 2, "t", "b", False, False), (2, 1, 2, "t", "q", False, False))
    assert sorted(run(fold, "update")) == [(1, "n", "partial", 2, "x", 0), (1, "t", "partial", 3, "b", 0), (2, "t", "partial", 1, "q", 0)]
    # another query goes on from the checkpoint: what is complete is no longer partial, and an earlier event comes too late
    add((1, 5, 3, "t", "end", True, False), (1, 4, 3, "t", "late", False, False), (1, 1, 3, "n", "old", False, False))
    assert sorted(run(fold, "update")) == [(1, "n", "partial", 2, "x", 0), (1, "t", "complete", 5, "end", 1)]
    add((1, 6, 4, "t", "again", False, False))
    assert run(fold, "update") == [(1, "t", "partial", 6, "again", 1)]
    # far behind the watermark the runs' states are gone: the next event finds nothing
    add((3, 1, 600, "t", "z", False, False))
    run(fold, "update")
    add((1, 7, 601, "t", "new", False, False))
    assert run(fold, "update") == [(1, "t", "partial", 7, "new", 0)]


def test_batches_go_when_full_late_or_urgent(feed):
    add, run = feed
    flush = lambda s: stateful.flush_batches(s, 3, 5 * 60_000)
    at = lambda k, minute, urgent=False, run=1: (run, k, minute, "e", "v", False, urgent)
    add(at(1, 0), at(3, 2), at(2, 1), at(4, 3), at(5, 3, True), at(6, 4))
    assert run(flush, "append") == [(1, 0, [1, 2, 3], 3, "full"), (1, 1, [4, 5], 2, "urgent")]
    add(at(7, 9), at(8, 10))
    assert run(flush, "append") == [(1, 2, [6, 7], 2, "interval")]
    add(at(1, 300, run=2))
    assert (1, 3, [8], 1, "timer") in run(flush, "append") + run(flush, "append")


class _Calls:
    """State that counts what is asked of it."""

    def __init__(self):
        self.n, self.held = 0, {}

    def __getattr__(self, name):
        def call(key=None, value=None):
            self.n += 1
            if name in ("containsKey", "getValue"):
                return key in self.held if name == "containsKey" else self.held[key]
            if name == "updateValue":
                self.held[key] = value
            return bool(self.held)

        return call


def test_an_entity_costs_no_more_calls_for_more_events():
    import pandas as pd

    def calls(n: int) -> int:
        p = stateful.LatestState(1000)
        p.partial, p.done, p.completed, p.expires, p.handle = (_Calls() for _ in range(5))
        t = pd.DataFrame({"seq": range(n), "ts": pd.Timestamp(T0), "entity": "e", "value": "v", "complete": [k % 2 == 0 for k in range(n)]})
        assert [tuple(r) for f in p.handleInputRows((1,), iter([t]), None) for r in f.to_numpy().tolist()] == [(1, "e", "partial" if n % 2 == 0 else "complete", n - 1, "v", (n + 1) // 2)]
        return sum(s.n for s in (p.partial, p.done, p.completed, p.expires, p.handle))

    assert calls(100) == calls(4)
