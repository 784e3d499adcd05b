"""Reductions of event feeds that keep lists, maps and timers as state of each run.

Both processors are for ``transformWithStateInPandas``; a run's state goes once the watermark has left it idle for as long as
its timer says.  Spark keeps such state in RocksDB (``use_rocksdb``), in the checkpoint of the query, from which it goes on
after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from meridion.streaming.feeds import WATERMARK

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def use_rocksdb(spark: SparkSession) -> None:
    """Queries that are started in this session from now on keep their state where lists, maps and timers can be kept."""
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _milliseconds(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ms]").astype("int64")


#: An entity without an event in part, and one that was never complete.
_NONE, _ENDED = (-1, None), (-1, None, 0)


class _Expiring(StatefulProcessor):
    """State with one timer a key, moved on by each event."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expires = handle.getValueState("expires", "at long")

    def _known(self) -> int | None:
        """When the key's timer fires; none for a key that holds no state, of which nothing else has to be asked."""
        return self.expires.get()[0] if self.expires.exists() else None

    def _wait(self, at: int, before: int | None) -> None:
        if before is not None:
            if before >= at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.expires.update((at,))

    def close(self) -> None:
        pass


class LatestState(_Expiring):
    """The latest event of each entity of a run, and the traces that are complete.

    An entity's event takes the place of an earlier one; a trace's completion is appended to the completed ones and removes
    what was there of it in part.  Events may come in any order: an event behind a later one of its entity changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.partial = handle.getMapState("partial", "entity string", "seq long, value string")
        self.done = handle.getMapState("done", "entity string", "seq long, value string, n long")
        self.completed = handle.getListState("completed", "entity string, seq long")

    def _held(self, entity: str) -> tuple[tuple, tuple]:
        now = self.partial.getValue((entity,)) if self.partial.containsKey((entity,)) else _NONE
        ended = self.done.getValue((entity,)) if self.done.containsKey((entity,)) else _ENDED
        return now, ended

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, latest, completed = self._known(), 0, []
        held, changed = {}, set()  # each entity's state is read once and written once, not with every event
        for f in rows:
            latest = max(latest, int(_milliseconds(f["ts"]).max()))
            for seq, entity, value, complete in zip(f["seq"].tolist(), f["entity"].tolist(), f["value"].tolist(), f["complete"].tolist(), strict=True):
                if entity not in held:
                    held[entity] = self._held(entity) if known is not None else (_NONE, _ENDED)
                now, ended = held[entity]
                if complete:
                    completed.append((entity, seq))
                    ended = (max(seq, ended[0]), value if seq > ended[0] else ended[1], ended[2] + 1)
                    changed.add((entity, True))
                    if -1 < now[0] < seq:
                        now = _NONE
                        changed.add((entity, False))
                elif seq > max(now[0], ended[0]):
                    now = (seq, value)
                    changed.add((entity, False))
                held[entity] = now, ended
        if not held:
            return
        for entity, done in changed:
            now, ended = held[entity]
            if done:
                self.done.updateValue((entity,), ended)
            elif now is not _NONE:
                self.partial.updateValue((entity,), now)
            elif known is not None:
                self.partial.removeKey((entity,))
        if completed:
            self.completed.appendList(completed)
        self._wait(latest + self.idle_ms, known)
        out = []
        for entity in sorted(held):
            now, ended = held[entity]
            if now is not _NONE:
                out.append((key[0], entity, "partial", *now, ended[2]))
            else:
                out.append((key[0], entity, "complete", *ended))
        yield pd.DataFrame(out, columns=["run_id", "entity", "state", "seq", "value", "completions"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.partial, self.done, self.completed, self.expires):
            state.clear()
        yield from ()


LATEST_DDL = "run_id long, entity string, state string, seq long, value string, completions long"


def fold_latest_state(stream: DataFrame, idle_ms: int = 3_600_000, watermark: str = WATERMARK) -> DataFrame:
    """(run_id, entity, state, seq, value, completions): what became of the entities that a micro-batch touched.

    ``stream``: (run_id, seq, ts, entity, value, complete).  ``state`` is partial or complete; the last row of an entity
    holds.  The state of a run goes when the watermark is ``idle_ms`` behind its last event.
    """
    rows = stream.withWatermark("ts", watermark).select("run_id", "seq", "ts", "entity", "value", "complete")
    return rows.groupBy("run_id").transformWithStateInPandas(LatestState(idle_ms), LATEST_DDL, "Update", "EventTime")


class FlushBuffer(_Expiring):
    """Events of a run in batches: of so many events, after so much time, or at once when one is urgent."""

    def __init__(self, most: int, interval_ms: int):
        super().__init__(interval_ms)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "seq long")
        self.sent = handle.getValueState("sent", "batches long, at long")

    def _waiting(self) -> list[int]:
        return [r[0] for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t = pd.concat(list(rows)).sort_values("seq")  # those of one run in one micro-batch
        if t.empty:
            return
        known, times = self._known(), _milliseconds(t["ts"]).tolist()
        sent = self.sent.get() if self.sent.exists() else None  # is kept when a timer clears the rest
        batches, since = sent or (0, times[0])
        before = self._waiting() if known is not None else []
        held, out = list(before), []
        for seq, at, urgent in zip(t["seq"].tolist(), times, t["urgent"].tolist(), strict=True):
            held.append(seq)
            reason = "urgent" if urgent else "full" if len(held) >= self.most else "interval" if at - since >= self.idle_ms else None
            if reason:
                out.append((key[0], batches, held, len(held), reason))
                batches, since, held = batches + 1, at, []
        if held:
            self.waiting.put([(s,) for s in held])
        elif before:
            self.waiting.clear()
        if sent != (batches, since):
            self.sent.update((batches, since))
        self._wait(max(times) + self.idle_ms, known)
        yield pd.DataFrame(out, columns=["run_id", "batch", "seqs", "n", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._waiting()
        batches, _ = self.sent.get() if self.sent.exists() else (0, 0)
        self.expires.clear()
        if held:
            self.waiting.clear()
            self.sent.update((batches + 1, expiredTimerInfo.getExpiryTimeInMs()))
            yield pd.DataFrame([(key[0], batches, held, len(held), "timer")], columns=["run_id", "batch", "seqs", "n", "reason"])


def flush_batches(stream: DataFrame, most: int, interval_ms: int, watermark: str = WATERMARK) -> DataFrame:
    """(run_id, batch, seqs, n, reason): events (run_id, seq, ts, urgent) in batches of at most ``most``.

    A batch goes out with an urgent event, with the one that fills it, or with the first that comes ``interval_ms`` after
    the batch before; what still waits goes when the watermark is so far behind the run's last event (timer).
    """
    rows = stream.withWatermark("ts", watermark).select("run_id", "seq", "ts", "urgent")
    return rows.groupBy("run_id").transformWithStateInPandas(FlushBuffer(most, interval_ms), "run_id long, batch long, seqs array<long>, n long, reason string", "Append", "EventTime")
