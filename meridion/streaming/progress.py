"""Progress of jobs and streams for a caller's function; what the caller raises does not stop the work."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

Report = Callable[[str, float, str], None]


def counted(df: DataFrame, phase: str) -> tuple[DataFrame, Observation]:
    """The same rows; after an action on them ``observation.get["rows"]`` is their number."""
    seen = Observation(phase)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


class ProgressListener(StreamingQueryListener):
    """Tells (phase, rows per second, message) of each micro-batch."""

    def __init__(self, report: Report):
        self.report = report

    def _tell(self, phase: str, rate: float, message: str) -> None:
        with contextlib.suppress(Exception):
            self.report(phase, rate, message)

    def onQueryStarted(self, event):  # noqa: N802
        self._tell("started", 0.0, str(event.id))

    def onQueryProgress(self, event):  # noqa: N802
        self._tell("progress", event.progress.processedRowsPerSecond or 0.0, f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event):  # noqa: N802
        self._tell("idle", 0.0, str(event.id))

    def onQueryTerminated(self, event):  # noqa: N802
        self._tell("ended", 0.0, str(event.exception or ""))
