"""Progress of runs: metrics observed as rows pass, told on at most every 0.4 seconds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql.streaming.listener import StreamingQueryListener

#: Seconds between two messages, and the share done from which every one is passed on.
PAUSE, NEARLY = 0.4, 0.99


class Throttle:
    """Passes (share, message) on to `tell` if the last one is over PAUSE seconds ago or nearly all is done; the share is rounded to three places."""

    def __init__(self, tell: Callable[[float, str], None], clock: Callable[[], float] = time.monotonic):
        self.tell, self.clock, self.last = tell, clock, float("-inf")

    def __call__(self, share: float, message: str) -> bool:
        now = self.clock()
        if now - self.last <= PAUSE and share < NEARLY:
            return False
        self.last = now
        self.tell(round(share, 3), message)
        return True


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics (aggregates) that are counted while an action runs over it, without a pass of their own; read them by `.get` behind the action."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in metrics.items()]), watch


class Listener(StreamingQueryListener):
    """Sums the metrics that a stream observes under a name, and tells the share of `total` rows done.

    A stream's batches are told in order; one that is run again after a failure counts once.
    """

    def __init__(self, name: str, total: int, tell: Callable[[float, str], None], clock: Callable[[], float] = time.monotonic):
        self.name, self.total, self.throttle = name, total, Throttle(tell, clock)
        self.sums: dict[str, int] = {}
        self.rows, self.batches = 0, -1

    def onQueryStarted(self, event) -> None:  # noqa: N802 - Spark's name
        self.throttle(0.0, "started")

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.batchId <= self.batches or not p.numInputRows:
            return
        self.batches = p.batchId
        self.rows += p.numInputRows
        own = p.observedMetrics.get(self.name)
        for k, v in (own.asDict() if own else {}).items():
            self.sums[k] = self.sums.get(k, 0) + (v or 0)
        self.throttle(min(1.0, self.rows / max(1, self.total)), f"batch {p.batchId}")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.throttle(1.0, "failed" if event.exception else "done")
