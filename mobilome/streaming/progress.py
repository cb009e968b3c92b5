"""Progress and rates of streaming runs of any length, gathered by a listener as batches end.

A query itself remembers its last hundred batches only; the listener adds up every one of them.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


@dataclass
class Run:
    """What one run of a query has done so far."""

    batches: int = 0
    rows: int = 0
    seconds: float = 0.0
    error: str | None = None
    ended: threading.Event = field(default_factory=threading.Event)

    def rates(self, bases: int, contigs: int) -> dict:
        """Seconds, million bases and contigs a second, over all batches."""
        return {"seconds": self.seconds, "mbp_per_second": bases / 1e6 / max(self.seconds, 1e-9), "contigs_per_second": contigs / max(self.seconds, 1e-9)}


class RunProgress(StreamingQueryListener):
    """Adds up the batches of every run; ``each`` is called with (run id, what the run has done so far) after every batch.

    Batches without rows count as batches; an error of ``each`` does not stop the stream.
    """

    def __init__(self, each: Callable[[str, Run], None] | None = None):
        self.each = each
        self.runs: dict[str, Run] = {}
        self.lock = threading.Lock()

    def run(self, run_id) -> Run:
        with self.lock:
            return self.runs.setdefault(str(run_id), Run())

    def onQueryStarted(self, event) -> None:
        self.run(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        run = self.run(p.runId)
        with self.lock:
            run.batches += 1
            run.rows += int(p.numInputRows)
            run.seconds += int(p.durationMs.get("triggerExecution", 0)) / 1000
        if self.each is not None:
            self.each(str(p.runId), run)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        run = self.run(event.runId)
        run.error = event.exception
        run.ended.set()

    def finished(self, query, seconds: float = 60) -> Run:
        """Wait for a query and for the listener to have heard of its end."""
        query.awaitTermination()
        run = self.run(query.runId)
        if not run.ended.wait(seconds):
            raise TimeoutError(f"the end of run {query.runId} was not reported")
        return run


@contextmanager
def watched(spark: SparkSession, each: Callable[[str, Run], None] | None = None) -> Iterator[RunProgress]:
    """A listener for the queries that are started inside."""
    listener = RunProgress(each)
    spark.streams.addListener(listener)
    try:
        yield listener
    finally:
        spark.streams.removeListener(listener)
