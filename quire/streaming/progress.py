"""Reports of pages done and failed while a job or a stream runs."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

Report = Callable[[int, int], None]


class Progress:
    """Counts of a job's pages that workers add to; the driver sees them task by task. A retried task counts again."""

    def __init__(self, spark: SparkSession) -> None:
        self.done, self.failed = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def seen(self) -> tuple[int, int]:
        return self.done.value, self.failed.value

    @contextmanager
    def reported(self, report: Report, every: float = 0.5) -> Iterator[None]:
        """Calls report(done, failed) whenever the counts have changed, while the block runs, and once at its end."""
        stop = threading.Event()

        def watch() -> None:
            last = (0, 0)
            while not stop.wait(every):
                if (now := self.seen()) != last:
                    report(*now)
                    last = now

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            stop.set()
            thread.join()
            report(*self.seen())


class StreamProgress(StreamingQueryListener):
    """Reports the rows a stream has read so far, and those observed as failed, after each batch.

    Failed rows are the metric failed of an observation named pages: stream.observe("pages", count_if(...).alias("failed")).
    """

    def __init__(self, report: Report) -> None:
        self.report, self.done, self.failed = report, 0, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.done += p.numInputRows
        seen = p.observedMetrics.get("pages")
        self.failed += seen["failed"] if seen is not None else 0
        self.report(self.done, self.failed)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
