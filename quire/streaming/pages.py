"""Pages that arrive in any order, put together to documents: a stateful stream.

A document is emitted when all its pages are in, in page order. Its state is the pages that are there so far; a timer
closes a document whose pages stop coming. What comes for a closed document goes to a side table. Of a page that comes
twice the first counts. State survives a restart from the checkpoint; a closed document keeps one flag, which a second
timer takes away FORGET after it closed, so that state does not grow with all documents ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The store that keeps maps and timers on disk beside the executor, and in the checkpoint.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ARRIVAL = "doc_id long, page_number int, total int, content string, arrived_at timestamp"
GATHERED = "doc_id long, kind string, page_number int, n_pages int, pages array<string>"
FORGET = timedelta(days=7)


class PageCollector(StatefulProcessor):
    """Rows of kind document, incomplete (the timer came first) or late (one page of a closed document)."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page int", "content string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def _close(self, doc_id: int, kind: str, now: int, held: dict[int, str]) -> Row:
        self.closed.update((True,))
        self.handle.registerTimer(now + int(FORGET.total_seconds() * 1000))
        return self._row(doc_id, kind, None, [held[k] for k in sorted(held)])

    @staticmethod
    def _row(doc_id: int, kind: str, page: int | None, pages: list) -> Row:
        return Row(doc_id=doc_id, kind=kind, page_number=page, n_pages=len(pages), pages=pages)

    def _held(self) -> dict[int, str]:
        return {k[0]: v[0] for k, v in self.pages.iterator()}

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # Each use of the state is a call to the executor. A document whose pages come together is held here, not there.
        doc_id, total, last = key[0], 0, 0
        arrived = sorted(rows, key=lambda r: r.page_number)
        if self.closed.exists():
            for r in arrived:
                yield self._row(doc_id, "late", r.page_number, [r.content])
            return
        before, fresh = {k[0] for k in self.pages.keys()}, {}
        for r in arrived:
            if r.page_number not in before and r.page_number not in fresh:
                fresh[r.page_number] = r.content
                total, last = max(total, r.total), max(last, int(r.arrived_at.timestamp() * 1000))
        if not total:
            return
        if len(before) + len(fresh) >= total:
            if before:  # else nothing is held yet, and no timer is set
                fresh |= self._held()
                self._forget()
            yield self._close(doc_id, "document", last, fresh)
            return
        for page, content in fresh.items():
            self.pages.updateValue((page,), (content,))
        if not before:
            self.handle.registerTimer(last + self.wait_ms)

    def _forget(self) -> None:
        self.pages.clear()
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.closed.exists():
            self.closed.clear()
        else:
            held = self._held()
            self._forget()
            yield self._close(key[0], "incomplete", expiredTimerInfo.getExpiryTimeInMs(), held)

    def close(self) -> None:
        pass


def gathered(arrivals: DataFrame, wait: timedelta = timedelta(hours=1), late: str = "1 hour") -> DataFrame:
    """A stream of ARRIVAL to a stream of GATHERED. total: how many pages the document has; wait: from a document's first batch on.

    Time is arrived_at, when a page was taken in. late is the longest time between that and its being read here: Spark
    drops rows whose time is further behind the newest.
    """
    arrivals.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    pages = arrivals.withWatermark("arrived_at", late).groupBy("doc_id")
    return pages.transformWithState(PageCollector(int(wait.total_seconds() * 1000)), GATHERED, "append", "eventTime")


def collect_pages(arrivals: DataFrame, out: str, checkpoint: str, **how) -> StreamingQuery:
    """Writes documents apart from all else (incomplete, late: the side table), batch by batch; a batch that is run again is written once."""

    side = F.when(F.col("kind") == "document", "documents").otherwise("side")

    def sink(df: DataFrame, n: int) -> None:  # one write, so the state is stepped once
        df.withColumn("part", side).write.mode("overwrite").partitionBy("part").parquet(f"{out}/gathered/batch={n}")

    return gathered(arrivals, **how).writeStream.option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).foreachBatch(sink).start()


def read_gathered(spark: SparkSession, out: str, part: str = "documents") -> DataFrame:
    """What collect_pages wrote: documents, or side."""
    found = spark.read.schema(f"{GATHERED}, batch int, part string").parquet(f"{out}/gathered")
    return found.filter(F.col("part") == part).drop("batch", "part")
