"""Pages put together as a stream, progress reports while a job runs, the sink that commits."""

from __future__ import annotations

import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from quire.sources import scans, sink
from quire.streaming import pages
from quire.streaming.progress import Progress, StreamProgress

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)


def arrive(spark, path, rows):
    """One more file of arrivals; minute: when."""
    data = [(d, p, t, c, START + dt.timedelta(minutes=m)) for d, p, t, c, m in rows]
    spark.createDataFrame(data, pages.ARRIVAL).coalesce(1).write.mode("append").parquet(path)


def run(spark, tmp_path, n=1):
    stream = spark.readStream.schema(pages.ARRIVAL).option("maxFilesPerTrigger", n).parquet(f"{tmp_path}/in")
    q = pages.collect_pages(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", wait=dt.timedelta(minutes=30))
    q.awaitTermination()
    return {k: sorted((r.doc_id, r.kind, r.page_number, r.n_pages, r.pages) for r in pages.read_gathered(spark, f"{tmp_path}/out", k).collect()) for k in ("documents", "side")}


def test_pages_in_any_order_with_restarts(spark, tmp_path):
    path = f"{tmp_path}/in"
    arrive(spark, path, [(1, 3, 3, "c", 0), (1, 1, 3, "a", 1), (2, 1, 2, "x", 0), (3, 1, 1, "only", 0)])
    arrive(spark, path, [(1, 1, 3, "again", 2), (4, 2, 5, "q", 2)])
    first = run(spark, tmp_path)
    assert first == {"documents": [(3, "document", None, 1, ["only"])], "side": []}
    # The next run starts from the checkpoint: the pages of before are still there.
    arrive(spark, path, [(1, 2, 3, "b", 3)])
    arrive(spark, path, [(3, 1, 1, "late", 4), (2, 2, 2, "y", 5)])
    second = run(spark, tmp_path)
    assert second["documents"] == [(1, "document", None, 3, ["a", "b", "c"]), (2, "document", None, 2, ["x", "y"]), (3, "document", None, 1, ["only"])]
    assert second["side"] == [(3, "late", 1, 1, ["late"])]
    # Time goes on, and the document that waits for pages is closed; what still comes for it is late.
    arrive(spark, path, [(9, 1, 2, "n", 120)])
    arrive(spark, path, [(9, 2, 2, "m", 130)])
    run(spark, tmp_path)
    arrive(spark, path, [(4, 1, 5, "too late", 131)])
    last = run(spark, tmp_path)
    assert (9, "document", None, 2, ["n", "m"]) in last["documents"]
    assert (4, "incomplete", None, 1, ["q"]) in last["side"] and (4, "late", 1, 1, ["too late"]) in last["side"]


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(d, p, n, f"{d}.{p}", rng.randrange(5)) for d in range(40) for n in [rng.randrange(1, 9)] for p in range(1, n + 1)]
    rng.shuffle(rows)
    for i in range(5):
        arrive(spark, f"{tmp_path}/in", rows[i::5])
    got = run(spark, tmp_path, 2)
    want = {}
    for d, p, _, c, _ in sorted(rows):
        want.setdefault(d, []).append(c)
    assert {r[0]: r[4] for r in got["documents"]} == want and got["side"] == []


def test_progress_of_a_job(spark):
    def slow(payload, page):
        time.sleep(0.3)
        if page % 4 == 0:
            raise ValueError("no answer")
        return [{"id": "x", "block_type": "Text", "content": payload}]

    units = spark.range(1, 25).select(F.col("id").alias("doc_id"), F.col("id").cast("int").alias("page_number"), F.lit("p").alias("payload")).repartition(12)
    progress, events = Progress(spark), []
    with progress.reported(lambda done, failed: events.append((time.monotonic(), done, failed)), 0.05):
        rows = scans.extract(units, slow, progress=progress).collect()
        end = time.monotonic()
    assert len(rows) == 24 and events[-1][1:] == (24, 6)
    before = [e for e in events if e[0] < end]
    assert before and 0 < before[0][1] < 24 and [e[1] for e in events] == sorted(e[1] for e in events)


def test_progress_of_a_stream(spark, tmp_path):
    for i in range(3):
        spark.range(10 * i, 10 * i + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    events = []
    listener = StreamProgress(lambda done, failed: events.append((done, failed)))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").observe("pages", F.count_if(F.col("id") % 5 == 0).alias("failed"))
        stream.writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
        for _ in range(50):
            if events and events[-1] == (30, 6):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert [e for e in events if e[0]][:3] == [(10, 2), (20, 4), (30, 6)]


def test_sink_writes_documents_in_page_order(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, p, f"{d}:{p}\n") for d in range(30) for p in range(1, 1 + d % 7)]
    rng.shuffle(rows)
    sink.write_documents(spark.createDataFrame(rows, "doc_id long, page_number int, content string").repartition(5), f"file://{tmp_path}/out", ".txt")
    want = {}
    for d, p, c in sorted(rows):
        want[f"{d}.txt"] = want.get(f"{d}.txt", "") + c
    assert {f: (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out")} == want


def test_sink_leaves_nothing_of_a_job_that_fails(spark, tmp_path):
    @F.udf("string")
    def broken(i):
        if i == 17:
            raise ValueError("no content")
        return "x" * 100_000

    bad = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), broken("id").alias("content"))
    sink.write_documents(spark.createDataFrame([(99, 1, "old")], "doc_id long, page_number int, content string"), str(tmp_path / "out"))
    with pytest.raises(Exception, match="no content"):
        sink.write_documents(bad, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["99.json"]
    none = spark.createDataFrame([], "doc_id long, page_number int, content string")
    sink.write_documents(none, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == ["99.json"]


def test_sink_task_that_is_retried(tmp_path):
    """What a first attempt wrote aside is not committed and goes with the commit."""
    from pyspark.sql import Row

    w = sink.DocumentWriter(str(tmp_path), ".json")
    rows = [Row(name="a", content="1"), Row(name="a", content="2"), Row(name="b", content=None)]
    w.write(iter(rows[:2]))  # its executor is lost
    done = w.write(iter(rows))
    w.commit([done, None])
    assert {f: (tmp_path / f).read_text() for f in os.listdir(tmp_path)} == {"a.json": "12", "b.json": ""}
