"""Documents that arrive over time. A document is a complete group, so a batch needs no state of earlier ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions.layout import measured_features
from quire.staging import scratch_path


def documents(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the documents of a parquet file or a folder of such.

    The path goes as a pattern that only it matches: a plain path must be a folder.
    """
    path = path.rstrip("/")
    schema = spark.read.parquet(path).schema
    path = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def each_batch(stream: DataFrame, pipeline: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a document pipeline on every arriving batch and hands its result, with the batch's number, to a sink.

    The checkpoint makes batches restart after a failure; a sink that overwrites by batch number writes each once.
    """
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, n: sink(pipeline(df), n)).start()


def per_document(docs: DataFrame) -> DataFrame:
    """The streaming job's row of a document; the same expression serves batch and stream."""
    return docs.select("doc_id", F.size(F.split("text", "\n")).alias("n_lines"), measured_features(F.col("text"))["avg_sentence_length"].alias("avg_sentence_length"))


def replay(spark: SparkSession, path: str) -> DataFrame:
    """Runs the streaming job over the documents under a path, to their end, and reads what its batches wrote.

    A batch is overwritten by its number, so one that is run again after a failure is written once.
    """
    out = scratch_path(spark, "stream")
    stream = documents(spark, path)
    schema = per_document(stream).schema
    q = each_batch(stream, per_document, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/rows/batch={n}"), f"{out}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{out}/rows")
