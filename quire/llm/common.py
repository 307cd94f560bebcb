"""What the corpus operators share: word rules, shared tables, size-checked joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quire.staging import forget, scratch_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"

#: Rows, and bytes as written, up to which a staged table is broadcast. Beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 16 << 20

#: Bytes and rows of a batch of texts for Python.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2000


def _bytes(spark: SparkSession, path: str) -> int:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts lineage, survives lost executors, has known sizes."""
    path = scratch_path(df.sparkSession, name)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at, out._staged_rows = path, seen.get.get("rows")
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes staged tables that later ones have taken the place of."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            forget(t.sparkSession, path)


def is_small(df: DataFrame) -> bool:
    """Whether a table has few rows: as counted when it was staged (then its bytes count too), else counted now."""
    rows = getattr(df, "_staged_rows", None)
    if rows is None:
        return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows <= BROADCAST_ROWS and _bytes(df.sparkSession, df._staged_at) <= BROADCAST_BYTES


def small(df: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """A table marked for broadcast if it is small; otherwise as it is, to be shuffled. of: the staged table that df is a projection of."""
    return F.broadcast(df) if is_small(df if of is None else of) else df


def bounded_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in Arrow batches of a few MB, so that neither side holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def text_or_empty(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row and named once in the plan."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole(docs: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as struct _doc, so that its columns cannot clash with an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in (docs.columns if columns is None else columns)]).alias("_doc")


def row_hash(df: DataFrame) -> Column:
    """One long over all columns, to tell apart rows that share a doc_id. Columns of types without a hash go as JSON."""
    cols = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or "variant" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols]) if cols else F.lit("")
    return F.xxhash64(marks, *cols)


def keep_rows(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs without the rows that decided (doc_id, row_hash, kept) drops; of rows equal in every column one stays.

    The dropped keys are broadcast if they are few (counted), else joined by a shuffle.
    """
    by_key = staged(decided.groupBy("doc_id", "row_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "decided")
    gone = small(by_key.filter(~F.col("kept")).select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h")))
    twins = by_key.filter(F.col("kept") & (F.col("n") > 1)).select(F.col("doc_id").alias("_d"), F.col("row_hash").alias("_h"))
    keyed = docs.select(whole(docs), F.col("doc_id").alias("_did"), row_hash(docs).alias("_rh"))
    on = lambda left, right: left["_did"].eqNullSafe(right["_d"]) & (left["_rh"] == right["_h"])
    out = keyed.join(gone, on(keyed, gone), "left_anti")
    if twins.isEmpty():
        return out.select("_doc.*")
    twins = small(twins)
    once = out.join(twins, on(out, twins), "left_semi").select("_doc.*").dropDuplicates()
    return out.join(twins, on(out, twins), "left_anti").select("_doc.*").unionByName(once)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
