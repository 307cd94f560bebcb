"""Trees that are exported are made of their texts where these are dealt; their blocks are not moved."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import queries
from quire.sources import adapters as A
from quire.sources import docx

FIELDS = docx._Block._fields


def test_gathered_rows_are_those_of_the_trees(spark, tmp_path):
    line = "a, b. c d. e\nx\n\nf, g\nh i. j  k. \n<&>\r\x01z\n"
    texts = [(1, line * 9), (2, None), (3, ""), (4, "t\n" + line), (4, "u, v\n" + line), (6, "a. b\n" * 80)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = A.tree_blocks(spark, str(tmp_path)).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*FIELDS))).alias("rows"))
    got = A.tree_rows(spark, str(tmp_path))
    assert got.schema["rows"].dataType.elementType.names == list(FIELDS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    files = {r.doc_id: bytes(r.content) for r in docx.export_gathered(got).collect()}
    assert files == {r.doc_id: bytes(r.content) for r in docx.export(A.tree_blocks(spark, str(tmp_path))).collect()}


def test_blocks_are_not_moved(spark):
    plan = queries.export_docx(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1 and "Union" not in plan


def test_files_come_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(docx, "CONTENT_BYTES", 2_000)
    batches = list(docx._files((i, docx.paragraph("x" * i)) for i in range(20)))
    assert len(batches) > 3 and [i for b in batches for i in b.column("doc_id").to_pylist()] == list(range(20))
    assert list(docx._files(())) == []
