"""XML made by expressions is that of the functions; trees and elements pass to Python without a pandas group per document."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources import docx


def test_xml_of_columns(spark):
    rows = [("a<&>\r\x01￾\t", "List \"B\"", "A&B", 11.5, True, None), ("", "", "", 0.0, False, True), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "text string, style string, font string, size double, bold boolean, italic boolean")
    got = [r.x for r in df.select(docx._paragraph_column(*[F.col(c) for c in df.columns]).alias("x")).collect()]
    assert got == [docx.paragraph(t or "", s or "", f or "", z, bool(b), bool(i)) for t, s, f, z, b, i in rows]
    grid = [["a", "<"], [], [""]]
    assert spark.createDataFrame([(grid,)], "c array<array<string>>").select(docx._table_column(F.col("c")).alias("x")).first().x == docx.table(grid)


def test_no_pandas_group_per_document(spark):
    paras = spark.createDataFrame([(1, 0, "p", "x", "", "", 11.0, False, False, 0)], "doc_id long, elem_idx int, kind string, text string, style_name string, font_name string, font_size double, bold boolean, italic boolean, n_rows int")
    tree = spark.createDataFrame([(1, 1, [0], "Text", "x", None, None, False)], "doc_id long, page_number int, path array<int>, block_type string, content string, list_type string, heading_level int, blockquote boolean")
    for files in (docx.write_paragraphs(paras), docx.export(tree)):
        assert "InPandas" not in files._jdf.queryExecution().optimizedPlan().toString()
        assert [r.text for r in docx.read_paragraphs(files).collect()] == ["x"]
