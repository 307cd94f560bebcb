"""What is costly is worked out once: files of a plan are parsed once, words become tokens where the document is."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import assemble
from quire.plans import pipelines
from quire.sources import docx


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_docx_tree_parses_files_once(spark):
    files = spark.createDataFrame([(1, docx.pack(docx.paragraph("a", "List Bullet") + docx.table([["x", "y"], []])))], "doc_id long, content binary")
    tree = pipelines.docx_blocks(docx.read_paragraphs(files))
    assert plan(tree).count("MapInPandas") == 1
    got = [(list(r.path), r.block_type, r.content) for r in tree.orderBy("path").collect()]
    assert got == [([0], "ListGroup", ""), ([0, 0], "ListItem", "a"), ([1], "Table", "x y"), ([1, 0], "Text", ""), ([1, 0, 0], "Text", "x"), ([1, 0, 1], "Text", "y"), ([1, 1], "Text", "")]


def test_tokens_are_made_of_words_where_the_document_is(spark):
    words = "array<struct<text string, x0 double, y0 double, x1 double, y1 double>>"
    rows = [(1, 1, 0, "b", [("t", 0.0, 0.0, 306.0, 396.0)]), (1, 1, 1, "c", [])]
    b = spark.createDataFrame(rows, f"doc_id long, page_number int, block_idx int, id string, words {words}").withColumns({"text": F.lit("t"), "block_type": F.lit("paragraph"), "role": F.lit("paragraph"), "reading_order": F.col("block_idx"), "x0": F.lit(0.0), "y0": F.lit(0.0), "x1": F.lit(1.0), "y1": F.lit(1.0), "fontname": F.lit("A"), "size": F.lit(9.0), "color": F.lit("#000000")})
    pages = b.select("doc_id", "page_number", F.lit(612.0).alias("width"), F.lit(792.0).alias("height")).distinct()
    full = assemble.rendered(assemble.boxed(assemble.with_style(b), pages))
    edges = assemble.reading_graph(assemble.emitted(b, b.select("doc_id", "page_number", F.lit(0).alias("table_idx"), "id").limit(0)))
    late = assemble.document_json(pages, full, edges, "pdf").first().json
    assert late == assemble.document_json(pages, assemble.with_tokens(full), edges, "pdf").first().json
    assert '"tokens":[{"text":"t","bbox":[0.0,0.0,306.0,396.0],"bbox_norm":[0.0,0.0,0.5,0.5],"block_id":"b","span_id":"s-b"}]' in late
