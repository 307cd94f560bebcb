"""Documents that are assembled from texts dealt by document are not moved again, and a list of them is not made twice."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.operators import assemble
from quire.plans import queries

ROW = "doc_id long, page_number int, block_idx int, id string, text string, block_type string, role string, reading_order int, fontname string, size double, color string, x0 double, y0 double, x1 double, y1 double, width double, height double"


def test_what_blocks_lack_is_made_at_the_document(spark):
    box = (0.0, 0.0, 306.0, 396.0, 612.0, 792.0)
    rows = [(1, 2, 0, "c", "z", "paragraph", "paragraph", None, "Arial", 9.0, None, *box), (1, 1, 1, "b", "y", "heading", "paragraph", 1, "Arial-Bold", 9.0, "#000000", *box), (1, 1, 0, "a", "x", "paragraph", "paragraph", 0, "Arial", 9.0, None, *box), (2, 1, 0, "d", None, "paragraph", "paragraph", 0, None, None, None, *box)]
    b = spark.createDataFrame(rows, ROW)
    t = spark.createDataFrame([(1, 1, 0, "t", *box)], "doc_id long, page_number int, table_idx int, id string, x0 double, y0 double, x1 double, y1 double, width double, height double")
    pages = b.select("doc_id", "page_number", "width", "height").distinct()
    plain, plain_t = b.drop("width", "height"), t.drop("width", "height")
    for tables, plain_tables in ((None, None), (t, plain_t)):
        edges = assemble.reading_graph(assemble.emitted(plain, t if tables is not None else t.limit(0)))
        full = assemble.rendered(assemble.boxed(assemble.with_style(plain), pages))
        before = {r.doc_id: json.loads(r.json) for r in assemble.document_json(pages, full, edges, "pdf", tables=plain_tables).collect()}
        late = {r.doc_id: json.loads(r.json) for r in assemble.document_json(None, b, None, "pdf", tables=tables).collect()}
        assert late == before and len(late[1]["reading_graph"]) == 2 + (tables is not None) and "reading_graph" not in late[2]


def test_one_exchange_and_one_reading(spark):
    for query in (queries.doc_tokens, queries.doc_json_blocks, queries.doc_json_parts, queries.doc_assemble_counts):
        df = query(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
        assert plan.count("Exchange") == 1 and plan.count("Scan parquet") == 1
        assert not any("Filter" in line and "json" in line.lower() for line in plan.split("\n"))
    assert queries.doc_tokens(spark, "/root/testdata/sf0.001").agg(F.count("place")).first()[0] > 0
