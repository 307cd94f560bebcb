"""Tags, layout, assembly, trees, exports and sources on small inputs."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import assemble, docx_layout, semantics, tree
from quire.schema import BLOCK_TYPES, page_problems, quarantine
from quire.sources import docx, html, marker
from quire.streaming import arrivals

BLOCK = "doc_id long, page_number int, block_idx int, id string, text string"
TAG = "doc_id long, page_number int, tag_pos int, block_index int, block_type string, role string, reading_order int, text string, rhetoric string, rhetoric_features string"


def test_last_tag_wins_and_illegal_becomes_paragraph(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "x"), (1, 1, 1, "b", "y"), (1, 1, 2, "c", "z")], BLOCK)
    t = spark.createDataFrame([(1, 1, 0, 0, "heading", "title", 0, None, None, None), (1, 1, 1, 0, "caption", "caption", -1, None, None, None), (1, 1, 2, 1, "banner", "hero", 5, None, None, None), (1, 1, 3, None, "figure", "figure", 0, None, None, None)], TAG)
    got = {r.block_idx: (r.block_type, r.role, r.reading_order) for r in semantics.match_by_index(b, t).collect()}
    assert got == {0: ("caption", "caption", 0), 1: ("paragraph", "paragraph", 5), 2: ("paragraph", "paragraph", 2)}


def test_fuzzy_match_consumes_tags(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "Total revenue"), (1, 1, 1, "b", "Total revenue"), (1, 1, 2, "c", "abc"), (1, 1, 3, "d", "")], BLOCK)
    t = spark.createDataFrame([(1, 1, 0, 900, "heading", "title", 0, "Total Revenue", None, None), (1, 1, 1, 901, "caption", "caption", 0, "xyz", None, None)], TAG)
    got = {r.block_idx: (r.tag_pos, r.ratio) for r in semantics.match_by_text(b, t).collect()}
    assert got == {0: (0, 0.923077), 1: (None, None), 2: (None, None), 3: (None, None)}


@pytest.mark.parametrize("n", [199, 200])
def test_fuzzy_match_at_the_popular_element_limit(spark, n):
    a = ("abcdefghij" * 30)[:n]
    c = ("abcdefghij" * 30)[5 : 5 + n]
    b = spark.createDataFrame([(1, 1, 0, "a", a)], BLOCK)
    t = spark.createDataFrame([(1, 1, 0, 900, "heading", "title", 0, c, None, None)], TAG)
    want = SequenceMatcher(None, a, c).ratio()
    got = semantics.match_by_text(b, t).first()
    assert (got.tag_pos is not None) == (want > 0.4)


def test_fallbacks(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "x", 16.0, "Arial")], BLOCK + ", size double, fontname string")
    kinds = {c: tuple(semantics.fallback(b, c).select("block_type", "role").first()) for c in ("no_vision", "vision_error", "no_tags")}
    assert kinds == {"no_vision": ("heading", "section_title"), "vision_error": ("heading", "paragraph"), "no_tags": ("paragraph", "paragraph")}


def test_tagger_errors_become_rows(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "x", 16.0, "Arial"), (2, 1, 0, "a", "x", 16.0, "Arial")], BLOCK + ", size double, fontname string")

    def tagger(pdf):
        if pdf["doc_id"].iloc[0] == 2:
            raise RuntimeError("no key")
        return semantics.heuristic_tagger(pdf)

    got = {r.doc_id: (r.block_type, r.error) for r in semantics.tag_pages(semantics.blocks_summary(b), tagger).collect()}
    assert got == {1: ("heading", None), 2: ("Error", "no key")}


def test_batches(spark):
    b = spark.range(120).select(F.lit(1).alias("doc_id"), F.col("id").alias("i"))
    got = semantics.batches(b, ["i"])
    assert [r.n for r in got.groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()] == [50, 50, 20]
    assert got.filter("i = 50").first().batch_idx == 0


PARA = "doc_id long, elem_idx int, kind string, style_name string, text string, font_name string, font_size double, bold boolean, italic boolean, n_rows int"


def test_cursor(spark):
    p = spark.createDataFrame([(1, 0, "p", "", "a" * 100, "A", 11.0, False, False, 0), (1, 1, "p", "", " ", "A", 11.0, False, False, 0), (1, 2, "tbl", "", "", "A", 11.0, False, False, 3), (1, 3, "p", "", "b", "A", 11.0, False, False, 0)], PARA)
    got = {r.elem_idx: (r.y0, r.y1) for r in docx_layout.lay_out(p).collect()}
    assert got[0] == (36.0, 65.42)
    assert got[2] == (75.82, 135.82) and got[3][0] == 147.82 and 1 not in got


def test_wrap(spark):
    text = " ".join("x" * n for n in (40, 20, 40, 3))
    p = spark.createDataFrame([(1, 0, "p", "", text, "A", 11.0, False, False, 0)], PARA)
    got = [(r.wx0, r.wx1) for r in docx_layout.wrap_words(docx_layout.lay_out(p)).orderBy("word_idx").collect()]
    assert got == [(72.0, 314.0), (317.3, 438.3), (441.6, 540.0), (72.0, 90.15)]


def test_pagination(spark):
    rows = spark.createDataFrame([(1, 791.99, 800.0), (1, 792.0, 800.0), (1, 780.0, 810.0)], "doc_id long, y0 double, y1 double")
    got = [(r.page_number, r.y0, r.y1) for r in docx_layout.paginate(rows).orderBy("y1", "y0").collect()]
    assert got == [(1, 791.99, 800.0), (2, 0.0, 8.0), (1, 780.0, 810.0)] or sorted(got) == sorted([(1, 791.99, 800.0), (2, 0.0, 8.0), (1, 780.0, 810.0)])
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert docx_layout.pages_of(rows, docs).groupBy("doc_id").count().orderBy("doc_id").collect()[1]["count"] == 1


def test_edges_and_json(spark):
    b = spark.createDataFrame([(1, 1, 0, "a", "x", 0), (1, 1, 1, "b", "y", 1), (1, 2, 0, "c", "z", 0)], BLOCK + ", reading_order int")
    t = spark.createDataFrame([(1, 1, 0, "t")], "doc_id long, page_number int, table_idx int, id string")
    e = assemble.reading_graph(assemble.emitted(b, t))
    assert sorted((r["from"], r["to"]) for r in e.collect()) == [("a", "b"), ("b", "t"), ("t", "c")]
    full = b.selectExpr("*", "'paragraph' as block_type", "'paragraph' as role", "'Arial' as fontname", "12.0D as size", "'#000000' as color", "0D as x0", "0D as y0", "61.2D as x1", "79.2D as y1")
    pages = b.select("doc_id", "page_number").distinct().selectExpr("*", "612D as width", "792D as height")
    doc = assemble.document_json(pages, assemble.rendered(assemble.boxed(assemble.with_style(full), pages)), e, "pdf")
    got = json.loads(doc.first().json)
    assert got["document"]["schema_version"] == "3.0" and got["document"]["page_count"] == 2
    assert [x["id"] for x in got["blocks"]] == ["a", "b", "c"] and got["blocks"][0]["html"] == "<p>x</p>" and got["blocks"][0]["html_template"] == "<p>{{text}}</p>"
    assert got["blocks"][0]["type"] in BLOCK_TYPES and list(got["styles"]) == ["3a8719b31ac6"]
    assert got["spans"][0]["id"] == "s-a" and got["blocks"][0]["bbox_norm"] == [0.0, 0.0, 0.1, 0.1]


def test_quarantine(spark):
    good, bad = quarantine(spark.createDataFrame([(1, 612.0, 792.0), (0, 612.0, 0.0)], "page_number int, width double, height double"), page_problems())
    assert good.count() == 1 and bad.first().problems == ["page_number", "height"]


TREE = "doc_id long, page_number int, path array<int>, id string, block_type string, content string, html string, list_type string, heading_level int, blockquote boolean, bbox array<double>"


def tree_rows(spark):
    rows = [
        (1, 1, [0], "h", "SectionHeader", "A & B", "", None, 9, False, None),
        (1, 1, [0, 0], "h0", "Text", "note", "", None, None, True, None),
        (1, 1, [1], "l", "List", "", "", "ordered", None, False, None),
        (1, 1, [1, 0], "x", "ListItem", "one", "", None, None, False, None),
        (1, 1, [2], "x", "Table", "", "", None, None, False, None),
        (1, 1, [2, 0], "r", "Text", "", "", None, None, False, None),
        (1, 1, [2, 0, 0], "c", "Text", "<1>", "", None, None, False, None),
        (1, 2, [3], "q", "Equation", "e", "", None, None, False, [1.0, 2.0, 3.0, 4.0]),
        (1, 2, [4], "z", "Text", "", "", None, None, False, None),
    ]
    return spark.createDataFrame(rows, TREE)


def test_tree(spark):
    b = tree_rows(spark)
    assert [r.id for r in tree.flattened(b).orderBy("page_number", "dfs_idx").collect()] == ["h", "h0", "l", "x", "x", "r", "c", "q", "z"]
    m = tree.metrics(b).first()
    assert (m.n_pages, m.n_blocks, m.n_editable, m.n_types) == (2, 5, 5, 5)
    e = spark.createDataFrame([(1, "x", ""), (1, "q", "new"), (1, "__title__", "T")], "doc_id long, block_id string, new_content string")
    every = {tuple(r.path): r.content for r in tree.apply_edits(b, e).collect()}
    assert every[1, 0] == "" and every[2,] == "" and every[3,] == "new"
    first = {tuple(r.path): r.content for r in tree.apply_first(b.withColumn("content", F.when(F.col("id") == "x", "old").otherwise(F.col("content"))), e).collect()}
    assert first[1, 0] == "" and first[2,] == "old"
    assert tree.edited_titles(spark.createDataFrame([(1, "a")], "doc_id long, title string"), e).first().title == "T"
    assert "html" not in tree.without_html(b).columns and tree.emptied(b).filter("content <> ''").count() == 0
    assert tree.overlay_plan(b).first().page_index == 1


def test_html_export(spark):
    got = tree.export_html(tree_rows(spark), spark.createDataFrame([(1, "")], "doc_id long, title string")).first().html
    body = got.split("<body>\n")[1]
    want = ["<div class='page' id='page-1'>", "<h6>A &amp; B</h6>", tree.CHILDREN_OPEN, "<blockquote><p>note</p></blockquote>", "</div>", "<ol>", "<li>one</li>", "</ol>", "<table>", "<tr>", "<td>&lt;1&gt;</td>", "</tr>", "</table>", "</div>", tree.PAGE_BREAK, "<div class='page' id='page-2'>", "<div class='equation'>\\[ e \\]</div>", "</div>", "</body>", "</html>"]
    assert body.split("\n") == want and "<title>Document</title>" in got


def test_paging(spark):
    b = spark.range(36).select(F.lit(1).alias("doc_id"), F.col("id").alias("ordinal"), F.concat(F.lit("page_0/Text/"), "id").alias("id"), F.array(F.lit("page_0/ListItem/1")).alias("child_ids"))
    got = tree.paged(b).orderBy("ordinal").collect()
    assert got[34].id == "page_0/Text/34" and got[35].id == "page_1/Text/35" and got[35].child_ids == ["page_1/ListItem/1"] and got[35].page_number == 2


def test_chunks(spark):
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate((5000, 2000, 2000, 9000, 10, 10))], "k long, pos int, n int")
    assert [r.chunk for r in html.chunk_ids(rows, "k").orderBy("pos").collect()] == [0, 0, 1, 2, 3, 3]


def test_html_source(spark):
    page = "<html><body><h2 style='color: red; background-color: blue'>T</h2><nav>x</nav><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><th>2</th></tr><tr><td>3</td></tr></table><p> </p><p>q <b>r</b></p><blockquote>z</blockquote><pre>c\nd</pre></body></html>"
    pages = spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")
    rows = html.baseline_blocks(pages, body_only=True).filter("page_id = 1").collect()
    top = {r.path[0]: r for r in rows if len(r.path) == 1}
    assert [top[i].block_type for i in sorted(top)] == ["SectionHeader", "ListGroup", "Table", "Text", "Text", "Code"]
    assert top[0].heading_level == 2 and top[0].color == "red" and top[0].bg_color == "blue" and top[1].list_type == "unordered"
    assert (top[2].row_count, top[2].column_count) == (2, 2) and top[3].content == "q r" and top[4].blockquote and top[5].content == "c d"
    assert pages.select(html.clean_text_column("html").alias("t")).collect()[0].t == "T a b 1 2 3 q r z c d"
    assert sum(len(c.html) for c in html.chunks(pages).collect()) > 0


def test_docx_round_trip(spark):
    p = spark.createDataFrame([(1, 0, "p", "Heading2", "A <&> b", "Arial", 14.0, True, False, 0), (1, 1, "tbl", "", "", "", 11.0, False, False, 2)], PARA)
    got = docx.read_paragraphs(docx.write_paragraphs(p)).orderBy("elem_idx").collect()
    assert (got[0].text, got[0].style_name, got[0].font_name, got[0].font_size, got[0].bold, got[0].italic) == ("A <&> b", "Heading2", "Arial", 14.0, True, False)
    assert got[1].kind == "tbl" and got[1].n_rows == 2 and got[1].page_w == 612.0
    broken = docx.read_paragraphs(spark.createDataFrame([(7, bytearray(b"no zip"))], "doc_id long, content binary")).collect()
    assert [r.kind for r in broken] == ["error"]
    texts = [e["text"] for e in docx.elements(bytes(docx.export(tree_rows(spark)).first().content)) if e["kind"] == "p"]
    assert texts[:3] == ["A & B", "note", "one"] and "[Equation] e" in texts


def test_marker(spark):
    doc = {"children": [{"children": [{"id": "a", "block_type": "SectionHeader", "html": "<h3>T &amp; U</h3>"}, {"block_type": "Table", "html": "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>", "children": [{"block_type": "TableCell", "html": "<td>1</td>"}]}]}]}
    files = spark.createDataFrame([(1, json.dumps(doc)), (2, "{broken")], "doc_id long, json string")
    got = {tuple(r.path): r for r in marker.blocks(files).collect()}
    assert got[0,].heading_level == 3 and got[0,].content == "T & U" and got[1,].id == "page_0/Table/auto"
    assert (got[1,].row_count, got[1,].column_count) == (2, 2) and got[1, 0].block_type == "TableCell" and len(got) == 3


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "One two. Three.\nx")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    seen = []
    q = arrivals.each_batch(arrivals.documents(spark, str(tmp_path / "in")), arrivals.per_document, lambda df, n: seen.extend(df.collect()), str(tmp_path / "checkpoint"))
    q.awaitTermination(60)
    assert [(r.doc_id, r.n_lines) for r in seen] == [(1, 2)]


def test_display(spark):
    r = spark.range(1).select(tree.badge(F.lit("Text")).alias("b"), tree.icon(F.lit("?")).alias("i"), tree.field_height(F.lit("x" * 301)).alias("h"), tree.metric_card(F.lit(3), "Pages").alias("m")).first()
    assert "#00B894" in r.b and r.i == "📦" and r.h == 150 and ">3</div>" in r.m
