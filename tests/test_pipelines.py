from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire import cli
from quire.plans import pipelines
from quire.schema import CHAR
from quire.sources import docx


def chars(spark):
    rows = []
    for page in (1, 2, 3):
        for line, word in enumerate(("Title", "body", "more")):
            size = 16.0 if line == 0 else 12.0
            rows += [(1, page, 100 * line + i, c, 72.0 + 6 * i, 72.0 + 60 * line, 78.0 + 6 * i, 72.0 + 60 * line + size, "Arial", size, "#000000") for i, c in enumerate(word)]
    return spark.createDataFrame(rows, CHAR)


def pages(spark):
    return spark.createDataFrame([(1, p, 612.0, 792.0) for p in (1, 2, 3)], "doc_id long, page_number int, width double, height double")


def test_layout_document(spark):
    got = json.loads(pipelines.layout_document(chars(spark), pages(spark), page_range="1,3-9").first().json)
    assert got["document"]["page_count"] == 2 and [b["text"] for b in got["blocks"]] == ["Title", "body", "more"] * 2
    assert [b["type"] for b in got["blocks"]][:2] == ["heading", "paragraph"] and len(got["reading_graph"]) == 5 and len(got["styles"]) == 2
    t = spark.createDataFrame([(1, 1, 0, "t", 0.0, 120.0, 612.0, 160.0, [["a", " b "], ["c"]])], "doc_id long, page_number int, table_idx int, id string, x0 double, y0 double, x1 double, y1 double, cells array<array<string>>")
    for tables, n in ((t, 3), (t.drop("cells"), 0)):
        got = json.loads(pipelines.layout_document(chars(spark), pages(spark), tables=tables).first().json)
        assert len(got["blocks"]) == 9 and len(got["spans"]) == 8
        ids = [b["id"] for b in got["blocks"]]
        at = got["blocks"][ids.index("t")]
        assert (ids.index("t"), at["reading_order"], at["type"], at["text"]) == (2, 2, "table", "[TABLE]")
        assert sorted((e["from"], e["to"]) for e in got["reading_graph"]) == sorted(zip(ids, ids[1:]))
        assert len(got["tables"]) == 1 and len(got["tables"][0]["cells"]) == n
        if n:
            x = got["tables"][0]
            assert (x["rows"], x["cols"], x["page"]) == (2, 2, 1)
            assert [(c["row"], c["col"], c["text"], c["bbox"]) for c in x["cells"]] == [(0, 0, "a", [0.0, 120.0, 306.0, 140.0]), (0, 1, "b", [306.0, 120.0, 612.0, 140.0]), (1, 0, "c", [0.0, 140.0, 306.0, 160.0])]
    none = pipelines.layout_document(chars(spark).limit(0), pages(spark).limit(0))
    assert none.count() == 0


def test_docx(spark, tmp_path):
    body = docx.paragraph("Annual report", "Heading1", "Arial", 16) + docx.paragraph("Some text") + docx.table([["a", "b"], ["c", "d"]])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_b.docx").write_bytes(docx.pack(body))
    (tmp_path / "in" / "x.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "y.zzz").write_bytes(b"?")
    (tmp_path / "in" / "bad.docx").write_bytes(b"no archive")
    (tmp_path / "in" / "p.html").write_text("<html><body><div><h2>Head</h2><p style='COLOR: red; background-color:blue'>Text</p></div></body></html>")
    (tmp_path / "in" / "m.json").write_text(json.dumps({"children": [{"children": [{"id": "a", "block_type": "Text", "html": "<p>one</p>", "children": [{"id": "b", "children": [{"id": "c", "children": [{"id": "d", "html": "deep"}]}]}]}]}]}))
    done, rest = pipelines.convert(spark, str(tmp_path / "in"))
    by_source = {x["document"]["source"]: x for x in (json.loads(r.json) for r in done.collect())}
    assert sorted(by_source) == ["docx", "html", "marker"]
    assert [(b["block_type"], b["content"], b.get("color"), b.get("bg_color")) for b in by_source["html"]["blocks"]] == [("SectionHeader", "Head", None, None), ("Text", "Text", "red", "blue")]
    assert [(b["id"], b["path"]) for b in by_source["marker"]["blocks"]] == [("a", [0]), ("b", [0, 0]), ("c", [0, 0, 0]), ("d", [0, 0, 0, 0])]
    got = by_source["docx"]
    assert got["document"]["source"] == "docx" and [(b["type"], b["role"]) for b in got["blocks"]] == [("heading", "section_title"), ("paragraph", "paragraph"), ("table", "table")]
    assert [c["text"] for c in got["tables"][0]["cells"]] == ["a", "b", "c", "d"]
    assert len(got["reading_graph"]) == 2
    assert sorted((r.reader, bool(r.error)) for r in rest.collect()) == [("docx", True), ("pdf", True), ("quarantine", False)]
    f = pipelines.files(spark, str(tmp_path / "in"), "docx").filter("path LIKE '%a_b%'")
    assert pipelines.titles(f).first().title == "A B"
    tree = pipelines.docx_blocks(docx.read_paragraphs(f)).orderBy("path").collect()
    assert [r.block_type for r in tree if len(r.path) == 1] == ["SectionHeader", "Text", "Table"] and [r.content for r in tree if len(r.path) == 3] == ["a", "b", "c", "d"]
    assert tree[0].heading_level == 1 and tree[0].id == "page_0/SectionHeader/0"
    cli.main([str(tmp_path / "in"), "-o", str(tmp_path / "out"), "--indent", "2"])
    assert spark.read.text(str(tmp_path / "out")).filter(F.col("value").contains("schema_version")).count() == 1
    assert spark.read.json(str(tmp_path / "out-rest")).count() == 3


def scanned(df):
    """Binary scans of a plan, and whether each reads contents."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [("content" in line.split("ReadSchema")[-1]) for line in plan.split("\n") if "Format: BinaryFile" in line or "FileScan binaryFile" in line]


def test_convert_opens_each_file_once_and_only_its_own(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    names = ["a.PDF", "b.Docx", "c.htm", "sub/d.HTML", "e.json", "f.png", "g.zzz", "h.doc", "json", "i.jsonx"]
    for n in names:
        (tmp_path / n).write_bytes(b"{}" if n == "e.json" else b"<p>x</p>")
    own = {"pdf": ["a.PDF"], "docx": ["b.Docx", "h.doc"], "html": ["c.htm", "d.HTML"], "json": ["e.json"], "image": ["f.png"]}
    for reader, want in own.items():
        f = pipelines.files(spark, str(tmp_path), reader)
        assert sorted(x.rsplit("/", 1)[1] for x in f.inputFiles()) == want
        assert sorted(r.path.rsplit("/", 1)[1] for r in f.collect()) == want
    every = pipelines.listed(spark, str(tmp_path))
    assert every.count() == len(names) and scanned(every) == [False]
    assert {r.path.rsplit("/", 1)[1]: r.reader for r in every.collect()} == {x: k for k, v in own.items() for x in v} | {"g.zzz": "quarantine", "json": "quarantine", "i.jsonx": "quarantine"}
    done, rest = pipelines.convert(spark, str(tmp_path))
    assert scanned(done) == [True, True]  # HTML and JSON; PDF and DOCX are tables by now
    assert True not in scanned(rest)
    assert done.count() == 2 and sorted((r.path.rsplit("/", 1)[1], bool(r.error)) for r in rest.collect()) == [("a.PDF", True), ("b.Docx", True), ("f.png", False), ("g.zzz", False), ("h.doc", True), ("i.jsonx", False), ("json", False)]


def test_convert_of_an_empty_folder(spark, tmp_path):
    (tmp_path / "x.zzz").write_text("?")
    (tmp_path / "empty.pdf").write_text("")  # Spark's file sources leave files of no bytes out
    done, rest = pipelines.convert(spark, str(tmp_path))
    assert done.count() == 0 and rest.count() == 1
