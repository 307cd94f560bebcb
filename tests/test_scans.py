"""PDF files, page images, structured calls, the gate for edits."""

from __future__ import annotations

import json
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import gate
from quire.plans import pipelines
from quire.sources import docx, pdf, scans


def file(*objects: bytes, tail: bytes = b"trailer <</Root 1 0 R>>") -> bytes:
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + tail


def stream(data: bytes, more: bytes = b"") -> bytes:
    return b"<</Length %d%s>>\nstream\n%s\nendstream" % (len(data), more, data)


def page(content: bytes, resources: bytes = b"<</Font<</F 4 0 R>>>>", font: bytes = b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica>>", more: bytes = b"", *objects: bytes) -> dict:
    data = file(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Kids[3 0 R]/MediaBox[0 0 200 100]/Resources %s>>" % resources, b"<</Type/Page/Contents 5 0 R%s>>" % more, font, stream(content), *objects)
    return next(pdf.pages(data))


def text(p: dict) -> str:
    return "".join(c["text"] for c in p["chars"])


def test_pdf_characters():
    p = page(rb"BT /F 10 Tf 20 50 Td (A\(b\)\101) Tj ET 1 0 0 rg BT /F 20 Tf 1 0 0 1 100 10 Tm [(A) -1000 (i)] TJ T* ET")
    assert (p["width"], p["height"], text(p)) == (200.0, 100.0, "A(b)AAi")
    a, big, i = p["chars"][0], p["chars"][5], p["chars"][6]
    assert (a["x0"], round(a["x1"], 2), round(a["y0"], 2), round(a["y1"], 2), round(a["size"], 2), a["fontname"], a["color"]) == (20.0, 26.67, 42.07, 52.07, 10.0, "Helvetica", [0.0])
    assert big["color"] == [1.0, 0.0, 0.0] and round(i["x0"] - big["x1"], 2) == 20.0


def test_pdf_fonts():
    named = page(b"BT /F 10 Tf (\x01\x02\x03) Tj ET", font=b"<</Type/Font/Subtype/TrueType/BaseFont/X/FirstChar 1/Widths[500 600 700]/Encoding<</Differences[1/eacute/uni20AC/nothing.known]>>>>")
    assert text(named) == "é€�" and [round(c["x1"] - c["x0"], 2) for c in named["chars"]] == [5.0, 6.0, 7.0]
    cmap = b"1 begincodespacerange <0000> <ffff> endcodespacerange 1 beginbfchar <0001> <00660066> endbfchar 1 beginbfrange <0002> <0003> <0061> endbfrange"
    two = page(b"BT /F 10 Tf <000100020003> Tj ET", b"<</Font<</F 4 0 R>>>>", b"<</Type/Font/Subtype/Type0/BaseFont/Y/DescendantFonts[<</W[1[250] 2 3 400]>>]/ToUnicode 6 0 R>>", b"", stream(zlib.compress(cmap), b"/Filter/FlateDecode"))
    assert [c["text"] for c in two["chars"]] == ["ff", "a", "b"] and [round(c["x1"] - c["x0"], 2) for c in two["chars"]] == [2.5, 4.0, 4.0]


def test_pdf_structure():
    turned = page(b"BT /F 10 Tf 20 50 Td (A) Tj ET", more=b"/Rotate 90")
    assert (turned["width"], turned["height"]) == (100.0, 200.0) and round(turned["chars"][0]["y0"], 2) == 20.0
    form = page(b"q 2 0 0 2 0 0 cm /X Do Q /X Do", b"<</Font<</F 4 0 R>>/XObject<</X 6 0 R>>>>", b"<</Type/Font/Subtype/Type1/BaseFont/Courier>>", b"", stream(b"BT /F 10 Tf 1 10 Td (A) Tj ET", b"/Subtype/Form"))
    assert [(c["x0"], round(c["size"], 2)) for c in form["chars"]] == [(2.0, 20.0), (1.0, 10.0)]
    itself = page(b"/X Do", b"<</Font<</F 4 0 R>>/XObject<</X 6 0 R>>>>", b"<</BaseFont/Courier>>", b"", stream(b"BT /F 10 Tf (A) Tj ET /X Do", b"/Subtype/Form"))
    assert len(itself["chars"]) == pdf.FORM_DEPTH
    inline = page(b"BI /W 1 /H 1 ID (\xff((( EI BT /F 10 Tf (A) Tj ET")
    assert text(inline) == "A"
    packed = b"1 0 2 30 <</Type/Catalog/Pages 2 0 R>>     <</Type/Pages/Kids[3 0 R]>>"
    first = packed.index(b"<<")
    whole = b"%PDF-1.7\n9 0 obj\n" + stream(zlib.compress(packed[:first] + packed[first:].replace(b"     ", b" ", 1)), b"/Type/ObjStm/N 2/First %d/Filter/FlateDecode" % first) + b"\nendobj\n3 0 obj <</Type/Page>> endobj\n8 0 obj " + stream(b"", b"/Type/XRef/Root 1 0 R") + b" endobj"
    assert [(p["width"], p["chars"]) for p in pdf.pages(whole)] == [(612.0, [])]
    for bad in (b"", b"no file", b"%PDF-1.4 nothing", file(b"<</Type/Catalog>>", tail=b"trailer <</Root 1 0 R/Encrypt 2 0 R>>")):
        with pytest.raises(ValueError):
            list(pdf.pages(bad))
    loop = file(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[2 0 R 3 0 R]>>", b"<</Type/Page>>")
    assert len(list(pdf.pages(loop))) == 1
    whole = pdf.pack([[(10.0, 20.0, "long", 10.0)]])
    for cut in range(0, len(whole), 7):
        try:
            list(pdf.pages(whole[:cut]))
        except (ValueError, zlib.error):
            pass


def test_pdf_tables():
    rules = b"".join(b"%d 10 m %d 90 l S " % (x, x) for x in (20, 60, 120)) + b"".join(b"20 %d 100 0.5 re f " % y for y in (10, 50, 90))
    p = page(rules + b"BT /F 8 Tf 1 0 0 1 25 70 Tm (one) Tj 1 0 0 1 70 70 Tm (two) Tj 1 0 0 1 70 60 Tm (more words) Tj 1 0 0 1 25 20 Tm (x) Tj 1 0 0 1 150 20 Tm (out) Tj ET")
    assert [t["cells"] for t in p["tables"]] == [[["one", "two\nmore words"], ["x", ""]]]
    assert [round(v) for v in (p["tables"][0][k] for k in ("x0", "x1"))] == [20, 120]
    merged = page(b"20 10 100 80 re S 20 50 m 120 50 l S 60 10 m 60 50 l S")
    assert merged["tables"][0]["cells"] == [["", None], ["", ""]]
    assert page(b"20 10 100 80 re S")["tables"] == [] and page(b"20 10 100 80 re n")["tables"] == []


def test_read_pages(spark):
    good = pdf.pack([[(36.0, 50.0, "Hello world", 12.0)], []])
    cut = file(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[3 0 R 4 0 R]>>", b"<</Type/Page>>", b"<</Type/Page/Contents 5 0 R>>", stream(b"x", b"/Filter/LZWDecode"))
    f = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"?")), (3, bytearray(cut)), (4, None)], "doc_id long, content binary")
    read = scans.read_pages(f).cache()
    assert sorted(map(tuple, scans.pages_of(read).collect())) == [(1, 1, 612.0, 792.0), (1, 2, 612.0, 792.0), (3, 1, 612.0, 792.0)]
    assert sorted(r.doc_id for r in scans.errors_of(read).collect()) == [2, 3, 4]
    chars = scans.chars_of(read).orderBy("char_idx").collect()
    assert "".join(c.text for c in chars) == "Hello world" and {c.color for c in chars} == {"#000000"}
    assert scans.read_pages(f.limit(0)).count() == 0 and scans.tables_of(read).count() == 0

    def own(content: bytes):
        yield {"page_number": 1, "width": 1.0, "height": 1.0, "chars": [], "tables": [{"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "cells": [["a", None]]}, {"x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "cells": []}]}

    assert [r.cells for r in scans.tables_of(scans.read_pages(f.limit(1), own)).collect()] == [[["a", None]]]


def test_convert_pdf_and_images(spark, tmp_path):
    rules = b"".join(b"%d 10 m %d 90 l S " % (x, x) for x in (20, 60, 120)) + b"".join(b"20 %d 100 0.5 re f " % y for y in (10, 50, 90))
    body = stream(rules + b"BT /F 8 Tf 1 0 0 1 25 70 Tm (in) Tj 1 0 0 1 20 150 Tm (Outside text) Tj ET")
    (tmp_path / "a.pdf").write_bytes(file(b"<</Type/Catalog/Pages 2 0 R>>", b"<</Kids[3 0 R]>>", b"<</Type/Page/MediaBox[0 0 200 200]/Contents 5 0 R/Resources<</Font<</F 4 0 R>>>>>>", b"<</BaseFont/Helvetica>>", body))
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.png").write_bytes(b"\x89PNG")
    done, rest = pipelines.convert(spark, str(tmp_path))
    docs = [json.loads(r.json) for r in done.collect()]
    assert [[b["text"] for b in d["blocks"]] for d in docs] == [["Outside text", "[TABLE]"]]
    assert [c["text"] for c in docs[0]["tables"][0]["cells"]] == ["in", "", "", ""]
    assert sorted((r.reader, bool(r.error)) for r in rest.collect()) == [("image", False), ("pdf", True)]

    def model(payload, number):
        return [{"id": f"page_{number - 1}/Text/0", "block_type": "Text", "content": payload}]

    done, rest = pipelines.convert(spark, str(tmp_path), extractor=model)
    assert [b["content"] for r in done.collect() for b in json.loads(r.json)["blocks"] if json.loads(r.json)["document"]["source"] == "image"] == ["iVBORw=="]
    assert [r.reader for r in rest.collect()] == ["pdf"]


def test_called_blocks(spark):
    word = docx.pack(docx.paragraph("A & b", "Heading 2") + docx.paragraph("x", "List Bullet") + docx.paragraph("y", "List Bullet", bold=True) + docx.table([["1", "<"]]))
    f = spark.createDataFrame([(1, "docx", bytearray(word)), (2, "html", bytearray(b"<body><p>hi</p><script>x</script></body>")), (3, "image", bytearray(b"abc"))], "doc_id long, reader string, content binary")
    html = docx.as_html(docx.read_paragraphs(f.filter("doc_id = 1"))).first().html
    assert html == "<h2>A &amp; b</h2><ul><li>x</li><li><strong>y</strong></li></ul><table><tr><td><p>1</p></td><td><p>&lt;</p></td></tr></table>"

    def model(payload, number):
        if "hi" in payload:
            raise RuntimeError("no key")
        return [{"id": "a", "block_type": "Text", "content": payload}]

    blocks, seen = scans.watched(pipelines.called_blocks(f, model))
    got = {r.doc_id: (r.page_number, r.block_type, r.content) for r in blocks.collect()}
    assert got == {1: (1, "Text", html), 2: (1, "Error", scans.FAILED["html"] + "no key"), 3: (1, "Text", "YWJj")}
    assert seen.get == {"pages": 3, "failed": 1}


def test_images_and_engines(spark):
    f = spark.createDataFrame([(1, 1, "image", bytearray(b"a")), (2, 3, "pdf", bytearray(b"b"))], "doc_id long, page_number int, reader string, content binary")
    drawn = scans.page_images(f, lambda content, number, dpi: content + f"{number}@{dpi}".encode(), 96)
    assert {r.doc_id: bytes(r.image) for r in drawn.collect()} == {1: b"a", 2: b"b3@96"}
    assert {r.doc_id: r.error for r in scans.page_images(f).collect()} == {1: None, 2: "no renderer"}
    assert scans.engine(("a", None), ("b", len))[0] == "b"
    with pytest.raises(ValueError):
        scans.engine(("a", None))
    calls = []
    make = lambda *o: calls.append(o) or o
    assert scans.made(make, 1) == scans.made(make, 1) == (1,) and len(calls) == 1


def test_gate(spark):
    block = '{"title":"T","pages":[{"page_number":%s,"blocks":[{"id":"a","block_type":"Text"%s}]}]}'
    cases = {
        "{}": None,
        block % ("1", ""): None,
        block % ('"2"', ',"properties":null,"bbox":[1,2.5],"children":[{"id":"b","block_type":"Text","children":[]}]'): None,
        "[1]": ["json"],
        "{": ["json"],
        '{"title":1}': ["document"],
        '{"pages":{}}': ["document"],
        block % ("true", ""): ["page"],
        block % ("null", ""): ["page"],
        block % ("1", ',"content":null'): ["block"],
        block % ("1", ',"bbox":["x"]'): ["block"],
        block % ("1", ',"properties":[]'): ["block"],
        block % ("1", ',"children":[{"id":"b","block_type":"Text","children":[{"id":1,"block_type":"Text"}]}]'): ["block"],
    }
    edits = spark.createDataFrame(list(enumerate(cases)), "doc_id long, json string")
    old = spark.range(len(cases) + 1).select(F.col("id").alias("doc_id"), F.lit("old").alias("json"))
    got = {r.doc_id: (r.json, r.reasons) for r in gate.gated(old, edits).collect()}
    assert got == {i: (j if why is None else "old", why) for i, (j, why) in enumerate(cases.items())} | {len(cases): ("old", None)}
