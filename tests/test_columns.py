"""Characters of PDF pages as columns, files packed without a pandas group."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.sources import pdf, scans


def test_characters_are_columns(spark):
    data = pdf.pack([[(36.0, 50.0, "Hello (world)", 12.0), (36.0, 70.0, "again", 10.0)], [], [(1.0, 2.0, "end", 8.0)]])
    pages = list(pdf.pages(data))
    first = pages[0]["chars"]
    assert isinstance(first, pdf.Chars) and len(first.runs) == 2 and first.lengths() == [13, 5]
    assert first[13]["text"] == "a" and first[-1] == list(first)[17] and first[:2] == list(first)[:2] and pages[1]["chars"] == []
    batch = scans._page_batch([p | {"doc_id": 1, "chars": scans._chars(p["chars"])} for p in pages] + [{"doc_id": 1, "error": "x"}])
    plain = scans._page_batch([p | {"doc_id": 1, "chars": scans._chars(list(p["chars"]))} for p in pages] + [{"doc_id": 1, "error": "x"}])
    assert batch == plain and batch.column("chars").to_pylist()[3] is None and batch.column("chars").to_pylist()[0] == list(first)


def test_level_text_is_placed_as_turned_text_is():
    """Text that is turned a quarter and back is placed character by character; level text at once."""

    def page(matrix: bytes) -> dict:
        content = matrix + b" cm BT /F0 10 Tf 2 Tc 3 Tw 80 Tz 1.5 Ts 1 0 0 1 20 30 Tm (A b) Tj -7 (c) Tj ET"
        return next(pdf.pages(pdf.pack([[]]).replace(b"/Contents 5 0 R", b"/Contents 9 0 R") + b"9 0 obj <</Length %d>>stream\n%s\nendstream endobj" % (len(content), content)))

    level, turned, mirrored = page(b"1 0 0 1 0 0")["chars"], page(b"0 1 -1 0 0 0")["chars"], page(b"-1 0 0 1 0 0")["chars"]
    assert [c["text"] for c in level] == list("A bc") and len(level.runs) == 2 and len(turned.runs) == 4
    assert [round(792 - c["y1"], 6) for c in turned] == [round(c["x0"], 6) for c in level]
    assert [(round(-c["x1"], 6), round(-c["x0"], 6)) for c in mirrored] == [(round(c["x0"], 6), round(c["x1"], 6)) for c in level]


def test_files_are_packed_by_document(spark):
    rows = spark.createDataFrame([(1, 2, 36.0, 50.0, "b", 10.0), (1, 1, 36.0, 64.0, "y", 10.0), (1, 1, 36.0, 50.0, "x", 10.0), (2, 1, 36.0, 50.0, "z", 10.0)], "doc_id long, page_number int, x double, y double, text string, size double")
    files = scans.write_pages(rows)
    assert "InPandas" not in files._jdf.queryExecution().optimizedPlan().toString()
    read = scans.read_pages(files).orderBy("doc_id", "page_number")
    assert [(r.doc_id, r.page_number, r.t) for r in read.select("doc_id", "page_number", F.array_join("chars.text", "").alias("t")).collect()] == [(1, 1, "xy"), (1, 2, "b"), (2, 1, "z")]
