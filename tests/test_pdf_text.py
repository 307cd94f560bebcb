"""Text objects of one string are placed together; extents of a page are those of its characters."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import queries
from quire.sources import pdf, scans


def page(content: bytes) -> list[dict]:
    data = pdf.pack([[]]).replace(b"/Contents 5 0 R", b"/Contents 9 0 R") + b"9 0 obj <</Length %d>>stream\n%s\nendstream endobj" % (len(content), content)
    return list(next(pdf.pages(data))["chars"])


def test_strings_are_placed_together_as_one_by_one(monkeypatch):
    show = b"BT /F0 %s Tf %s Tm (%s) Tj ET"
    strings = [(b"10", b"1 0 0 1 36 742", b"Hello world"), (b"10", b".3 0 0 1.7 36.1 -7.", b"caf\xe9 \x81"), (b"9.5", b"-1 0 0 1 300 20", b"back"), (b"10", b"1 0 0 1 36 742", b""), (b"10", b"0 1 -1 0 50 60", b"up"), (b"10", b"1 0 0 1 1 2", b"x" * 300), (b"10", b"1 0 0 1 5 6", rb"a \(b\)")]
    whole = b"1 g 2 Tc 3 Tw 80 Tz 1.5 Ts .5 0 0 2 7 9 cm " + b"\n".join(show % s for s in strings) + b" BT /F9 1 Tf 1 0 0 1 0 0 Tm (no font) Tj ET 0 0 1 rg " + show % (b"8", b"1 0 0 1 9 9", b"end") + b" (more) Tj"
    calls = []
    kept = pdf.Page._place
    monkeypatch.setattr(pdf.Page, "_place", lambda self: (calls.append(len(self._held)), kept(self)))
    together = page(whole)
    assert max(calls) > 1 and together[-1]["text"] == "e" and together[-1]["color"] == [0.0, 0.0, 1.0]
    for name, value in (("HELD", 1), ("HELD_CHARS", 0)):
        monkeypatch.setattr(pdf, name, value)
        assert page(whole) == together
    # The same operators, one after another.
    assert page(whole.replace(b" Tj ET", b" Tj 0 Tr ET")) == together


def test_extents(spark):
    files = scans.write_pages(spark.createDataFrame([(1, 1, 36.0, 50.0, "ab", 10.0), (1, 1, 40.0, 64.0, "cde", 10.0), (1, 2, 36.0, 50.0, "", 10.0)], "doc_id long, page_number int, x double, y double, text string, size double"))
    files = files.unionByName(spark.createDataFrame([(2, bytearray(b"x")), (3, None)], files.schema))
    of = lambda f: lambda c: f(F.col("chars")[c])
    least, most = of(F.array_min), of(F.array_max)
    read = scans.read_pages(files)
    want = read.select("doc_id", "page_number", "width", "height", F.size("chars").alias("n_chars"), F.array_join("chars.text", "").alias("text"), least("x0"), least("y0"), most("x1"), most("y1"), "error")
    assert sorted(map(repr, map(tuple, scans.page_extents(files).collect()))) == sorted(map(repr, map(tuple, want.collect())))
    foreign = scans.page_extents(files, lambda content: [{"page_number": 1, "width": 1.0, "height": 1.0, "chars": [{"text": "ü", "x0": 1.0, "y0": 2.0, "x1": 3.0, "y1": 4.0}]}]).first()
    assert (foreign.n_chars, foreign.text, foreign.x0, foreign.y1) == (1, "ü", 1.0, 4.0)


def test_no_struct_for_a_character(spark):
    assert "chars" not in queries.pdf_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().replace("n_chars", "")
