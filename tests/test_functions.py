"""Rules of single values, against worked examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions.pages import clipped_pages, whole_range_pages


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(("font", "family", "clean"), [("Arial-BoldItalic", "Arial", "Arial-BoldItalic"), ("ABCDEF+Arial", "ABCDEF", "Arial"), ("Times,Italic", "Times", "Times,Italic"), ("Calibri-Regular", "Calibri", "Calibri-Regular")])
def test_fonts(spark, font, family, clean):
    assert one(spark, L.font_family(F.lit(font))) == family
    assert one(spark, L.clean_font(F.lit(font))) == clean


@pytest.mark.parametrize(
    ("text", "size", "font", "kind"),
    [("Intro", 14.0, "Arial", "heading"), ("Intro", 12.0, "Arial-Bold", "heading"), ("Intro", 11.9, "Arial-Bold", "paragraph"), ("42", 11.0, "Arial", "page_number"), (" 7 ", 11.0, "Arial", "page_number"), ("• x", 11.0, "Arial", "list_item"), ("- x", 11.0, "Arial", "list_item"), ("1. x", 11.0, "Arial", "list_item"), ("1.", 11.0, "Arial", "paragraph"), (" 1. x", 11.0, "Arial", "paragraph"), ("12. x", 11.0, "Arial", "paragraph"), ("plain", 11.0, "Arial", "paragraph")],
)
def test_block_type(spark, text, size, font, kind):
    assert one(spark, L.guess_block_type(F.lit(text), F.lit(size), F.lit(font))) == kind


@pytest.mark.parametrize(
    ("style", "size", "bold", "text", "kind"),
    [("title", 11.0, False, "x", "heading/title"), ("subtitle", 11.0, False, "x", "heading/title"), ("heading 2", 11.0, False, "x", "heading/section_title"), ("heading 3", 11.0, False, "x", "heading/subsection_title"), ("heading 10", 11.0, False, "x", "heading/section_title"), ("heading", 11.0, False, "x", "heading/section_title"), ("list bullet", 11.0, False, "x", "list_item/list_item"), ("caption", 11.0, False, "x", "caption/caption"), ("source code", 11.0, False, "x", "code_block/paragraph"), ("normal", 14.0, True, "x", "heading/section_title"), ("normal", 11.0, False, "- x", "paragraph/paragraph"), ("normal", 11.0, False, " 1) x", "list_item/list_item")],
)
def test_paragraph_class(spark, style, size, bold, text, kind):
    got = one(spark, L.classify_paragraph(F.lit(style), F.lit(size), F.lit(bold), F.lit(text)))
    assert f"{got.block_type}/{got.role}" == kind


@pytest.mark.parametrize(("font", "size", "color", "digest"), [("Arial", 12.0, "#000000", "3a8719b31ac6"), ("Times-Bold", 14.0, "#333333", "084b94772253"), ("Arial-BoldItalic", 9.5, "#0a0a0a", "6260e15da40b")])
def test_style_hash(spark, font, size, color, digest):
    assert one(spark, L.style_id(L.style_of(F.lit(font), F.lit(size), F.lit(color)))) == digest


@pytest.mark.parametrize(("parts", "color"), [(None, "#000000"), ([1.0, 0.0, 0.5], "#ff007f"), ([0.5], "#7f7f7f"), ([0.0, 1.0, 1.0, 0.0], "#ff0000"), ([0.0, 0.0, 0.0, 0.5], "#7f7f7f"), ([0.1, 0.2], "#000000")])
def test_color(spark, parts, color):
    c = F.lit(None).cast("array<double>") if parts is None else F.array(*[F.lit(p) for p in parts])
    assert one(spark, L.color_hex(c)) == color


def test_boxes(spark):
    box = tuple(F.lit(v) for v in (72.0, 100.0, 540.0, 120.0))
    assert one(spark, L.normalized_box(box, F.lit(612.0), F.lit(792.0))) == [0.117647, 0.126263, 0.882353, 0.151515]
    assert one(spark, L.normalized_box(box, F.lit(0.0), F.lit(792.0))) == [0.0] * 4
    table = tuple(F.lit(v) for v in (0.0, 0.0, 100.0, 50.0))
    assert one(spark, L.cell_box(table, F.lit(2), F.lit(2), F.lit(1), F.lit(1))) == [50.0, 25.0, 100.0, 50.0]


@pytest.mark.parametrize(("spec", "total", "a", "b"), [("1,3-5,9-7,x", 4, [1, 3, 4], [1]), ("9", 4, [1, 2, 3, 4], [1, 2, 3, 4]), ("99", 12, list(range(1, 13)), [1, 2, 3, 4, 5]), (" ", 12, list(range(1, 13)), list(range(1, 13))), (None, 2, [1, 2], [1, 2])])
def test_page_ranges(spark, spec, total, a, b):
    s = F.lit(spec).cast("string")
    assert one(spark, clipped_pages(s, F.lit(total))) == a
    assert one(spark, whole_range_pages(s, F.lit(total))) == b


def test_rhetoric(spark):
    raw = spark.sql("select named_struct('tone','formal','voice','loud','modality',null,'tense',null,'domain',null) as r, named_struct('tone','formal','voice',null,'modality',null,'tense',null,'domain',null) as s")
    got = raw.select(L.rhetoric(F.col("r")).alias("r"), L.rhetoric(F.col("s")).alias("s")).first()
    assert got.r is None and got.s.tone == "formal" and got.s.voice is None


def test_titles(spark):
    assert one(spark, L.title_from_name(F.lit("/a/annual-report_2abc it's.pdf"))) == "Annual Report 2Abc It'S"
    assert one(spark, L.title_from_name(F.lit("x.tar.gz"))) == "X.Tar"


def test_truncation_and_features(spark):
    assert one(spark, L.truncated(F.lit("a" * 121), 120)) == "a" * 120 + "..."
    assert one(spark, L.truncated(F.lit("a" * 120), 120)) == "a" * 120
    f = one(spark, L.measured_features(F.lit("You must pay. It was signed by the party!")))
    assert (f.avg_sentence_length, f.modal_density, f.passive_ratio, f.legal_term_density) == (4.5, 0.111111, 0.5, 0.111111)
    assert one(spark, L.measured_features(F.lit(""))).avg_sentence_length == 0.0
