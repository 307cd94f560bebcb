"""Clustering of characters, words and lines on hand-made inputs, with properties that must always hold."""

from __future__ import annotations

import random

from quire.operators import geometry as G
from quire.schema import CHAR


def chars(spark, rows):
    """rows: (text, x0, y0, x1, y1, size, font)."""
    return spark.createDataFrame([(1, 1, i, t, x0, y0, x1, y1, f, s, "#000000") for i, (t, x0, y0, x1, y1, s, f) in enumerate(rows)], CHAR)


def line_chars(xs, y=100.0, size=12.0, w=8.0):
    return [(chr(97 + i), x, y, x + w, y + size, size, "Arial") for i, x in enumerate(xs)]


def test_words_keep_touching_spaces(spark):
    c = chars(spark, [("H", 10.0, 100.0, 18.0, 112.0, 12.0, "A"), ("i", 18.0, 100.0, 22.0, 112.0, 12.0, "A"), (" ", 22.0, 100.0, 26.0, 112.0, 12.0, "A"), ("W", 40.0, 100.0, 52.0, 112.0, 12.0, "A"), ("o", 52.0, 100.0, 60.0, 112.0, 12.0, "A")])
    got = [(r.text, r.x0, r.y0, r.x1, r.y1) for r in G.build_words(c).orderBy("word_idx").collect()]
    assert got == [("Hi ", 10.0, 100.0, 26.0, 112.0), ("Wo", 40.0, 100.0, 60.0, 112.0)]


def test_word_gap_boundary(spark):
    c = chars(spark, line_chars([0.0, 11.0, 22.1]))
    assert [r.text for r in G.build_words(c).orderBy("word_idx").collect()] == ["ab", "c"]


def test_filter_chars(spark):
    rows = [(t, 0.0, 0.0, 1.0, 1.0, 12.005, "A") for t in ("a", "", " ", "\t", "\u00a0")]
    assert sorted(r.text for r in G.filter_chars(chars(spark, rows)).collect()) == [" ", "a"]


def test_lines_are_anchored(spark):
    """A slope: each word is near the one before, but only two are near the first of a line."""
    words = spark.createDataFrame([(1, 1, i, f"w{i}", 10.0 * i, 5.0 * i, 10.0 * i + 8, 5.0 * i + 10, "A", 10.0, "#000000") for i in range(4)], "doc_id long, page_number int, word_idx int, text string, x0 double, y0 double, x1 double, y1 double, fontname string, size double, color string")
    assert [r.text for r in G.build_lines(words).orderBy("line_idx").collect()] == ["w0 w1", "w2 w3"]


def test_blocks(spark):
    rows = [(72.0, 100.0, 112.0, "Arial"), (72.0, 130.0, 142.0, "Arial-Bold"), (72.0, 160.1, 172.0, "Arial"), (113.0, 174.0, 186.0, "Arial"), (113.0, 188.0, 200.0, "Times")]
    lines = spark.createDataFrame([(1, 1, i, f"l{i}", x, y0, x + 50, y1, f, 12.0, "#000000") for i, (x, y0, y1, f) in enumerate(rows)], "doc_id long, page_number int, line_idx int, text string, x0 double, y0 double, x1 double, y1 double, fontname string, size double, color string")
    assert [r.text for r in G.build_blocks(lines).orderBy("block_idx").collect()] == ["l0\nl1", "l2", "l3", "l4"]


def test_dominant_font_tie_goes_to_the_first(spark):
    c = chars(spark, [(t, 8.0 * i, 0.0, 8.0 * i + 8, 12.0, 12.0, f) for i, (t, f) in enumerate(zip("abcd", "BABA", strict=True))])
    assert G.build_words(c).first().fontname == "B"


def test_tables_drop_covered_blocks(spark):
    b = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_number int, block_idx int, x0 double, y0 double, x1 double, y1 double")
    t = lambda *boxes: spark.createDataFrame([(1, 1, *x) for x in boxes], "doc_id long, page_number int, x0 double, y0 double, x1 double, y1 double")
    assert G.blocks_outside_tables(b, t((0.0, 0.0, 10.0, 5.0))).count() == 1
    assert G.blocks_outside_tables(b, t((0.0, 0.0, 10.0, 6.0))).count() == 0
    assert G.blocks_outside_tables(b, t((0.0, 0.0, 10.0, 4.0), (0.0, 6.0, 10.0, 10.0))).count() == 1


def test_words_lose_and_invent_nothing(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.uniform(0, 500), rng.choice([10.0, 30.0, 50.0]), 0.0, 0.0, 12.0, rng.choice(["A", "B"])) for _ in range(300)]
    rows = [(t, x, y, x + 6, y + 12, s, f) for t, x, y, _, _, s, f in rows]
    got = G.build_words(chars(spark, rows)).collect()
    assert sum(len(r.text) for r in got) == 300
    joined = "".join(r.text for r in sorted(got, key=lambda r: r.word_idx))
    assert joined == "".join(t for t, *_ in sorted(rows, key=lambda r: (round(r[2], 1), r[1])))
    assert all(r.x0 <= r.x1 and r.y0 <= r.y1 for r in got)
