"""Words are wrapped without copies of their paragraph."""

from __future__ import annotations

from quire.operators import docx_layout


def test_wrapped_lines_are_cut_before_they_are_rows(spark):
    para = spark.createDataFrame([(1, 0, "p", "one two " * 40, 11.0, 0), (1, 3, "p", "x", None, 0)], "doc_id long, elem_idx int, kind string, text string, font_size double, n_rows int")
    wrapped = docx_layout.wrap_words(docx_layout.lay_out(para))
    # No row of a text line may carry the words of its paragraph: a long one would be copied once a line.
    plan = wrapped._jdf.queryExecution().optimizedPlan().toString()
    assert any("Generate inline(transform(" in x for x in plan.split("\n")) and plan.count("Generate") == 2
    got = wrapped.orderBy("elem_idx", "word_idx").collect()
    assert [r.word_idx for r in got] == [*range(80), 0] and [r.wx0 for r in got].count(72.0) == 4 + 1
