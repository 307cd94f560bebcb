from __future__ import annotations

import hashlib
import random

import pytest

from quire.llm.exact_dedup import dedup_table, exact_dedup

DOCS = "doc_id long, text string, kept boolean, identity int, norm string"
SPACE = dict.fromkeys(map(ord, " \t\n\x0b\x0c\r"))


def rows(n=400):
    rng = random.Random(5)
    base = ["", None, " \n", "a", "ab", "a b", "é ü😀", "x" * 300, "x" * 299 + "y", "x " * 300, ("ab" * 2000), ("ab" * 2000) + "c", " ", " a"]
    out = [(i, rng.choice([*base, "t" + str(rng.randrange(60))]), None, 1, "n") for i in range(n)]
    return [*out, (None, "a", None, 1, "n"), (3, "a  ", None, 1, "n"), (3, "a  ", None, 1, "n")]


def brute(data):
    groups: dict[str, list[tuple]] = {}
    for d, t, *_ in data:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), d is None, d))
    return {k: (min(v)[2], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize(("block", "bits"), [(4096, 60), (7, 60), (3, 3), (64, 1)])
def test_against_brute_force(spark, block, bits):
    data = rows()
    want = brute(data)
    got = dedup_table(spark.createDataFrame(data, DOCS), block=block, bits=bits).collect()
    assert len(got) == len(data)
    sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert all((r.keep_id, r.group_size) == sha[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)


def test_stage_keeps_columns_and_one_row_each(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    want = brute(rows())
    assert sorted((r.text or "").translate(SPACE) for r in got.collect()) == sorted(want)


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "a", None, 1, "n")] * 5, DOCS)
    assert exact_dedup(docs).count() == 1


def test_empty(spark):
    assert dedup_table(spark.createDataFrame([], DOCS)).count() == 0
    assert exact_dedup(spark.createDataFrame([], DOCS)).count() == 0
