"""Nested JSON in one pass: nodes, depth, broken documents; no job while plans are made."""

from __future__ import annotations

import json

import pytest

from quire.operators import gate
from quire.sources import marker
from quire.sources.nested import nodes, walk


def deep(n: int) -> dict:
    x = {"id": "leaf", "block_type": "Text"}
    for i in range(n):
        x = {"id": f"n{i}", "block_type": "Group", "children": [x, {"id": f"s{i}", "block_type": "Text", "html": f"<p>{i}</p>"}]}
    return x


def test_walk():
    doc = {"a": 1, "pages": [{"blocks": [{"id": "x", "children": [1, None, {"children": "no list"}]}]}, 7]}
    got = [(p, json.loads(n)) for p, n in walk(json.dumps(doc), ("pages", "blocks", "children"))]
    assert got == [([], {"a": 1}), ([0], {}), ([0, 0], {"id": "x"}), ([0, 0, 0], 1), ([0, 0, 1], None), ([0, 0, 2], {"children": "no list"}), ([1], 7)]
    for broken in (None, "", "{", "[1,]", '{"a":NaN}', '{"a":1,"a":2}', "1e999", "{} {}", "[" * 200_000):
        assert list(walk(broken, ("children",))) == [([], None)]
    assert list(walk('"é"', ("children",))) == [([], '"é"')]


def jobs(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


@pytest.mark.parametrize("depth", [1, 50, 300])
def test_marker_and_gate_at_any_depth(spark, depth):
    tree = {"children": [{"children": [deep(depth)]}, {"children": []}, {"children": [{"id": "p2"}]}]}
    edit = {"title": "t", "pages": [{"page_number": 1, "blocks": [deep(depth)]}]}
    bad = json.loads(json.dumps(edit).replace('"id": "leaf"', '"id": 5'))
    before = jobs(spark)
    trees = marker.blocks(spark.createDataFrame([(1, json.dumps(tree)), (2, "{"), (3, None)], "doc_id long, json string"))
    faults = gate.invalid(spark.createDataFrame([(1, json.dumps(edit)), (2, json.dumps(bad)), (3, None), (4, "[]"), (5, '{"pages": 3}')], "doc_id long, json string"))
    assert jobs(spark) == before
    rows = trees.collect()
    assert len(rows) == 2 * depth + 2 and {r.page_number for r in rows} == {1, 3} and {r.doc_id for r in rows} == {1}
    by_id = {r.id: r for r in rows}
    assert by_id["leaf"].path == [0] * (depth + 1) and by_id["s0"].path == [0] * depth + [1] and by_id["s0"].content == "0" and by_id["p2"].block_type == "Unknown"
    assert {r.doc_id: r.reasons for r in faults.collect()} == {2: ["block"], 3: ["json"], 4: ["json"], 5: ["document"]}


def test_one_read_of_the_documents(spark, tmp_path):
    spark.createDataFrame([(1, json.dumps({"children": [{"children": [deep(9)]}]}))], "doc_id long, json string").write.parquet(str(tmp_path / "d"))
    plan = marker.blocks(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, json string")
    assert nodes(none, ("children",)).count() == 0 and marker.blocks(none).count() == 0 and gate.invalid(none).count() == 0
