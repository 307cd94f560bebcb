"""Block trees as JSON and back: made at the document, moved once as text, decoded once, whatever the ids and values."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quire.plans import queries
from quire.sources import adapters as A
from quire.sources import marker
from quire.sources.nested import nodes


def plan(df) -> str:
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_texts_are_read_and_moved_once(spark):
    p = plan(queries.marker_json_blocks(spark, "/root/testdata/sf0.001"))
    assert p.count("Scan parquet") == 1 and p.count("Exchange") == 1 and "Join" not in p and "Aggregate" not in p


def test_trees_of_null_and_repeated_ids_come_back_whole(spark, tmp_path):
    text = "\n".join(f"a{i} b, c  d. e \"f\", <g> & h\\. i" for i in range(80))
    rows = [(1, text), (1, text), (1, "x"), (None, text), (None, "y. z"), (2, None), (3, ""), (4, "\n\n\n"), (5, "a\tb c")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    path = F.concat(F.array(F.pmod(F.get("path", F.lit(0)), F.lit(35))), F.slice("path", 2, 99))
    want = A.tree_blocks(spark, str(tmp_path)).select("doc_id", "page_number", path.alias("path"), "id", "block_type", "html", "bbox")
    got = marker.blocks(A.tree_json(spark, str(tmp_path))).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.filter("doc_id is null").count() > 80
    assert queries.marker_json_blocks(spark, str(tmp_path)).count() == want.count()


def test_values_of_other_types_are_cast_as_a_variant_is(spark):
    values = ["s", "", "é\u0000", None, 5, -0.0, 1.5, 1e300, 2**60, 10**30, True, [], [1], {"a": 1}]
    boxes = [[1, 2.5, -0.0, 1e300], [], [None, 1], [True], ["1", 2], [[1]], [2**53 + 1, 10**40], "x", 3, None, {"a": 1}]
    kids = [{"id": v, "block_type": v, "html": v} for v in values] + [{"id": f"b{i}", "bbox": b} for i, b in enumerate(boxes)] + [7, None, "t", {}]
    files = spark.createDataFrame([(1, json.dumps({"children": [{"children": kids}]})), (2, json.dumps({"children": [{"children": kids[:3]}]})), (3, "{")], "doc_id long, json string")
    v = nodes(files, ("children",)).filter(F.size("path") > 1).select("doc_id", F.slice("path", 2, 9).alias("path"), F.try_parse_json("node").alias("v"))
    get = lambda p, t: F.try_variant_get("v", p, t)
    kind = F.coalesce(get("$.block_type", "string"), F.lit("Unknown"))
    want = v.select("doc_id", "path", F.coalesce(get("$.id", "string"), F.concat(F.lit("page_0/"), kind, F.lit("/auto"))).alias("id"), kind.alias("block_type"), F.coalesce(get("$.html", "string"), F.lit("")).alias("html"), get("$.bbox", "array<double>").alias("bbox"))
    got = marker.blocks(files).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == len(kids) + 3
    held = nodes(files.filter("doc_id = 2"), ("children",), ("id", "block_type", "html"), ("bbox",))
    assert held.filter("node is not null").count() == 0 and held.filter("id = 's'").count() == 1
