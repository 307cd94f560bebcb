from __future__ import annotations

import math
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm.sharding import HashTree, Rack, Region, Shard, descend, shard_documents

DOCS = "doc_id long, text string, shard string, slot int"


def test_contract(spark):
    rows = [(i, "wörd " * (i % 7), "clash", 3) for i in range(3000)] + [(None, None, None, None), (5, "again", "x", 1), (5, "again", "x", 1)]
    got = shard_documents(spark.createDataFrame(rows, DOCS), HashTree.of(8), HashTree.of(9)).collect()
    assert len(got) == len(rows)
    text = {i: t for i, t, *_ in rows[:3000]}
    per: dict[int, list[int]] = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 8)
        if r.doc_id is not None and r.size != 6:
            assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
    assert sorted(per) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in per.values())
    moved = sum(r.grown_shard == 8 for r in got)
    assert len(got) / 9 * 0.75 < moved < len(got) / 9 * 1.25
    assert all(abs(len(s) - len(got) / 8) < len(got) / 8 * 0.25 for s in per.values())
    nulls = [r for r in got if r.doc_id is None]
    assert [(r.size, r.text_crc32) for r in nulls] == [(1, 0)]
    assert len({r.shard for r in got if r.doc_id == 5}) == 1


def test_key_decides(spark):
    a = shard_documents(spark.createDataFrame([(i, "a", "", 0) for i in range(100)], DOCS), HashTree.of(8), HashTree.of(9))
    b = shard_documents(spark.createDataFrame([(i, "other", "", 0) for i in range(50, 150)], DOCS), HashTree.of(8), HashTree.of(9))
    x, y = ({r.doc_id: r.shard for r in d.collect()} for d in (a, b))
    assert all(x[i] == y[i] for i in range(50, 100))


def test_movement_stays_in_changed_subtrees(spark):
    def tree(weight):
        racks = lambda g, w: (Rack(f"{g}/r0", (Shard(4 * g, w), Shard(4 * g + 1))), Rack(f"{g}/r1", (Shard(4 * g + 2), Shard(4 * g + 3))))
        return HashTree((Region("g0", racks(0, weight)), Region("g1", racks(1, 1.0))))

    docs = spark.range(4000).select(F.col("id").alias("doc_id"))
    both = descend(descend(docs, tree(1.0), into="a"), tree(3.0), into="b").filter("a <> b").collect()
    assert both and all(r.b < 4 for r in both)  # the heavier region only gains
    share = descend(docs, tree(3.0), into="b").filter("b = 0").count() / 4000
    assert abs(share - 3 / 10) < 0.04
    gone = descend(docs, tree(0.0), into="b")
    assert gone.filter("b = 0").count() == 0


def brute_draw(key, shard):
    """Spark's xxhash64 of a long and an int: seeded by what came before."""
    h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
    h = xxhash.xxh64_intdigest(shard.id.to_bytes(4, "little"), h)
    return -math.log(((h >> 11) + 0.5) * 2.0**-53) / shard.weight


@pytest.mark.parametrize("n", [1, 3, 8, 21])
def test_brute_force(spark, n):
    """The region, then the rack, then the shard of the least draw; slots are gapless and those of one shard."""
    tree = HashTree.of(n, per_rack=2, racks=2)

    def brute(key):
        draw = lambda shards: min(brute_draw(key, s) for s in shards)
        region = min(tree.regions, key=lambda g: draw([s for r in g.racks for s in r.shards]))
        rack = min(region.racks, key=lambda r: draw(r.shards))
        return min(rack.shards, key=lambda s: brute_draw(key, s)).id

    docs = spark.createDataFrame([(i * 7 - 300, "t", "", 0) for i in range(400)], DOCS)
    got = shard_documents(docs, tree, tree).collect()
    assert {r.doc_id: r.shard for r in got} == {i * 7 - 300: brute(i * 7 - 300) for i in range(400)}
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"))
    for first in (1, 7, 13):
        wide = docs
        for n in range(first, first + 7):
            wide = descend(wide, HashTree.of(n, 2, 2), into=f"n{n}")
        for r in wide.collect():
            for n in range(first, first + 6):
                assert r[f"n{n + 1}"] in (r[f"n{n}"], n)


def test_many_shards(spark):
    """The plan does not grow with the levels' product, and generated code is in use."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"))
    a = descend(descend(docs, HashTree.of(256)), HashTree.of(257), into="b")
    rows = a.collect()
    assert all(r.b in (r.shard, 256) for r in rows) and len({r.shard for r in rows}) == 256
    assert "WholeStageCodegen" in a._jdf.queryExecution().explainString(a._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))


def test_hot_key_and_long_text(spark):
    """A third of all rows has one key; texts may be long; columns may clash."""
    rows = [(7, "same", "s", 1)] * 1000 + [(i, "x" * (200_000 if i == 5 else 3), "s", 1) for i in range(2000)]
    got = shard_documents(spark.createDataFrame(rows, DOCS), HashTree.of(8), HashTree.of(9)).collect()
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 3000 and all(sorted(s) == list(range(len(s))) for s in per.values())


def test_empty(spark):
    assert shard_documents(spark.createDataFrame([], DOCS), HashTree.of(8), HashTree.of(9)).count() == 0
