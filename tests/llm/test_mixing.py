from __future__ import annotations

from math import comb

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as X

DOCS = "doc_id long, source string, text string, copies int, _size int, size string"


def rows(n=1500):
    rng = random.Random(6)
    names = ["a", "b", "B", "é", None, "tiny", "", "hot"]
    out = []
    for i in range(n):
        s = "hot" if i % 3 == 0 else rng.choice(names)
        if s == "tiny" and rng.random() < 0.95:
            s = "a"
        out.append((i, s, rng.choice([None, "", " w" * rng.randrange(1, 200)]) if s != "a" else "w\n" * rng.randrange(1, 90), 1, 2, "z"))
    return [*out, (None, "a", "x y", 1, 2, "z"), (7, "a", "x y z", 1, 2, "z"), (7, "a", "x y z", 1, 2, "z"), (9001, "zero", "", 1, 2, "z")]


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w >= 2 * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / w for s in open_}
            break
        for s in over:
            out[s] = 2.0 * sizes[s]
        left -= sum(2.0 * sizes[s] for s in over)
        open_ -= set(over)
    return out


def sizes_of(data):
    total = defaultdict(int)
    for _, s, t, *_ in data:
        total[s] += len((t or "").split())
    return total


def test_contract(spark):
    data = rows()
    docs = spark.createDataFrame(data, DOCS)
    got = X.taken(docs).collect()
    assert len(got) == len(data)
    sizes = sizes_of(data)
    want = brute_targets(sizes)
    taken, longest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r["_doc"].source
        n = len((r["_doc"].text or "").split())
        assert r["_size"] == n and r["_source_size"] == sizes[s] and abs(r["_target"] - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r["_copies"] <= 2 and len(r["_shards"]) == r["_copies"] and all(0 <= k < X.SHARDS for k in r["_shards"])
        taken[s] += r["_copies"] * n
        longest[s] = max(longest[s], n)
    for s, t in want.items():
        assert abs(taken[s] - t) <= longest[s] / 2 + 1e-6, (s, taken[s], t)
    again = X.taken(docs.repartition(7)).collect()
    key = lambda r: (str(r["_doc"]), r["_copies"], r["_shards"])
    assert sorted(map(key, got)) == sorted(map(key, again))


def brute_taken(spark, docs, seed):
    """Copies of each document, source by source, in order of place; equal rows have the copies of their numbers in any order."""
    seen, keyed = Counter(), []
    hashed = docs.select("doc_id", "source", "text", X.row_hash(docs).alias("h")).collect()
    for r in hashed:
        keyed.append((r.doc_id, seen[r.h], r.source, len((r.text or "").split()), r.h))
        seen[r.h] += 1
    places = spark.createDataFrame(keyed, "doc_id long, occ long, source string, size int, h long").withColumn("u", X.place(seed, F.col("occ"))).collect()
    sizes = Counter()
    for r in places:
        sizes[r.source] += r["size"]
    out = defaultdict(list)
    for s, target in brute_targets(sizes).items():
        own = sorted((r.u, r.h, r["size"], r.doc_id) for r in places if r.source == s)
        passes = int(target // sizes[s]) if sizes[s] else 0
        rest, cum, stop = target - passes * sizes[s], 0, 0
        for i, (_, _, n, _) in enumerate(own):
            cum += n
            if rest > 0 and cum - n / 2 <= rest:
                stop = i + 1
        for i, (_, h, n, d) in enumerate(own):
            out[(d, s, n)].append(passes + (i < stop))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [0, 1, 5])
def test_taken_by_brute_force_with_one_row_in_a_third_of_a_source(spark, seed):
    rng = random.Random(seed)
    data = [(7, "a", "w " * 10, 1, 2, "z")] * 400 + [(1000 + i, "a", "w " * rng.randrange(1, 20), 1, 2, "z") for i in range(600)] + [(5000 + i, "b", "w " * rng.randrange(0, 30), 1, 2, "z") for i in range(300)] + [(None, None, None, 1, 2, "z")] * 5
    docs = spark.createDataFrame(data, DOCS)
    got, words = defaultdict(list), Counter()
    rows = X.taken(docs.repartition(1 + seed % 3), seed=seed).collect()
    for r in rows:
        n = len((r["_doc"].text or "").split())
        got[(r["_doc"].doc_id, r["_doc"].source, n)].append(r["_copies"])
        words[r["_doc"].source] += n * r["_copies"]
    assert {k: sorted(v) for k, v in got.items()} == brute_taken(spark, docs, seed)
    target = {r["_doc"].source: r["_target"] for r in rows}
    assert all(abs(words[s] - target[s]) <= 15 for s in target)  # half of the longest document


def test_long_text(spark):
    data = [(1, "a", "w " * 300_000, 1, 2, "z"), *[(i, "a", "w", 1, 2, "z") for i in range(2, 50)], (99, "b", "w " * 10, 1, 2, "z")]
    got = {r["_doc"].doc_id: r for r in X.taken(spark.createDataFrame(data, DOCS)).collect()}
    assert got[1]["_size"] == 300_000 and got[1]["_copies"] == 1 and len(got) == len(data)


def test_deal(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    out = X.deal(docs)
    assert out.columns == docs.columns
    want = sum(r["_copies"] for r in X.taken(docs).collect())
    assert out.count() == want
    kept = X.deal(docs, shard_column="out").collect()
    per = [sum(r.out == k for r in kept) for k in range(X.SHARDS)]
    want = [sum(list(r["_shards"]).count(k) for r in X.taken(docs).collect()) for k in range(X.SHARDS)]
    assert per == want
    with pytest.raises(ValueError, match="column"):
        X.deal(docs, shard_column="doc_id")


def test_splitting_tree(spark):
    quotas = {0: 40, 1: 0, 2: 7, 3: 400, 4: 1}
    q = spark.createDataFrame(list(quotas.items()), "ordinal int, quota long")
    for shards in (1, 5, 8):
        ends = {r.ordinal: r.ends for r in X.split_quotas(q, shards).collect()}
        per = {o: [b - a for a, b in zip([0, *e], e, strict=False)] for o, e in ends.items()}
        assert all(len(p) == shards and sum(p) == quotas[o] and min(p) >= 0 for o, p in per.items())
        totals = [sum(per[o][k] for o in per) for k in range(shards)]
        assert max(totals) - min(totals) <= 1 and sum(totals) == sum(quotas.values())


def test_shards_get_hypergeometric_counts(spark):
    """The draw of one column of 3,000 urns, in one go, against mean and variance."""
    urns = spark.range(3000).select(X._hypergeometric(F.lit(100).cast("long"), F.lit(30).cast("long"), F.lit(50).cast("long"), F.col("id"), F.lit(0).cast("long"), 7).alias("x"))
    draws = [r.x for r in urns.collect()]
    mean = sum(draws) / len(draws)
    var = sum((d - mean) ** 2 for d in draws) / len(draws)
    exact = 50 * 0.3 * 0.7 * 50 / 99  # n p q (N - n) / (N - 1)
    assert abs(mean - 15) < 4 * (exact / 3000) ** 0.5 and abs(var / exact - 1) < 0.12
    few = spark.range(3000).select(X._hypergeometric(F.lit(12).cast("long"), F.lit(5).cast("long"), F.lit(6).cast("long"), F.col("id"), F.lit(1).cast("long"), 7).alias("x"))
    seen = [r.x for r in few.collect()]
    law = [comb(5, k) * comb(7, 6 - k) / comb(12, 6) for k in range(6)]
    assert sum((seen.count(k) - 3000 * p) ** 2 / (3000 * p) for k, p in enumerate(law)) < 25  # 0.9999 quantile of five degrees of freedom


@pytest.mark.parametrize("data", [[], [(1, None, None, 1, 2, "z")]])
def test_without_words(spark, data):
    docs = spark.createDataFrame(data, DOCS)
    got = X.taken(docs).collect()
    assert len(got) == len(data) and all(r["_copies"] * r["_size"] == 0 and r["_target"] == 0 for r in got)
    assert X.deal(docs).columns == docs.columns and F is not None
