from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import simhash as S

DOCS = "doc_id long, text string, fp string, root int"


def brute_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps):
    up = list(range(len(fps)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "A b", "a B c D", "ÄB É x y z" * 9, "One two three four five " * 50, "x\x85y z w v u"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_spark_xxhash64(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a bé c d")).alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest("a bé c d".encode(), 42)


def clusters(n=60, per=12, seed=2):
    """Centres with neighbours at up to 9 bits, chains and exact copies: links at 4, no links at 5."""
    rng = random.Random(seed)
    out = [0, 1, 31, 2**64 - 1]
    for _ in range(n):
        c = rng.getrandbits(64)
        out.append(c)
        for _ in range(rng.randrange(per)):
            c2 = c
            for b in rng.sample(range(64), rng.randrange(10)):
                c2 ^= 1 << b
            out.append(c2)
            if rng.random() < 0.3:
                c = c2
    return sorted(set(out))


@pytest.mark.parametrize(("k", "portion"), [(12, 4_000_000), (16, 4_000_000), (12, 50_000)])
def test_links_lose_nothing(spark, monkeypatch, k, portion):
    fps = clusters()
    monkeypatch.setattr(S, "prefix_bits", lambda n: k)
    if portion != S.PORTION:  # the kernel in this process, with forced splits
        monkeypatch.setattr(S, "PORTION", portion)
        u, v = S._links_of(int(fps[5] >> (64 - k)), np.array([f for f in fps if bin((f >> (64 - k)) ^ (fps[5] >> (64 - k))).count("1") <= 2], np.uint64), k)
        assert all((int(a) ^ int(b)).bit_count() <= 4 for a, b in zip(u, v, strict=True))
        monkeypatch.setattr(S, "PORTION", 4_000_000)
        u2, v2 = S._links_of(int(fps[5] >> (64 - k)), np.array([f for f in fps if bin((f >> (64 - k)) ^ (fps[5] >> (64 - k))).count("1") <= 2], np.uint64), k)
        assert len(u) == len(u2)
        return
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    points = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    label = {r.node % 2**64: r.root for r in S.components(S.links(points, len(fps))).collect()}
    want = brute_groups(fps)
    seen: dict = {}
    for f, w in zip(fps, want, strict=True):
        assert seen.setdefault(w, label.get(f, f)) == label.get(f, f)
    assert len(set(seen.values())) == len(seen)


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 203


def test_documents(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(40):
        t = [rng.choice(words) for _ in range(300)]
        texts.append(" ".join(t))
        for _ in range(rng.randrange(4)):
            t2 = list(t)
            for _ in range(rng.randrange(4)):
                t2[rng.randrange(300)] = "changed"
            texts.append(" ".join(t2))
    rows = [(i, t, "c", 1) for i, t in enumerate(texts)] + [(900, None, "c", 1), (901, "", "c", 1), (None, texts[0], "c", 1), (5, texts[5], "c", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    groups = brute_groups(fps)
    least: dict[int, int] = {}
    for g, (d, *_) in zip(groups, rows, strict=True):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    want = sorted((str(d), f"{f:016x}", least[g]) for g, f, (d, *_) in zip(groups, fps, rows, strict=True))
    got = S.grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, r.component_id) for r in got) == want
    kept = S.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_empty(spark):
    assert S.grouped(spark.createDataFrame([], DOCS)).count() == 0
