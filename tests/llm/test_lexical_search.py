"""Search by treaps against scoring every document, and the query against its SQL."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from quire.llm import lexical_search as S

DOCS = "doc_id long, text string, item_id long, n int, score string"
ITEMS = "item_id long, text string, rank int"


def brute(docs, items, k=S.K):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(S.TERM_CLASS, (t or "").translate(low))
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text, *_ in items:
        scored = []
        for d, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w in terms(text) if w in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "été", "naïve", "x1", "Z9", "漢字", "a b", *[f"w{i}" for i in range(150)]]
    draw = lambda m: [words[min(int(rng.paretovariate(0.7)) - 1, len(words) - 1)] for _ in range(m)]
    docs = [(i * 3, rng.choice([" ", "\n", "--", "\x00", "_"]).join(draw(rng.randrange(1, 120))), None, 1, "s") for i in range(n)]
    docs += [(10**9 + i, docs[5][1], None, 1, "s") for i in range(n // 2)]  # a large group of copies, all scores equal
    docs += [(7, "The w3", None, 1, "s"), (7, "The w3", None, 1, "s"), (None, docs[5][1], None, 1, "s"), (8, None, None, 1, "s"), (9, "", None, 1, "s"), (10, "?!", None, 1, "s"), (11, "w9 " * 30_000, None, 1, "s")]
    items = [(i, " ".join(draw(rng.randrange(1, 25))), 1) for i in range(25)] + [(100, docs[5][1], 1), (101, None, 1), (102, "nowhere", 1), (None, "w1 w1 W2", 1)]
    return docs, items


@pytest.mark.parametrize("how", [{}, {"shard": 37}, {"postings": 50, "block_terms": 40}])
def test_against_scoring_all(spark, how):
    docs, items = corpus(300, 5)
    got = S.search(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS), **how)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_nothing_to_search(spark):
    docs, items = corpus(20, 1)
    none_d, none_i = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    for d, i in ((none_d, spark.createDataFrame(items, ITEMS)), (spark.createDataFrame(docs, DOCS), none_i), (none_d, none_i)):
        assert S.search(d, i).collect() == []


def test_repeated_items(spark):
    docs, items = corpus(40, 2)
    got = S.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame([items[0], items[0]], ITEMS)).collect()
    once = brute(docs, [items[0]])
    assert sorted(map(tuple, got), key=repr) == sorted(once * 2, key=repr)


def treaps(seed=0, n=3000, terms=40):
    rng = np.random.default_rng(seed)
    pairs = np.unique(np.stack([rng.integers(0, terms, n), rng.integers(0, 400, n)]), axis=1)
    return pairs, S.Treaps(pairs[0], pairs[1], rng.integers(1, 6, pairs.shape[1]), terms + 1)


def test_treap_orders():
    """Search order of documents, heap order of impacts, every posting once, depth of a treap and not of a chain."""
    pairs, t = treaps()
    seen = 0
    for term in range(41):
        stack, most = [(t.root[term], -1, 400, 1 << 60, 1)], 0
        while stack:
            at, lo, hi, above, depth = stack.pop()
            if at >= 0:
                seen += 1
                most = max(most, depth)
                assert lo < t.doc[at] < hi and t.impact[at] <= above
                stack += [(t.left[at], lo, t.doc[at], t.impact[at], depth + 1), (t.right[at], t.doc[at], hi, t.impact[at], depth + 1)]
        assert most <= 25
    assert seen == pairs.shape[1] and t.root[40] == -1


def test_pruning_leaves_documents_out():
    """The search must not score all documents of a query whose best ones are clear."""
    rng = np.random.default_rng(3)
    n = 4000
    term = np.concatenate([np.zeros(n, int), np.ones(30, int)])
    doc = np.concatenate([np.arange(n), rng.choice(n, 30, replace=False)])
    t = S.Treaps(term, doc, np.where(term == 0, 1, 100), 2)
    scored = 0
    bound = t._bound

    def counted(node, times):
        nonlocal scored
        scored += len(node)
        return bound(node, times)

    t._bound = counted
    scores, docs = t.search(np.array([0, 1]), np.array([1, 1]), n, 20, 0, -1.0)
    assert sorted(docs) == sorted(doc[n:])[:20] and set(scores) == {101} and scored < n


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/benchmark.parquet"), reason="no tables")
def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert sorted(map(tuple, S.op11_lexical_search(spark, sf).collect())) == sorted(con.execute(S.OP11_SQL).fetchall())
