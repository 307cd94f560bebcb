from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import quality_model as M
from quire.llm import quality_rules as R
from quire.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, _q string, key string"


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = (text or "").split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    f = Counter(words).values()
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside), sum(len(w) ** 2 for w in words), sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in lines), sum(k * (k - 1) for k in f), sum(k * (k - 1) * (k - 2) for k in f)


@pytest.mark.parametrize("text", [None, "", " \n ", "a b c", "a b c a b c", "a a a a", "x\n\nx\n \n \nx", "é😀 # $$\x85y z", "a b c d a b c e a b c", "l1\nl2\nl1\nl1 "])
def test_base_counts(text):
    assert R.counts_of(text) == brute_counts(text)


def test_base_counts_random():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ab c\n\t#") for _ in range(rng.randrange(80)))
        assert R.counts_of(text) == brute_counts(text)


def prose(rng, n, bad=""):
    return "\n".join(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) + bad for _ in range(20)) for _ in range(n // 20))


def corpus(n=400):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        junk = i % 10 == 0
        rows.append((i, prose(rng, rng.choice([60, 120, 400]), "###" if junk else ""), rng.choice(["en", None]), "hot" if i % 3 else f"s{i % 4}", "x", "k"))
    return [*rows, (n, None, None, None, None, None), (n + 1, "", "en", "", "x", "k"), (None, rows[1][1], "en", "hot", "x", "k"), rows[2], rows[2]]


def test_rules(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS)
    got = R.score(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["_doc"].doc_id: r for r in got}
    for i, text, *_ in rows:
        c = brute_counts(text)
        assert tuple(by_id[i]["_q"]) == c
        assert by_id[i]["_base_failed"] == (c[0] < 50 or 100 * c[4] > 50 * c[0])
    good = [i for i in range(400) if i % 10 and not by_id[i]["_base_failed"]]
    bad = [i for i in range(0, 400, 10)]
    assert sum(by_id[i]["_kept"] for i in good) >= 0.97 * len(good)
    assert not any(by_id[i]["_kept"] for i in bad)
    kept = R.filter_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["_kept"] for r in got)


def brute_verdicts(rows):
    """Regularised minimum-covariance-determinant distances by plain arrays, exact sorting and a solver."""
    c = np.array([brute_counts(r[1]) for r in rows], float)
    n, lines = np.maximum(c[:, 0], 3), np.maximum(c[:, 6], 1)
    mean = c[:, 1] / n
    pair, triple = (c[:, 7] + 1) / (n * (n - 1)), c[:, 8] / (n * (n - 1) * (n - 2))
    x = np.stack([mean, np.log(pair), np.sqrt(c[:, 2] / n), np.arcsin(np.sqrt(np.minimum(c[:, 3] / lines, 1)))], 1)
    v = np.stack([(np.maximum(c[:, 5] / n - mean**2, 0) + 1 / 12) / n, 4 * np.maximum(triple - pair**2, 0) / (n * pair**2) + 2 / (n * (n - 1) * pair), 0.25 / n, 0.25 / lines], 1)
    good = (c[:, 0] >= 50) & (100 * c[:, 4] <= 50 * c[:, 0])
    langs, own = [r[2] for r in rows], [(r[2], r[3]) for r in rows]
    groups = {("all",): (good, None)}
    for lang in set(langs):
        groups[("lang", lang)] = (good & np.array([t == lang for t in langs]), ("all",))
    for g in set(own):
        groups[("own", *g)] = (good & np.array([t == g for t in own]), ("lang", g[0]))
    groups = {k: (m, up) for k, (m, up) in groups.items() if m.any()}

    def between(est):
        c = np.diag(est[1])
        share = np.sqrt(np.maximum(c - est[2], 0) / np.maximum(c, 1e-12))
        return est[1] * np.outer(share, share)

    def d2(k, est):
        m = groups[k][0]
        r = x[m] - est[0]
        a = between(est) + v[m][:, :, None] * np.eye(4)
        return np.einsum("ni,ni->n", r, np.linalg.solve(a, r[:, :, None])[:, :, 0])

    def drawn(parts, factor):
        out = {}
        for k, (m, up) in groups.items():
            y, w = parts[k]
            est = y.mean(0), np.cov(y.T, bias=True).reshape(4, 4) * factor, w.mean(0)
            if up:
                est = tuple((len(y) * a + R.PRIOR * b) / (len(y) + R.PRIOR) for a, b in zip(est, out[up], strict=True))
            out[k] = est
        return out

    best = {}
    classical = drawn({k: (x[m], v[m]) for k, (m, _) in groups.items()}, 1.0)
    for start in range(2):
        est = classical
        if start:
            parts = {}
            for k, (m, _) in groups.items():
                mu, cov, u = classical[k]
                sd = np.sqrt(np.maximum(np.maximum(np.diag(cov), u), 1e-12))
                parts[k] = mu + sd * np.tanh((x[m] - mu) / sd), v[m]
            est = drawn(parts, 1.0)
        for _ in range(R.STEPS):
            parts = {}
            for k, (m, _) in groups.items():
                near = np.argsort(d2(k, est[k]), kind="stable")[: int(np.ceil(R.KEEP * m.sum()))]
                parts[k] = x[m][near], v[m][near]
            est = drawn(parts, R.CONSISTENCY)
        for k, (m, _) in groups.items():
            det = np.linalg.slogdet(between(est[k]) + np.diag(est[k][2]))[1]
            if k not in best or det < best[k][0] - 1e-9:
                best[k] = (det, est[k])
    out = np.full(len(rows), np.nan)
    for k, (m, _) in groups.items():
        if k[0] == "own":
            out[m] = d2(k, best[k][1])
    return good, out


def distances(spark, x, v):
    """Distances of points of one group, from their own estimate."""
    points = spark.createDataFrame([("g", i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(zip(x, v, strict=True))], "key string, i long, " + ", ".join(f"{c} double" for c in [*R.X, *R.V]))
    tree = spark.createDataFrame([("g", "", 0)], "key string, parent string, depth int")
    best = R.estimates(points.drop("i"), tree)
    got = R._with_distance(points.join(best, "key"), ["i"]).orderBy("i").collect()
    return np.array([r.d2 for r in got])


def test_distances_of_model_data_follow_chi_square(spark):
    """Documents drawn from the model, long and short ones, and outliers planted near the cut."""
    rng = np.random.default_rng(4)
    n = 6000
    scatter = np.array([[1.0, 0.3, 0, 0], [0.3, 0.5, 0.1, 0], [0, 0.1, 0.2, 0], [0, 0, 0, 0.05]])
    v = np.array([0.8, 0.4, 0.3, 0.02]) * rng.uniform(0.2, 3, (n, 1))
    x = np.array([5, -3, 0.2, 0.1]) + rng.multivariate_normal(np.zeros(4), scatter, n) + rng.standard_normal((n, 4)) * np.sqrt(v)
    far = {}
    for k, times in enumerate([0.5] * 20 + [1.5] * 20 + [3.0] * 20):
        a = np.linalg.cholesky(scatter + np.diag(v[k]))
        u = rng.standard_normal(4)
        x[k] = np.array([5, -3, 0.2, 0.1]) + a @ (u / np.linalg.norm(u)) * np.sqrt(times * R.CUT)
        far[k] = times
    d = distances(spark, x, v)
    clean = d[len(far) :]
    for q, want in ((0.25, 1.923), (0.5, 3.357), (0.75, 5.385), (0.9, 7.779), (0.95, 9.488), (0.99, 13.277)):  # fixed values: quantiles of chi-square, 4 degrees
        assert abs(np.quantile(clean, q) / want - 1) < 0.1, (q, np.quantile(clean, q))
    assert (clean > R.CUT).sum() == 0
    assert all((d[k] > R.CUT) == (t > 1) for k, t in far.items())


def test_a_statistic_without_spread(spark):
    """Where nearly all documents have none of something, only its sampling variance counts."""
    rng = np.random.default_rng(5)
    x, v = rng.standard_normal((900, 4)), np.full((900, 4), 0.01)
    x[:, 2:] = 0
    x[:30, 2] = 0.3
    x[30:60, 2] = 0.7
    d = distances(spark, x, v)
    assert (d[:30] < R.CUT).all() and (d[30:60] > R.CUT).all() and (d[60:] < R.CUT).mean() > 0.99


def test_verdicts_equal_brute_force(spark):
    """Groups of 2 to some 200 documents, each with its own estimate."""
    rng = random.Random(11)
    rows = []
    for i in range(500):
        lang, source = rng.choice(["en", "en", "fr"]), rng.choice(["a"] * 6 + ["b"] * 3 + ["c", "d"])
        junk = rng.random() < 0.08
        text = prose(rng, rng.choice([60, 120, 400, 1500]), rng.choice(["##", "aaaaaaaa"]) if junk else "")
        rows.append((i, text, lang, source))
    rows += [(500, prose(rng, 100), None, None), (501, prose(rng, 100), "only", "one"), (502, "", "en", "a"), (503, None, "fr", "b")]
    good, want = brute_verdicts(rows)
    got = {r["_doc"].doc_id: r for r in R.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    d2 = np.array([np.nan if got[i]["_base_failed"] else got[i]["_distance"] for i in range(len(rows))])
    assert (np.isnan(d2) == np.isnan(want)).all()
    kept = good & ~(want > R.CUT)
    sure = ~(np.abs(np.log(np.maximum(want, 1e-9) / R.CUT)) < 0.3)  # the nearest share is taken by whole bins
    assert sure.mean() > 0.95
    assert all(got[i]["_kept"] == kept[i] for i in np.flatnonzero(sure))
    assert 10 < (good & ~kept).sum() < 70
    ratio = d2[good] / np.maximum(want[good], 1e-9)
    assert np.median(np.abs(np.log(ratio))) < 0.1


def test_few_documents(spark):
    """One document is its own centre; an empty table gives no rows; a very long text counts like others."""
    rng = random.Random(3)
    one = spark.createDataFrame([(1, prose(rng, 100), "en", "a", "x", "k")], DOCS)
    assert [r["_kept"] for r in R.score(one).collect()] == [True]
    assert R.score(spark.createDataFrame([], DOCS)).count() == 0
    rows = [*corpus(30)[:30], (99, prose(rng, 60_000), "en", "hot", "x", "k")]
    got = {r["_doc"].doc_id: r for r in R.score(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[99]["_q"].n_words == 60_000 and len(got) == 31


def test_gradient():
    rng = np.random.default_rng(0)
    bags = [rng.standard_normal((n, M.FEATURES)).astype(np.float32) for n in (1, 3, 5)]
    y = np.array([0.0, 1.0, 1.0])
    m = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES))

    def loss():
        out = 0.0
        for b, t in zip(bags, y, strict=True):
            h, _, _, a = m._forward(b)
            e = np.exp(a)
            p = 1 / (1 + np.exp(-(e @ h / e.sum() @ m.p["c"] + m.p["c0"][0])))
            out -= t * np.log(p) + (1 - t) * np.log(1 - p)
        return out / 3

    g = m._gradient(bags, y)
    for k in m.p:
        at = tuple(0 for _ in m.p[k].shape)
        old = m.p[k][at]
        m.p[k][at] = old + 1e-5
        up = loss()
        m.p[k][at] = old - 1e-5
        down = loss()
        m.p[k][at] = old
        assert abs((up - down) / 2e-5 + 1e-4 * old - g[k][at]) < 1e-4, k


def test_pieces_do_not_change_a_score(monkeypatch):
    rng = random.Random(1)
    text = prose(rng, 2000) + " " + "again and again " * 800 + "y" * 9000 + " " * 9000 + prose(rng, 2000)
    m = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES))
    whole, features = m.score(text), np.concatenate(list(M.encode_text(text)))
    monkeypatch.setattr(M, "PIECE", 3000)
    cut = list(M.pieces(text.encode()))
    assert b"".join(cut) == text.encode() and len(cut) > 10
    assert np.array_equal(np.concatenate(list(M.encode_text(text))), features)
    assert abs(m.score(text) - whole) < 1e-9
    assert 0 < m.score("") < 1 and 0 < m.score(None) < 1 and 0 < m.score("x" * 10000) < 1


def test_score_by_plain_loops():
    """One passage after another: the attention weights, the weighted sum and the logistic layer."""
    import math

    m = M.AttentionModel.fresh(np.zeros(M.FEATURES), np.ones(M.FEATURES))
    text = prose(random.Random(2), 300)
    top, bottom = [0.0] * M.HIDDEN, 0.0
    for x in np.concatenate(list(M.encode_text(text))).astype(float):
        h = [math.tanh(sum(x[i] * m.p["w1"][i][j] for i in range(M.FEATURES)) + m.p["b1"][j]) for j in range(M.HIDDEN)]
        a = 0.0
        for k in range(M.GATE):
            t = math.tanh(sum(h[j] * m.p["v"][j][k] for j in range(M.HIDDEN)))
            g = 1 / (1 + math.exp(-sum(h[j] * m.p["u"][j][k] for j in range(M.HIDDEN))))
            a += t * g * m.p["w"][k]
        bottom += math.exp(a)
        top = [s + math.exp(a) * v for s, v in zip(top, h, strict=True)]
    z = sum(s / bottom * c for s, c in zip(top, m.p["c"], strict=True)) + m.p["c0"][0]
    assert abs(m.score(text) - 1 / (1 + math.exp(-z))) < 1e-6


def test_features_by_plain_counts():
    text = "One, two THREE 4 # one\n" + "ab ab ab ab " * 30 + "é x y z " * 20
    words = text.split()
    tri = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + k for i in range(len(words) - 2) if tri[tuple(words[i : i + 3])] > 1 for k in range(3)}
    got = np.concatenate(list(M.encode_text(text)))
    at = len(M.CLASSES)
    for p, first in enumerate(range(0, len(words), M.PASSAGE)):
        own = words[first : first + M.PASSAGE]
        assert abs(got[p, at] - len(set(own)) / len(own)) < 1e-6
        assert abs(got[p, at + 1] - sum(i in twice for i in range(first, first + len(own))) / len(own)) < 1e-6
        assert abs(got[p, at + 2] - sum(len(w.encode()) for w in own) / len(own) / 10) < 1e-6


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents")
    labels = table(spark, d, "labels")
    model = M.train(docs, labels)
    rows = M.scored(docs.select("doc_id", "text"), model).select("_doc.doc_id", "score").select("doc_id", M.held_out().alias("held_out"), "score").join(labels.select("doc_id", "quality"), "doc_id").filter("held_out").collect()
    hits = sum((r.score >= M.THRESHOLD) == (r.quality == 1) for r in rows)
    assert hits / len(rows) >= 0.93, hits / len(rows)


def test_training_reads_every_passage(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(M.AttentionModel, "train", lambda self, bags, labels: seen.extend(map(len, bags)))
    docs = spark.createDataFrame([(i, "word " * (M.PASSAGE * 150 + i)) for i in range(1, 9)], "doc_id long, text string")
    M.train(docs, docs.selectExpr("doc_id", "1 quality"))
    assert seen and set(seen) == {151}


def test_no_labels_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = M.train(docs, none)
    assert model is None and [r.score for r in M.scored(docs, model).collect()] == [0.5, 0.5]
    flags = docs.select("doc_id", M.held_out().alias("h")).collect()
    assert next(r.h for r in flags if r.doc_id is None) is True
    some = M.train(docs, spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in M.scored(docs, some).collect())
    clash = docs.withColumn("score", F.lit("mine")).union(docs.withColumn("score", F.lit("mine")))
    got = M.scored(clash, some).collect()
    assert len(got) == 4 and all(r["_doc"].score == "mine" and 0 <= r.score <= 1 for r in got) and len({r.score for r in got}) == 2
    assert M.scored(clash.limit(0), some).count() == 0
    copies = spark.createDataFrame([(1, "b")] * 50 + [(1, "a"), (2, "c")], "doc_id long, text string")
    seen = []
    own = M.AttentionModel.train
    M.AttentionModel.train = lambda self, bags, labels: seen.append(len(bags))
    try:
        M.train(copies, copies.selectExpr("doc_id", "1 quality"))
    finally:
        M.AttentionModel.train = own
    assert not seen or seen[0] <= 2  # one text of a doc_id
