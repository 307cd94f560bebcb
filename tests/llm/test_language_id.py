"""N-grams and counts against plain loops, the filter against sets, and held-out accuracy."""

from __future__ import annotations

import os
import zlib

import numpy as np
import pytest

from quire.llm import language_id as G

DOCS = "doc_id long, text string, lang string, language int, score string"


def plain_ngrams(text: str) -> list[str]:
    """With _ for a boundary."""
    out, s = [], ["_"]
    for c in text.lower() + "\0":
        if c.isalpha():
            s.append(c)
        elif s[-1] != "_":
            s.append("_")
    for n in G.ORDERS:
        out += [g for g in ("".join(s[i : i + n]) for i in range(len(s) - n + 1)) if "_" not in g[1:-1]]
    return out


TEXTS = ["", "a", "Été  là-bas!", "\0\0x", "ÅB c d e", "漢字かな 123 ок", " lead", "trail. ", "...", "ǅ ΑΣ Σ. İx", "one\ntwo\ttwo"]


def test_ngrams():
    _, found = G.ngrams(TEXTS)
    got = [sorted(h for hashes, of in found for h, i in zip(hashes.tolist(), of.tolist(), strict=True) if i == k) for k in range(len(TEXTS))]
    alone = {g: None for t in TEXTS for g in plain_ngrams(t)}
    for k, t in enumerate(TEXTS):
        want = plain_ngrams(t)
        assert len(got[k]) == len(want), t
        single = sorted(h for hashes, _ in G.ngrams([t])[1] for h in hashes.tolist())
        assert single == got[k] and len(set(single)) == len(set(want)), t  # equal n-grams have equal hashes, others differ
    assert alone


def test_long_texts_in_pieces(monkeypatch):
    text = "Été là-bas, ok " * 50 + "x" * 40 + " fin"
    whole = sorted(h for hashes, _ in G.ngrams([text])[1] for h in hashes.tolist())
    monkeypatch.setattr(G, "PIECE", 7)
    cut = list(G.pieces(text))
    assert "".join(cut) == text and len(cut) > 50
    assert sorted(h for hashes, _ in G.ngrams(cut)[1] for h in hashes.tolist()) == whole


def test_filter():
    """No language is missed; false ones come at the rate that is corrected for; the corrected counts are near the truth."""
    rng = np.random.default_rng(2)
    grams = [rng.integers(0, 2**63, n).astype(np.uint64) for n in [4000, 50, 0, *[2000] * 67]]
    f = G.LanguageFilter(grams)
    assert f.rows.shape[1] == 2
    for i, g in enumerate(grams):
        assert ((f.languages(g)[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()
    others = rng.integers(0, 2**63, 200_000).astype(np.uint64)
    seen = f.counts(others, np.zeros(len(others), np.int64), 1)[0] / len(others)
    assert np.abs(seen - f.false_rate).max() < 0.004 and f.false_rate[2] == 0
    mixed = np.concatenate([others[:6000], grams[0][:2000]])
    fixed = f.corrected(f.counts(mixed, np.zeros(8000, np.int64), 1), np.array([8000]))[0]
    assert abs(fixed[0] - 2000) < 120 and fixed[3:].max() < 120


def test_counts_against_loops():
    model = G.LanguageModel(["a", "b"], [np.unique(np.concatenate([h for h, _ in G.ngrams([t])[1]])) for t in ("the and of", "der und die the")])
    for text in TEXTS + ["the und", "of der and die"]:
        got = model.predict([None, text, "x"])[1]
        flat = [h for hashes, _ in G.ngrams([text])[1] for h in hashes]
        c = [sum(int(model.filter.languages(np.array([h]))[0, 0] >> np.uint64(i)) & 1 for h in flat) for i in range(2)]
        s = [max(0.0, (x - len(flat) * f) / (1 - f)) for x, f in zip(c, model.filter.false_rate, strict=True)]
        if not any(ch.isalpha() for ch in text):
            assert got == ("und", 0.0)
        else:
            assert got == ("ab"[s.index(max(s))], pytest.approx(max(s) / sum(s) if sum(s) else 0.0))


def rows():
    words = {"xx": "lorem ipsum dolor sit amet", "yy": "der die das und nicht", None: "the of and"}
    out = [(i, " ".join(w.split()[(i + j) % 5 if len(w.split()) == 5 else 0] for j in range(30)), lang, 1, "s") for i in range(60) for lang, w in words.items() if i % 3 == ["xx", "yy", None].index(lang)]
    return [*out, (100, None, "xx", 1, "s"), (101, "", "xx", 1, "s"), (102, "12 34 !", "yy", 1, "s"), (None, "und nicht", None, 1, "s"), (7, "und die", "yy", 1, "s"), (7, "und die", "yy", 1, "s"), (103, "ж", "xx", 1, "s"), (104, "das die " * 400_000, None, 1, "s")]


def test_edges(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    model = G.train(docs)
    out = G.predicted(docs, model)
    assert out.columns == ["_doc", "language"]
    got = {(r["_doc"].doc_id, r["_doc"].text): r.language for r in out.collect()}
    assert len(out.collect()) == len(rows())
    und = [(100, None), (101, ""), (102, "12 34 !")]
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in und)
    assert got[None, "und nicht"].lang_pred == "yy" and got[104, "das die " * 400_000].lang_pred == "yy"
    assert got[103, "ж"].lang_pred in ("xx", "yy")
    assert all(0 <= x.score <= 1 and x.lang_pred in ("xx", "yy", "und") for x in got.values())


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, 1, "s")], DOCS)
    assert [tuple(r.language) for r in G.predicted(docs, G.train(docs)).collect()] == [("und", 0.0)]
    none = spark.createDataFrame([], DOCS)
    assert G.predicted(none, G.train(none)).collect() == []


def test_held_out_rows_do_not_train(spark):
    data = [(i, "abc abd" if zlib.crc32(str(i).encode()) % 3 == 1 else "xyz xyw", "held" if zlib.crc32(str(i).encode()) % 3 == 1 else "seen", 1, "s") for i in range(50)]
    assert G.train(spark.createDataFrame(data, DOCS)).languages == ["seen"]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01/documents.parquet"), reason="no tables")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = G.op13_language_id(spark, sf).collect()
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert sum(held) / len(held) > 0.99
