"""The whole pipeline on small tables with every kind of odd row, each stage against the operator it calls."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline as P
from quire.llm import mixing, quality_rules
from quire.llm.pieces import coder, default_model

#: Column names that operators use for their own.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _doc string, _rh long, kept boolean, fp long, _size int, tokens string"


def prose(rng: random.Random, n: int) -> str:
    """Words of a vocabulary, some much more frequent than others, as in real text."""
    words = ["".join(random.Random(i).choice("abcdefgh") for _ in range(2 + i % 8)) for i in range(400)]
    weights = [1 / (i + 3) for i in range(400)]
    return "\n".join(" ".join(rng.choices(words, weights, k=20)) for _ in range(n // 20))


def rows() -> list[tuple]:
    rng = random.Random(12)
    own = ("d", 5, True, 6, 7, "t")
    texts = [prose(rng, rng.choice([60, 120, 400])) for _ in range(120)]
    out = [(i, t, rng.choice(["en", None]), rng.choice(["a", "b", None]), len(t), *own) for i, t in enumerate(texts)]
    out += [(200 + i, texts[3].replace(" ", "  "), "en", "a", 1, *own) for i in range(40)]  # equal but for white space
    out += [(300 + i, texts[4] + f" z{i}", "en", "b", 1, *own) for i in range(20)]  # near
    out += [out[5]] * 30  # equal in every column
    out += [(None, prose(rng, 100), "en", None, None, *[None] * 6), (None, None, None, None, None, *[None] * 6), (400, "", "en", "a", 0, *own), (401, None, "en", "a", None, *own)]
    out += [(402, prose(rng, 40_000), "en", "a", 1, *own), (403, "### " * 200, "en", "a", 1, *own)]
    return out


def test_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(rows(), DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(P.STAGES)
    key = lambda df: Counter(map(repr, df.collect()))
    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    scored = quality_rules.score(docs).collect()
    verdict = Counter(repr(r["_doc"]) for r in scored if r["_kept"])
    assert next(r["_q"].n_words for r in scored if r["_doc"].doc_id == 402) == 40_000  # read whole, and repetitive
    assert key(kept) == verdict and not any(r.text in (None, "") for r in kept.collect())
    once = stages["exact_dedup"](spark, kept, str(tmp_path))
    groups: dict[str, list] = {}
    for r in kept.collect():
        groups.setdefault("".join(r.text.split()), []).append(r)
    least = lambda g: min(g, key=lambda r: (-len(r.text), r.doc_id is None, r.doc_id or 0))
    assert sorted(map(repr, once.collect())) == sorted(repr(least(g)) for g in groups.values())
    near = stages["simhash"](spark, once, str(tmp_path))
    left = {r.doc_id for r in near.collect()}
    assert near.columns == docs.columns and len(left & {4, *range(300, 320)}) >= 1 and left <= {r.doc_id for r in once.collect()}
    assert len(left & set(range(300, 320))) < 20
    mixed = stages["mixing"](spark, near, str(tmp_path))
    want = Counter()
    for r in mixing.taken(near).collect():
        want[repr(r["_doc"])] += r["_copies"]
    assert key(mixed) == +want and mixed.columns == docs.columns
    sp = coder(default_model()).sp
    text = {r.doc_id: r.text for r in near.collect()}
    made = stages["sentencepiece"](spark, mixed, str(tmp_path)).collect()
    assert len(made) == mixed.count()
    for r in made:
        ids = [sp.bos_id(), *sp.encode(text[r.doc_id]), sp.eos_id()]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    whole = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in whole) == Counter((r.doc_id, r.ids_sha256) for r in made)
    assert not {402, 403} & {r.doc_id for r in kept.collect()} and None in left


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None, *[None] * 6), (2, "too short", "en", "a", 9, *[None] * 6)]])
def test_nothing_is_kept(spark, tmp_path, data):
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
