"""Tagging in one step against a plain loop over pages; tokens of blocks; tags that are set aside."""

from __future__ import annotations

import json
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quire.operators import assemble, geometry, semantics
from quire.plans import pipelines
from quire.schema import BLOCK_TYPES, CHAR, ROLES

BLOCK = "doc_id long, page_number int, block_idx int, id string, text string, words array<struct<text string>>"
TAG = "doc_id long, page_number int, tag_pos int, block_index int, block_type string, role string, reading_order int, text string, rhetoric string, rhetoric_features string"


def plain(blocks, tags):
    """(doc_id, page, block) to (type, role, order, how, place of the tag)."""
    out = {}
    for page in {(b[0], b[1]) for b in blocks}:
        own = sorted(b for b in blocks if b[:2] == page)
        marks = sorted((t for t in tags if t[:2] == page), key=lambda t: t[2])
        by_index = {t[3]: t for t in marks if t[3] is not None}
        indices = {b[2] for b in own}
        free = [t for t in marks if t[3] not in indices]
        for b in own:
            found, how = by_index.get(b[2]), "index"
            if found is None:
                best, how = 0.0, "text"
                for t in free:
                    if b[4] and t[7]:
                        score = SequenceMatcher(None, b[4][:200], t[7][:200]).ratio()
                        if score > best:
                            best, found = score, t
                if best > 0.4:
                    free.remove(found)
                else:
                    found, how = None, "default"
            kind, role, order = (found[4], found[5], found[6]) if found else (None, None, None)
            order = order if order is not None and order >= 0 else b[2]
            out[b[:3]] = (kind if kind in BLOCK_TYPES else "paragraph", role if role in ROLES else "paragraph", order, how)
    return out


def pages(seed, n=40):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice("abc d") for _ in range(rng.choice([0, 3, 12, 30, 260])))
    blocks, tags = [], []
    for page in range(1, n):
        own = [(1, page, i, f"{page}.{i}", rng.choice([None, "", text(), text()]), [("w",)]) for i in range(rng.randrange(0, 9))]
        blocks += own
        for pos in range(rng.randrange(0, 12)):
            like = rng.choice(own)[4] if own and rng.random() < 0.5 else text()
            like = like and "".join(c if rng.random() < 0.9 else "z" for c in like)
            tags.append((1, page, pos, rng.choice([None, 99, 1000 + pos, rng.randrange(9)]), rng.choice(["heading", "table", "odd", None]), rng.choice(["title", "odd", None]), rng.choice([None, -1, pos]), like, None, None))
    return blocks, tags


def test_one_step_against_loops(spark):
    seen = set()
    for seed in range(4):
        blocks, tags = pages(seed)
        got = semantics.tagged(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(tags, TAG)).collect()
        assert {(r.doc_id, r.page_number, r.block_idx): (r.block_type, r.role, r.reading_order, r.how) for r in got} == plain(blocks, tags)
        assert all(r.id == f"{r.page_number}.{r.block_idx}" and r.words[0].text == "w" for r in got) and len(got) == len(blocks)
        assert all((r.ratio is not None and r.ratio > 0.4) == (r.how == "text") for r in got)
        seen |= {r.how for r in got}
    assert seen == {"index", "text", "default"}


def test_one_exchange(spark, tmp_path):
    blocks, tags = pages(9)
    spark.createDataFrame(blocks, BLOCK).write.parquet(str(tmp_path / "b"))
    spark.createDataFrame(tags, TAG).write.parquet(str(tmp_path / "t"))
    plan = semantics.tagged(spark.read.parquet(str(tmp_path / "b")), spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_tags_and_no_blocks(spark):
    blocks, tags = pages(2)
    b, t = spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(tags, TAG)
    assert {r.how for r in semantics.tagged(b, t.limit(0)).collect()} == {"default"}
    assert semantics.tagged(b.limit(0), t).count() == 0


def test_tags_set_aside(spark):
    _, tags = pages(3)
    good, bad = semantics.split_tags(spark.createDataFrame(tags, TAG))
    assert good.columns == TAG.replace(",", "").split()[::2]
    assert good.count() + bad.count() == len(tags)
    assert {r.problem for r in bad.collect()} == {"no order", "negative order"} and all(r.reading_order >= 0 for r in good.collect())


def test_tokens(spark):
    """Every word is a token of one block, in the block's order, in the table of blocks and in the JSON."""
    rng = random.Random(5)
    rows = []
    for page in (1, 2):
        for i in range(400):
            row, col = divmod(i, 25)
            if rng.random() < 0.85:
                rows.append((1, page, i, rng.choice("abcdef"), 60.0 + 6 * col + (40 if col > 12 else 0), 50.0 + 20 * row + (60 if row > 8 else 0), 66.0 + 6 * col + (40 if col > 12 else 0), 60.0 + 20 * row + (60 if row > 8 else 0), rng.choice(["Arial", "Times"]) if row % 5 == 0 else "Arial", 10.0, "#000000"))
    chars = spark.createDataFrame(rows, CHAR)
    page = spark.createDataFrame([(1, p, 612.0, 792.0) for p in (1, 2)], "doc_id long, page_number int, width double, height double")
    words = geometry.build_words(geometry.filter_chars(chars))
    blocks = geometry.build_blocks(geometry.build_lines(words, with_words=True))
    without = geometry.build_blocks(geometry.build_lines(words))
    assert sorted(map(repr, blocks.drop("words").collect())) == sorted(map(repr, without.collect()))
    for b in blocks.collect():
        assert " ".join(w.text for w in b.words) == b.text.replace("\n", " ")
        assert all(b.x0 <= w.x0 and w.x1 <= b.x1 and b.y0 <= w.y0 and w.y1 <= b.y1 for w in b.words)
    tokens = assemble.tokens(assemble.with_tokens(assemble.boxed(blocks, page)))
    box = lambda r: tuple(r)
    assert sorted(box(r.bbox) for r in tokens.collect()) == sorted((r.x0, r.y0, r.x1, r.y1) for r in words.collect())
    got = json.loads(pipelines.layout_document(chars, page).first().json)
    assert len(got["tokens"]) == words.count() > 50
    text = {b["id"]: b["text"] for b in got["blocks"]}
    span = {s["id"]: s["block_id"] for s in got["spans"]}
    each: dict[str, list] = {}
    for t in got["tokens"]:
        assert span[t["span_id"]] == t["block_id"]
        each.setdefault(t["block_id"], []).append(t["text"])
        assert t["bbox_norm"] == [round(v / e, 6) for v, e in zip(t["bbox"], (612, 792, 612, 792), strict=True)]
    assert {k: " ".join(v) for k, v in each.items()} == {k: v.replace("\n", " ") for k, v in text.items()}
    assert list(each) == [b["id"] for b in got["blocks"]]
    tags = spark.createDataFrame([(1, 1, 0, 0, "caption", "caption", 3, None, None, None)], TAG)
    typed = json.loads(pipelines.layout_document(chars, page, tags=tags).first().json)
    assert [b["type"] for b in typed["blocks"]].count("caption") == 1 and len(typed["tokens"]) == len(got["tokens"])


def test_style_lookup(spark):
    b = assemble.with_style(spark.createDataFrame([(1, "Arial-Bold", 12.0, "#000000"), (1, "Times", 9.04, None), (2, "Times", 9.0, None)], "doc_id long, fontname string, size double, color string"))
    found = assemble.styled(b.drop("_style", "size", "color"), assemble.styles(b.drop("style_id", "_style"), ["doc_id"])).select("doc_id", "font_family", "weight", "size").collect()
    assert sorted(map(tuple, found)) == [(1, "Arial-Bold", "bold", 12.0), (1, "Times", "normal", 9.0), (2, "Times", "normal", 9.0)]
    assert F is not None
