"""Types, roles and order of blocks: heuristics, tags by index, fuzzy text match, batches, fallbacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import guess_block_type, guess_role, rhetoric, rhetoric_features, safe_block_type, safe_role, truncated
from quire.schema import RHETORIC, RHETORIC_FEATURES
from quire.staging import written

PAGE = ["doc_id", "page_number"]
BATCH = 50
SUMMARY_CHARS, BATCH_CHARS, FUZZY_CHARS = 120, 80, 200
FUZZY_LEAST = 0.4


def heuristic(blocks: DataFrame) -> DataFrame:
    """block_type, role and reading_order without tags."""
    order = Window.partitionBy(*PAGE).orderBy("block_idx")
    typed = blocks.withColumn("block_type", guess_block_type(F.col("text"), F.col("size"), F.col("fontname")))
    return typed.withColumn("role", guess_role(F.col("block_type"))).withColumn("reading_order", F.row_number().over(order) - 1)


def heuristic_fields(block: Column, place: Column) -> list[Column]:
    """heuristic of one block (text, size, fontname) at a place of its page."""
    kind = guess_block_type(block["text"], block["size"], block["fontname"])
    return [kind.alias("block_type"), guess_role(kind).alias("role"), place.alias("reading_order")]


def fallback(blocks: DataFrame, case: str) -> DataFrame:
    """What blocks get where tagging does not give it: no_vision, vision_error, no_tags, docx."""
    order = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_idx")) - 1
    if case == "no_vision":
        return heuristic(blocks)
    if case == "vision_error":
        return heuristic(blocks).withColumn("role", F.lit("paragraph"))
    if case == "no_tags":
        return blocks.withColumn("block_type", F.lit("paragraph")).withColumn("role", F.lit("paragraph")).withColumn("reading_order", order)
    if case == "docx":
        return blocks
    raise ValueError(f"unknown case {case}")


def last_tags(tags: DataFrame) -> DataFrame:
    """The last tag of each block index; a negative reading order is set aside as null."""
    last = Window.partitionBy(*PAGE, "block_index").orderBy(F.col("tag_pos").desc())
    return tags.filter(F.col("block_index").isNotNull()).withColumn("_rank", F.row_number().over(last)).filter("_rank = 1").drop("_rank")


def match_by_index(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """blocks with the fields of their tag; untagged ones are paragraphs in position order."""
    t = last_tags(tags).select(*PAGE, F.col("block_index").alias("block_idx"), F.col("block_type").alias("_type"), F.col("role").alias("_role"), F.when(F.col("reading_order") >= 0, F.col("reading_order")).alias("_order"), F.col("rhetoric").alias("_rhetoric"), F.col("rhetoric_features").alias("_features"), F.lit(True).alias("matched"))
    out = blocks.join(t, [*PAGE, "block_idx"], "left")
    return out.select(
        *blocks.columns,
        safe_block_type(F.coalesce("_type", F.lit("paragraph"))).alias("block_type"),
        safe_role(F.coalesce("_role", F.lit("paragraph"))).alias("role"),
        F.coalesce("_order", "block_idx").alias("reading_order"),
        F.col("_rhetoric").alias("rhetoric"),
        F.col("_features").alias("rhetoric_features"),
        F.coalesce("matched", F.lit(False)).alias("matched"),
    )


def parsed_rhetoric(col: Column) -> Column:
    return rhetoric(F.from_json(col, ", ".join(f"{k} string" for k in RHETORIC)))


def parsed_features(col: Column) -> Column:
    return rhetoric_features(F.from_json(col, ", ".join(f"{k} string" for k in RHETORIC_FEATURES)))


def best_tags(blocks: list[str], tags: list[str]) -> list[tuple[int, float] | None]:
    """For each block text in order the most similar tag text that is left (its place and ratio), the earliest on a tie; None below FUZZY_LEAST."""
    free, out = [(i, t[:FUZZY_CHARS]) for i, t in enumerate(tags) if t], []
    for text in blocks:
        best, best_at = 0.0, -1
        for at, (_, other) in enumerate(free if text else []):
            m = SequenceMatcher(None, text[:FUZZY_CHARS], other)
            # Upper bounds first: a tag that cannot be the best, or good enough, needs no ratio.
            need = max(best, FUZZY_LEAST)
            if m.real_quick_ratio() <= need or m.quick_ratio() <= need:
                continue
            score = m.ratio()
            if score > best:
                best, best_at = score, at
        out.append((free.pop(best_at)[0], best) if best > FUZZY_LEAST else None)
    return out


def _by_text(page: Column) -> Column:
    """page: blocks and tags, arrays of texts. For each block the place of its tag and their ratio, null without one."""

    def match(page: pa.Array) -> pa.Array:
        places, ratios, ends = [], [], [0]
        for p in page.to_pylist():
            for found in best_tags([x or "" for x in p["blocks"]], [x or "" for x in p["tags"]]):
                places.append(None if found is None else found[0])
                ratios.append(None if found is None else round(found[1], 6))
            ends.append(len(places))
        pairs = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(ratios, pa.float64())], ["at", "ratio"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)

    return F.arrow_udf(match, "array<struct<at:int,ratio:double>>")(page)


def tagged(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """blocks with type, role, order, rhetoric and how they got them: by index, else by text, else by default.

    One exchange: blocks and tags of a page meet in one group, each side in order, and the blocks' own columns go along.
    The last tag of an index counts. Tags of no block's index, or without one, are matched by text, which is sequential
    within a page, so that alone runs in Python, on texts cut to FUZZY_CHARS. A group is one page.
    """
    own = [c for c in blocks.columns if c not in PAGE]
    b = blocks.select(*PAGE, F.struct("block_idx", F.struct(*own).alias("row")).alias("b"), F.lit(None).cast(f"struct<{_TAG}>").alias("t"))
    fields = [F.col(f.split()[0]).cast(f.split()[1]).alias(f.split()[0]) for f in _TAG.split(", ")]
    t = tags.select(*PAGE, F.lit(None).cast(b.schema["b"].dataType).alias("b"), F.struct(*fields).alias("t"))
    pages = b.unionByName(t).groupBy(*PAGE).agg(F.sort_array(F.collect_list("b")).alias("_b"), F.sort_array(F.collect_list("t")).alias("_t")).filter(F.size("_b") > 0)
    places = F.transform("_b", lambda x: x["block_idx"])
    indexed = F.transform("_b", lambda x: F.try_element_at(F.filter("_t", lambda y: y["block_index"] == x["block_idx"]), F.lit(-1)))
    pages = pages.withColumn("_free", F.filter("_t", lambda y: y["block_index"].isNull() | ~F.array_contains(places, y["block_index"]))).withColumn("_by_index", indexed)
    cut = lambda c: F.left(c, F.lit(FUZZY_CHARS))
    open_ = F.filter(F.transform("_b", lambda x, i: F.when(F.get("_by_index", i).isNull(), F.struct(i.alias("i"), cut(x["row"]["text"]).alias("text")))), lambda x: x.isNotNull())
    pages = pages.withColumn("_open", F.when(F.exists("_free", lambda y: y["text"] != ""), open_).otherwise(F.slice(open_, 1, 0)))
    pages = pages.withColumn("_found", _by_text(F.struct(F.col("_open")["text"].alias("blocks"), F.transform("_free", lambda y: cut(y["text"])).alias("tags"))))
    near = F.map_from_arrays(F.col("_open")["i"], F.col("_found"))
    pages = pages.withColumn("_near", near).select(*PAGE, "_b", "_by_index", "_free", F.posexplode(F.transform("_b", lambda x, i: F.try_element_at("_near", i))).alias("_i", "_m"))
    one = pages.select(*PAGE, F.get("_b", F.col("_i")).alias("_b"), F.get("_by_index", F.col("_i")).alias("_x"), F.get("_free", F.col("_m.at")).alias("_y"), F.col("_m.ratio").alias("ratio"))
    tag = lambda field: F.coalesce(F.col(f"_x.{field}"), F.col(f"_y.{field}"))
    order = tag("reading_order")
    return one.select(
        *PAGE,
        *[F.col("_b.row")[c].alias(c) for c in own if c not in ("block_type", "role", "reading_order", "rhetoric", "rhetoric_features")],
        safe_block_type(F.coalesce(tag("block_type"), F.lit("paragraph"))).alias("block_type"),
        safe_role(F.coalesce(tag("role"), F.lit("paragraph"))).alias("role"),
        F.coalesce(F.when(order >= 0, order), F.col("_b.block_idx")).alias("reading_order"),
        tag("rhetoric").alias("rhetoric"),
        tag("rhetoric_features").alias("rhetoric_features"),
        F.when(F.col("_x").isNotNull(), "index").when(F.col("_y").isNotNull(), "text").otherwise("default").alias("how"),
        F.col("_y.tag_pos").alias("text_tag_pos"),
        "ratio",
    )


_TAG = "tag_pos int, block_index int, block_type string, role string, reading_order int, text string, rhetoric string, rhetoric_features string"


def match_by_text(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """The blocks without a tag of their index, and the tag that each has by its text."""
    found = tagged(blocks, tags).filter("how <> 'index'")
    return found.select(*PAGE, "block_idx", F.col("text_tag_pos").cast("long").alias("tag_pos"), "ratio", "block_type", "role")


def split_tags(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags that can be used, and those set aside with their problems: a reading order that is null or negative.

    Both come from one pass, written once; a tag that is set aside spoils neither its page nor its document.
    """
    order = F.col("reading_order")
    problem = F.when(order.isNull(), "no order").when(order < 0, "negative order")
    seen = written(tags.withColumn("problem", problem), "tags")
    return seen.filter("problem IS NULL").drop("problem"), seen.filter("problem IS NOT NULL")


def batches(blocks: DataFrame, order: list[str]) -> DataFrame:
    """blocks with their batch and index in it: BATCH blocks each, in document order."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return blocks.withColumn("global_idx", at).withColumn("batch", F.floor(F.col("global_idx") / BATCH).cast("int")).withColumn("batch_idx", F.pmod("global_idx", F.lit(BATCH)))


def apply_batch_tags(blocks: DataFrame, tags: DataFrame) -> DataFrame:
    """blocks (batched, typed) with tags (doc_id, batch, block_index, ...): missing fields keep the old value, rhetoric does not."""
    t = tags.filter((F.col("block_index") >= 0) & (F.col("block_index") < BATCH)).select("doc_id", "batch", F.col("block_index").alias("batch_idx"), F.col("block_type").alias("_type"), F.col("role").alias("_role"), F.col("reading_order").alias("_order"), F.col("rhetoric").alias("_rhetoric"), F.lit(True).alias("_hit"))
    out = blocks.join(t, ["doc_id", "batch", "batch_idx"], "left")
    replaced = [
        F.coalesce("_type", "block_type").alias("block_type"),
        F.coalesce("_role", "role").alias("role"),
        F.coalesce("_order", "reading_order", "global_idx").alias("reading_order"),
        F.col("_rhetoric").alias("rhetoric"),
    ]
    return out.select(*[c for c in blocks.columns if c not in ("block_type", "role", "reading_order", "rhetoric")], *replaced)


BatchTagger = Callable[[list[dict]], list[dict]]
_BATCH_TAG = "block_index int, block_type string, role string, reading_order int, rhetoric string, rhetoric_features string"
BATCH_TAGS = f"doc_id long, batch int, {_BATCH_TAG}, error string"
#: Calls that a worker has open at a time.
BATCH_CALLS = 8


def batch_summaries(blocks: DataFrame) -> DataFrame:
    """What a batch tagger sees: for each (doc_id, batch) the blocks' index, first BATCH_CHARS characters, font and size."""
    row = F.struct(F.col("batch_idx").cast("int").alias("index"), F.left(F.coalesce("text", F.lit("")), F.lit(BATCH_CHARS)).alias("text"), F.coalesce("fontname", F.lit("")).alias("font"), F.coalesce(F.col("size").cast("double"), F.lit(0.0)).alias("size"))
    return blocks.groupBy("doc_id", "batch").agg(F.sort_array(F.collect_list(row)).alias("blocks"))


def tag_batches(summaries: DataFrame, tagger: BatchTagger) -> DataFrame:
    """Runs a tagger, a function of one batch's summary, on every batch, some at a time in a worker, to BATCH_TAGS.

    A call that fails gives one row with the error and no tag, so its blocks keep their types; a retried task calls again.
    """
    names = [f.split()[0] for f in _BATCH_TAG.split(", ")]

    def call(unit: tuple) -> list[tuple]:
        doc_id, batch, blocks = unit
        try:
            return [(doc_id, batch, *[t.get(n) for n in names], None) for t in tagger(blocks)]
        except Exception as e:  # noqa: BLE001  a tagger is foreign code
            return [(doc_id, batch, *[None] * len(names), str(e))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
        with ThreadPoolExecutor(BATCH_CALLS) as pool:
            for b in batches:
                found = [r for rs in pool.map(call, zip(*[b.column(c).to_pylist() for c in range(3)], strict=True)) for r in rs]
                columns = zip(*found, strict=True) if found else [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "batch", *names, "error"])

    return summaries.select("doc_id", "batch", "blocks").mapInArrow(rows, BATCH_TAGS)


def refine_in_batches(blocks: DataFrame, tagger: BatchTagger, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """blocks (typed) after a tagger's calls, by batch and place, and the batches that failed: doc_id, batch, error.

    The calls are made once and their tags written, whatever reads the two results.
    """
    b = batches(blocks, order)
    tags = written(tag_batches(batch_summaries(b), tagger), "batch_tags")
    return apply_batch_tags(b, tags.filter("error IS NULL")), tags.filter("error IS NOT NULL").select("doc_id", "batch", "error")


def blocks_summary(blocks: DataFrame) -> DataFrame:
    """What a tagger sees of a page: index, shortened text, font, size."""
    at = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_idx")) - 1
    return blocks.select(*PAGE, at.alias("index"), truncated(F.col("text"), SUMMARY_CHARS).alias("text"), F.col("fontname").alias("font"), "size")


Tagger = Callable[[pd.DataFrame], pd.DataFrame]
TAGS = "doc_id long, page_number int, tag_pos int, block_index int, block_type string, role string, reading_order int, text string, rhetoric string, rhetoric_features string, error string"


def tag_pages(summaries: DataFrame, tagger: Tagger) -> DataFrame:
    """Runs a tagger, a function of one page's summary, on every page; an error becomes a row instead of a lost job."""

    def pages(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return tagger(pdf.sort_values("index")).assign(error=None)
        except Exception as e:  # noqa: BLE001  a tagger is foreign code
            head = pdf.iloc[0]
            return pd.DataFrame([{c.split()[0]: None for c in TAGS.split(", ")} | {"doc_id": head["doc_id"], "page_number": head["page_number"], "block_type": "Error", "error": str(e)}])

    return summaries.groupBy(*PAGE).applyInPandas(pages, TAGS)


def heuristic_tagger(pdf: pd.DataFrame) -> pd.DataFrame:
    """The built-in tagger: types by size only."""
    kinds = ["heading" if s >= 14 else "paragraph" for s in pdf["size"]]
    return pd.DataFrame({"doc_id": pdf["doc_id"], "page_number": pdf["page_number"], "tag_pos": pdf["index"], "block_index": pdf["index"], "block_type": kinds, "role": ["section_title" if k == "heading" else k for k in kinds], "reading_order": pdf["index"], "text": None, "rhetoric": None, "rhetoric_features": None})
