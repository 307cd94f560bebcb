"""The gate for edited document JSON: an edit that is no valid document is rejected and the old state stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.nested import nodes


def _kind(path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get("v", path, "variant"))


def _text(name: str, needed: bool = False) -> Column:
    """Whether a field is a string, or absent if it need not be there."""
    is_text = _kind(f"$.{name}") == "STRING"
    return F.coalesce(is_text, F.lit(not needed))


def _list(name: str) -> Column:
    return F.coalesce(F.startswith(_kind(f"$.{name}"), F.lit("ARRAY")), F.lit(True))


def invalid(edits: DataFrame) -> DataFrame:
    """doc_id of the edits (doc_id, json) that are no documents, with a reason for each fault found. Blocks of all levels are checked.

    Checked: the texts of the document; an integral page_number of each page; id and block_type of each block, its
    texts, its box of numbers, its properties; that lists are lists.
    """
    found = nodes(edits, ("pages", "blocks", "children")).select("doc_id", F.size("path").alias("level"), F.try_parse_json("node").alias("v"))
    is_object = F.startswith(F.schema_of_variant("v"), F.lit("OBJECT"))
    document = _text("title") & _text("filename") & _text("schema_version") & _list("pages")
    number = F.try_variant_get("v", "$.page_number", "double")
    page = is_object & (number == F.floor(number)) & (_kind("$.page_number") != "BOOLEAN") & _list("blocks")
    box = F.coalesce(F.size(F.filter(F.try_variant_get("v", "$.bbox", "array<variant>"), lambda x: F.try_variant_get(x, "$", "double").isNull())) == 0, F.lit(True))
    properties = F.coalesce(F.startswith(_kind("$.properties"), F.lit("OBJECT")) | (_kind("$.properties") == "VOID"), F.lit(True))
    block = is_object & _text("id", True) & _text("block_type", True) & _text("content") & _text("html") & _list("bbox") & box & properties & _list("children")
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    level = F.col("level")
    reason = F.when(level == 0, F.when(bad(is_object), "json").when(bad(document), "document")).when(level == 1, F.when(bad(page), "page")).otherwise(F.when(bad(block), "block"))
    faults = found.select("doc_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return faults.groupBy("doc_id").agg(F.array_sort(F.collect_set("reason")).alias("reasons"))


def gated(old: DataFrame, edits: DataFrame) -> DataFrame:
    """old (doc_id, json) after the edits (doc_id, json): the new JSON where it is valid, and the reasons where it is not."""
    new = edits.select("doc_id", F.col("json").alias("_new")).join(invalid(edits), "doc_id", "left")
    out = old.join(new, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("_new").isNotNull() & F.col("reasons").isNull(), F.col("_new")).otherwise(F.col("json")).alias("json"), "reasons")
