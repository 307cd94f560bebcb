"""Block trees from converter JSON: pages with nested children, from one pass over each document."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.nested import nodes


def properties(block_type: Column, html: Column) -> Column:
    """Properties by the words in the block type and its html."""
    has = lambda s: F.contains(block_type, F.lit(s))
    level = F.regexp_extract(html, r"<h(\d)", 1).try_cast("int")
    rows = F.regexp_count(html, F.lit(r"<tr\b"))
    first = F.regexp_extract(html, r"(?s)<tr\b(.*?)(</tr>|<tr\b|$)", 1)
    language = F.regexp_extract(html, r'class="language-(\w+)"', 1)
    return F.struct(
        F.when(has("SectionHeader"), level).alias("heading_level"),
        F.when(has("Table"), rows).alias("row_count"),
        F.when(has("Table") & (rows > 0), F.regexp_count(first, F.lit(r"<t[dh]\b"))).alias("column_count"),
        F.when(has("ListItem") | has("ListGroup"), F.when(F.contains(html, F.lit("<ol")), "ordered").otherwise("unordered")).alias("list_type"),
        F.when(has("Code") & (language != ""), language).alias("language"),
        F.when(F.contains(F.lower(html), F.lit("blockquote")), F.lit(True)).alias("blockquote"),
    )


def text_of(html: Column) -> Column:
    """Tags out, character references of the markup decoded."""
    c = F.regexp_replace(html, r"<[^>]*>", " ")
    for safe, raw in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def single_spaced(text: Column) -> Column:
    """White space collapsed. Plain searches find the few texts that need the pattern, which costs more than the rest."""
    spaced = reduce(or_, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\n", "\x0b", "\f", "\r")])
    return F.trim(F.when(spaced, F.regexp_replace(text, r"\s+", " ")).otherwise(text))


def blocks(files: DataFrame) -> DataFrame:
    """files (doc_id, json) to block rows with a path, of all levels. Broken files give no rows."""
    found = nodes(files, ("children",), texts=("id", "block_type", "html"), numbers=("bbox",)).filter(F.size("path") > 1)
    out = found.select("*", F.get("path", F.lit(0)).alias("page_idx"), F.try_parse_json("node").alias("v"))
    get = lambda name, t: F.coalesce(F.col(name), F.try_variant_get("v", f"$.{name}", t))
    kind = F.coalesce(get("block_type", "string"), F.lit("Unknown"))
    html = F.coalesce(get("html", "string"), F.lit(""))
    auto = F.concat(F.lit("page_"), F.col("page_idx").cast("string"), F.lit("/"), kind, F.lit("/auto"))
    rows = out.select("doc_id", (F.col("page_idx") + 1).alias("page_number"), F.slice("path", 2, 1 << 30).alias("path"), F.coalesce(get("id", "string"), auto).alias("id"), kind.alias("block_type"), text_of(html).alias("content"), html.alias("html"), get("bbox", "array<double>").alias("bbox"))
    rows = rows.withColumn("content", single_spaced(F.col("content")))
    return rows.select("*", properties(F.col("block_type"), F.col("html")).alias("_p")).select("*", "_p.*").drop("_p")
