"""Block trees as rows with a path: order, edits, counts, paging, exports.

The path is the ordinals from the root to a block; ordering by path is depth-first order.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import lookup

PER_PAGE = 35
TITLE = "__title__"

# Icons and colours of block types.
ICONS = {"SectionHeader": "📑", "Text": "📝", "Table": "📊", "ListItem": "📋", "ListGroup": "📋", "Code": "💻", "Equation": "🔢", "Figure": "🖼️", "Picture": "🖼️", "Caption": "💬", "Footnote": "📌", "Form": "📝", "Handwriting": "✍️", "TableOfContents": "📖", "Reference": "🔗", "Page": "📄", "ComplexRegion": "🧩"}
COLORS = {"SectionHeader": "#6C5CE7", "Text": "#00B894", "Table": "#E17055", "ListItem": "#0984E3", "ListGroup": "#0984E3", "Code": "#F39C12", "Equation": "#E84393", "Figure": "#00CEC9", "Picture": "#00CEC9", "Caption": "#636E72", "Footnote": "#B2BEC3", "Form": "#A29BFE", "Handwriting": "#FD79A8", "TableOfContents": "#74B9FF", "Reference": "#DFE6E9", "Page": "#2D3436", "ComplexRegion": "#FDCB6E"}
DEFAULT_ICON, DEFAULT_COLOR = "📦", "#636E72"


def flattened(blocks: DataFrame) -> DataFrame:
    """blocks with depth and their depth-first position in the page."""
    order = Window.partitionBy("doc_id", "page_number").orderBy("path")
    return blocks.withColumn("depth", F.size("path") - 1).withColumn("dfs_idx", F.row_number().over(order) - 1)


def apply_edits(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Every block whose id is edited gets the new content, an empty one too."""
    e = edits.filter(F.col("block_id") != TITLE).select("doc_id", F.col("block_id").alias("id"), F.col("new_content").alias("_new"), F.lit(True).alias("_hit"))
    return blocks.join(e, ["doc_id", "id"], "left").withColumn("content", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("content"))).select(*blocks.columns)


def edited_titles(titles: DataFrame, edits: DataFrame) -> DataFrame:
    """titles (doc_id, title) with title edits."""
    e = edits.filter(F.col("block_id") == TITLE).select("doc_id", F.col("new_content").alias("_new"), F.lit(True).alias("_hit"))
    return titles.join(e, "doc_id", "left").withColumn("title", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("title"))).drop("_new", "_hit")


def apply_first(blocks: DataFrame, edits: DataFrame) -> DataFrame:
    """Only the first block of an edited id, in page and depth-first order, gets the new content."""
    e = edits.filter(F.col("block_id") != TITLE).select("doc_id", F.col("block_id").alias("id"), F.col("new_content").alias("_new"), F.lit(True).alias("_hit"))
    first = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("page_number", "path")) == 1
    return blocks.withColumn("_first", first).join(e, ["doc_id", "id"], "left").withColumn("content", F.when(F.col("_hit") & F.col("_first"), F.col("_new")).otherwise(F.col("content"))).select(*blocks.columns)


def without_html(blocks: DataFrame) -> DataFrame:
    return blocks.drop("html")


def emptied(blocks: DataFrame) -> DataFrame:
    """The template: all contents empty, html and properties as they were."""
    return blocks.withColumn("content", F.lit(""))


def type_counts(blocks: DataFrame) -> DataFrame:
    """Top-level blocks by type, and as one map per document."""
    return blocks.filter(F.size("path") == 1).groupBy("doc_id", "block_type").agg(F.count("*").alias("n"))


def metrics(blocks: DataFrame) -> DataFrame:
    """Pages, top-level blocks, editable fields and block types of each document."""
    top = F.size("path") == 1
    return blocks.groupBy("doc_id").agg(
        F.countDistinct("page_number").alias("n_pages"),
        F.count_if(top).alias("n_blocks"),
        F.count_if(F.col("content") != "").alias("n_editable"),
        F.countDistinct(F.when(top, F.col("block_type"))).alias("n_types"),
    )


def paged(blocks: DataFrame, per_page: int = PER_PAGE) -> DataFrame:
    """Top-level blocks (doc_id, ordinal, id, child_ids) in pages; ids of blocks and direct children get the page."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal")) - 1
    page = F.floor(at / per_page).cast("int")
    rows = blocks.withColumn("_page", page)
    to = F.concat(F.lit("page_"), F.col("_page").cast("string"), F.lit("/"))
    out = rows.withColumn("id", F.replace("id", F.lit("page_0/"), to)).withColumn("child_ids", F.transform("child_ids", lambda c: F.replace(c, F.lit("page_0/"), to)))
    return out.withColumn("page_number", F.col("_page") + 1).drop("_page")


def escaped(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _el(tag: str, inner: Column) -> Column:
    return F.concat(F.lit(f"<{tag}>"), inner, F.lit(f"</{tag}>"))


#: The head of an exported page.
HEAD_STYLE = """  <style>
    body { font-family: -apple-system, BlinkMacSystemFont, 'Segoe UI', Roboto, Helvetica, Arial, sans-serif; line-height: 1.6; max-width: 800px; margin: 0 auto; padding: 2rem; color: #333; }
    h1, h2, h3, h4, h5, h6 { margin-top: 1.5em; margin-bottom: 0.5em; color: #111; }
    p { margin-bottom: 1em; }
    table { border-collapse: collapse; width: 100%; margin-bottom: 1em; }
    th, td { border: 1px solid #ddd; padding: 8px; text-align: left; }
    th { background-color: #f5f5f5; }
    blockquote { border-left: 4px solid #ddd; padding-left: 1rem; color: #666; margin-left: 0; }
    pre { background: #f4f4f4; padding: 1rem; overflow-x: auto; border-radius: 4px; }
    code { font-family: ui-monospace, SFMono-Regular, Menlo, Monaco, Consolas, monospace; background: #f4f4f4; padding: 0.2em 0.4em; border-radius: 3px; }
  </style>"""
PAGE_BREAK = "<hr style='border: 0; border-top: 1px dashed #ccc; margin: 2rem 0;' />"
CHILDREN_OPEN = "<div class='children' style='margin-left: 1rem;'>"
LAST = 2**31 - 1


def html_pieces(blocks: DataFrame) -> DataFrame:
    """doc_id, page_number, key, piece: the pieces of the exported body; order by page and key gives the page.

    A block opens at its path and closes after all paths below it. Lists and tables render their children themselves.
    Windows over a page in the order of its paths tell a block's root and whether the next block is its child, so the
    blocks are read once and dealt once. A page that shows nothing keeps a row without piece.
    """
    page = ["doc_id", "page_number"]
    root = F.max(F.when(F.size("path") == 1, F.col("block_type"))).over(Window.partitionBy(*page, F.get("path", F.lit(0))))
    after = F.lead("path").over(Window.partitionBy(*page).orderBy("path"))
    b = blocks.withColumn("_after", after).withColumn("_root_type", root).filter("_root_type IS NOT NULL")
    b = b.withColumn("_kids", F.coalesce(F.slice("_after", 1, F.size("path")) == F.col("path"), F.lit(False)))
    text = escaped(F.coalesce("content", F.lit("")))
    depth = F.size("path")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.when(F.coalesce("heading_level", F.lit(0)) != 0, F.col("heading_level")).otherwise(2))).cast("string")
    head = F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))
    para = F.when(F.col("blockquote"), F.concat(F.lit("<blockquote><p>"), text, F.lit("</p></blockquote>"))).otherwise(_el("p", text))
    code = F.concat(F.lit("<pre><code>"), text, F.lit("</code></pre>"))
    list_tag = F.when(F.col("list_type") == "ordered", "ol").otherwise("ul")
    kind = F.col("block_type")
    self_made = kind.isin("List", "Table")
    in_list = (depth == 2) & (F.col("_root_type") == "List")
    in_table_row = (depth == 2) & (F.col("_root_type") == "Table")
    in_table_cell = (depth == 3) & (F.col("_root_type") == "Table")
    below = (depth > 1) & F.col("_root_type").isin("List", "Table") & ~in_list & ~in_table_row & ~in_table_cell
    shown = (F.coalesce("content", F.lit("")) != "") | F.col("_kids")
    nest = F.col("_kids") & ~self_made
    list_open = F.concat(F.when(text != "", F.concat(_el("p", text), F.lit("\n"))).otherwise(""), F.lit("<"), list_tag, F.lit(">"))
    plain = F.when(kind == "SectionHeader", head).when(kind == "Text", para).when(kind == "Code", code).when(kind == "Equation", F.concat(F.lit("<div class='equation'>\\[ "), text, F.lit(" \\]</div>"))).otherwise(_el("div", text))
    opening = (
        F.when(in_list, _el("li", text))
        .when(in_table_row, F.lit("<tr>"))
        .when(in_table_cell, _el("td", text))
        .when(below | ~shown, F.lit(None))
        .when(kind == "List", list_open)
        .when((kind == "Table") & F.col("_kids"), F.lit("<table>"))
        .when(kind == "Table", code)
        .otherwise(F.when(nest, F.concat(plain, F.lit("\n" + CHILDREN_OPEN))).otherwise(plain))
    )
    closing = F.when(in_list | in_table_cell | below, F.lit(None)).when(in_table_row, F.lit("</tr>")).when(~shown, F.lit(None)).when(kind == "List", F.concat(F.lit("</"), list_tag, F.lit(">"))).when((kind == "Table") & F.col("_kids"), F.lit("</table>")).when(nest, F.lit("</div>"))
    events = F.array(F.struct(F.col("path").alias("key"), opening.alias("piece")), F.struct(F.concat("path", F.array(F.lit(LAST))).alias("key"), closing.alias("piece")))
    made = F.filter(events, lambda e: e["piece"].isNotNull())
    return b.select("doc_id", "page_number", F.explode_outer(made).alias("e")).select("doc_id", "page_number", "e.*")


def export_html(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """doc_id and the whole page as one text; titles (doc_id, title)."""
    piece = F.when(F.col("piece").isNotNull(), F.struct("key", "piece"))
    body = html_pieces(blocks).groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(piece)), lambda x: x["piece"]), "\n").alias("inner"))
    inner = F.when(F.col("inner") == "", F.lit("")).otherwise(F.concat(F.col("inner"), F.lit("\n")))
    page = F.concat(F.lit("<div class='page' id='page-"), F.col("page_number").cast("string"), F.lit("'>\n"), inner, F.lit("</div>"))
    docs = body.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", page.alias("h")))), lambda x: x["h"]), "\n" + PAGE_BREAK + "\n").alias("pages"))
    title = escaped(F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise("Document"))
    top = F.concat(F.lit("<!DOCTYPE html>\n<html>\n<head>\n  <title>"), title, F.lit("</title>\n" + HEAD_STYLE + "\n</head>\n<body>\n"))
    return titles.join(docs, "doc_id").select("doc_id", F.concat(top, F.col("pages"), F.lit("\n</body>\n</html>")).alias("html"))


def overlay_plan(blocks: DataFrame) -> DataFrame:
    """Instructions to overwrite a page: a white box and an 11 pt text for every block with a box and content; 0-based pages."""
    return blocks.filter((F.size("bbox") == 4) & (F.coalesce("content", F.lit("")) != "")).select("doc_id", (F.col("page_number") - 1).alias("page_index"), "path", F.col("bbox").alias("rect"), F.col("content").alias("text"), F.lit("Helvetica").alias("font"), F.lit(11).alias("font_size"))


# Markup of the editor's parts, and what stands between the levels of a hierarchy.
BADGE = '<span class="block-badge" style="background: {colour}15; color: {colour}; border: 1px solid {colour}30;"><span class="block-badge-dot" style="background: {colour};"></span>{name}</span>'
CHIP = '<span class="property-chip">🏷 {key}: {value}</span>'
CARD = '<div class="metric-card"><div class="metric-value" style="color: {colour};">{value}</div><div class="metric-label">{label}</div></div>'
LEVELS = " → "
#: Characters of a block's preview beside a page image, and in a list without images.
PREVIEW, LONG_PREVIEW = 50, 120


def filled(template: str, **values: Column) -> Column:
    """A template with columns in place of its {names}."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def badge(block_type: Column) -> Column:
    return filled(BADGE, colour=lookup(block_type, COLORS, DEFAULT_COLOR), name=block_type)


def icon(block_type: Column) -> Column:
    return lookup(block_type, ICONS, DEFAULT_ICON)


def property_chips(properties: Column) -> Column:
    """properties: map of strings; image keys are hidden."""
    shown = F.map_filter(properties, lambda k, v: ~k.isin("has_images", "image_keys"))
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: filled(CHIP, key=e["key"], value=e["value"])), " ")


def metric_card(value: Column, label: str, color: str = "#A29BFE") -> Column:
    return filled(CARD, colour=F.lit(color), value=value.cast("string"), label=F.lit(label))


def hierarchy(levels: Column) -> Column:
    """The section hierarchy, a map of levels to titles, as one line; null without one."""
    return F.when(F.size(levels) > 0, F.array_join(F.map_values(levels), LEVELS))


def box_text(bbox: Column) -> Column:
    """The four sides of a box to one decimal; null without a box."""
    return F.when(F.size(bbox) > 0, F.array_join(F.transform(F.slice(bbox, 1, 4), lambda v: F.bround(v, 1).cast("string")), ", "))


def field_height(content: Column) -> Column:
    """Height of an editor field: null for a one-line field."""
    n = F.length(content)
    return F.when(n > 100, F.least(F.lit(200), F.greatest(F.lit(80), F.floor(n / 2)))).cast("int")
