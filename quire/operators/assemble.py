"""Styles, spans, tokens, tables, reading order and the assembled document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import cell_box, html_of, html_tag, normalized_box, safe_align, safe_weight, strip, style_id, style_of
from quire.operators.semantics import parsed_features, parsed_rhetoric
from quire.schema import SCHEMA_VERSION

# Fixed value: the text of a table's block.
TABLE_TEXT = "[TABLE]"


def with_style(blocks: DataFrame) -> DataFrame:
    s = style_of(F.col("fontname"), F.col("size"), F.col("color"))
    return blocks.withColumn("_style", s).withColumn("style_id", style_id(F.col("_style")))


def styles(blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Different styles of all blocks, or of each group."""
    keys = [*(by or []), "style_id"]
    return with_style(blocks).groupBy(*keys).agg(F.first("_style").alias("s")).select(*keys, "s.*")


def boxed(blocks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """blocks with bbox and bbox_norm; pages (doc_id, page_number, width, height), none if blocks have width and height."""
    b = blocks if pages is None else blocks.join(pages, ["doc_id", "page_number"])
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return b.withColumn("bbox", F.array(*box)).withColumn("bbox_norm", normalized_box(box, F.col("width"), F.col("height")))


def spans(blocks: DataFrame) -> DataFrame:
    """One span per block."""
    return blocks.select("doc_id", F.concat(F.lit("s-"), "id").alias("id"), F.col("id").alias("block_id"), "text", "bbox", "bbox_norm", "style_id")


def _tokens_of(words: Column, block_id: Column, width: Column, height: Column) -> Column:
    def token(w: Column) -> Column:
        box = tuple(w[c] for c in ("x0", "y0", "x1", "y1"))
        return F.struct(w["text"].alias("text"), F.array(*box).alias("bbox"), normalized_box(box, width, height).alias("bbox_norm"), block_id.alias("block_id"), F.concat(F.lit("s-"), block_id).alias("span_id"))

    return F.transform(words, token)


def with_tokens(blocks: DataFrame) -> DataFrame:
    """blocks (boxed, with words) with tokens: their words with boxes and the keys of their block and span."""
    return blocks.withColumn("tokens", _tokens_of(F.col("words"), F.col("id"), F.col("width"), F.col("height")))


def tokens(blocks: DataFrame) -> DataFrame:
    """Rows of the tokens of blocks that have them."""
    return blocks.select("doc_id", "page_number", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "page_number", "pos", "t.*")


def styled(blocks: DataFrame, known: DataFrame) -> DataFrame:
    """blocks (doc_id, style_id) with the fields of their style, looked up in a table of styles (see styles, by doc_id)."""
    return blocks.join(known, [c for c in ("doc_id", "style_id") if c in known.columns], "left")


def emitted(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Text blocks and tables in document order: by page, text in reading order, then the page's tables.

    A table's reading order is the number of rows emitted before it; that of text is its own.
    """
    b = blocks.select("doc_id", "page_number", F.lit(0).alias("is_table"), F.coalesce("reading_order", F.lit(0)).alias("reading_order"), F.col("block_idx").alias("pos"), "id")
    t = tables.select("doc_id", "page_number", F.lit(1).alias("is_table"), F.lit(0).alias("reading_order"), F.col("table_idx").alias("pos"), "id")
    order = Window.partitionBy("doc_id").orderBy("page_number", "is_table", "reading_order", "pos")
    both = b.unionByName(t).withColumn("emit_idx", F.row_number().over(order) - 1)
    return both.withColumn("reading_order", F.when(F.col("is_table") == 1, F.col("emit_idx")).otherwise(F.col("reading_order")))


def reading_graph(rows: DataFrame) -> DataFrame:
    """A next edge between neighbours of the document order, across pages too."""
    before = F.lag("id").over(Window.partitionBy("doc_id").orderBy("emit_idx"))
    return rows.withColumn("from", before).filter(F.col("from").isNotNull()).select("doc_id", "from", F.col("id").alias("to"), F.lit("next").alias("relation"))


def rendered(blocks: DataFrame) -> DataFrame:
    """blocks with html and html_template."""
    t = html_tag(F.col("block_type"))
    return blocks.withColumn("html", html_of(F.col("block_type"), F.col("text"))).withColumn("html_template", F.concat(F.lit("<"), t, F.lit(">{{text}}</"), t, F.lit(">")))


def table_blocks(tables: DataFrame, pages: DataFrame | None) -> DataFrame:
    """tables (doc_id, page_number, table_idx, id, box, and cells: rows of texts, if known) as blocks, with the table itself.

    Cells share the table's box evenly; columns are those of the longest row.
    """
    t = boxed(tables if "cells" in tables.columns else tables.withColumn("cells", F.lit(None).cast("array<array<string>>")), pages)
    n_rows = F.when(F.col("cells").isNull(), 0).otherwise(F.size("cells"))
    n_cols = F.coalesce(F.array_max(F.transform("cells", F.size)), F.lit(0))
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))

    def cell(r, text, c):
        own = cell_box(box, n_rows, n_cols, r, c)
        share = normalized_box(tuple(F.get(own, F.lit(i)) for i in range(4)), F.col("width"), F.col("height"))
        return F.struct(r.alias("row"), c.alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), strip(F.coalesce(text, F.lit(""))).alias("text"), own.alias("bbox"), share.alias("bbox_norm"))

    cells = F.flatten(F.transform("cells", lambda row, r: F.transform(row, lambda text, c: cell(r, text, c))))
    whole = F.struct("id", F.col("page_number").alias("page"), n_rows.alias("rows"), n_cols.alias("cols"), "bbox", F.coalesce(cells, F.array()).alias("cells"))
    return t.select("doc_id", "page_number", "id", F.lit(1).alias("is_table"), F.lit(0).alias("reading_order"), F.col("table_idx").alias("block_idx"), F.lit("table").alias("block_type"), F.lit("table").alias("role"), F.lit(TABLE_TEXT).alias("text"), "width", "height", "bbox", "bbox_norm", whole.alias("table"))


#: What a document's rows are made of, as far as blocks have it, and what only stands in where a later form is missing.
_MOVED = ("id", "block_type", "role", "reading_order", "text", "bbox", "bbox_norm", "style_id", "_style", "html", "html_template", "rhetoric", "rhetoric_features", "words", "tokens", "table")
_INSTEAD = {"bbox": ("x0", "y0", "x1", "y1"), "style_id": ("fontname", "size", "color")}


def document_json(pages: DataFrame | None, blocks: DataFrame, edges: DataFrame | None, source: str, pretty: bool = False, tables: DataFrame | None = None) -> DataFrame:
    """doc_id and the document as JSON: pages, blocks, styles, spans, tokens (if blocks have them, or words to make them of), tables, reading graph; empty parts are left out.

    Tables (see table_blocks) are blocks too, after the text of their page; their reading order is their place.
    Without pages, those of the blocks and tables count, which then have width and height. Without edges, neighbours of
    the document order are joined. Blocks need no boxes (see boxed), styles (with_style) and markup (rendered): what they
    lack is made where the document is, so that it is not moved; with neither pages nor edges that is one exchange at
    most, and none if blocks are dealt by document already.
    """
    rows = blocks.withColumn("is_table", F.lit(0))
    if tables is not None:
        rows = rows.unionByName(table_blocks(tables, pages), allowMissingColumns=True)
    has = set(blocks.columns)
    moved = [c for c in _MOVED if c in rows.columns] + [c for late, early in _INSTEAD.items() if late not in has for c in early]
    if pages is None or "bbox_norm" not in has or "words" in has:
        moved += ["width", "height"]
    kept = F.struct("page_number", "is_table", F.coalesce("reading_order", F.lit(0)).alias("order"), "block_idx", *moved)
    j = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(kept)).alias("rows"))
    return as_json(_assembled(j, has, moved, pages, edges, source, tables is not None), pretty)


def gathered(docs: DataFrame, source: str) -> DataFrame:
    """document_json of docs (doc_id, rows) whose blocks, which have width and height, are an array in the document's order already: nothing is moved. As doc, which to_json makes text."""
    fields = docs.schema["rows"].dataType.elementType.names
    return _assembled(docs, set(fields), fields, None, None, source, False)


def as_json(docs: DataFrame, pretty: bool = False) -> DataFrame:
    return docs.select("doc_id", F.to_json("doc", {"pretty": "true"} if pretty else {}).alias("json"))


def _assembled(j: DataFrame, has: set[str], moved: list[str], pages: DataFrame | None, edges: DataFrame | None, source: str, with_tables: bool) -> DataFrame:
    """Documents (doc_id, rows) to doc. has: what blocks have; moved: what rows hold of blocks and tables."""

    def text_in(r: Column) -> Column:
        return (r["is_table"] == 0) if with_tables else F.lit(True)

    def made(r: Column) -> Column:
        is_text, old = text_in(r), lambda c: [r[c]] if c in moved else []
        box = tuple(r[c] for c in _INSTEAD["bbox"]) if "bbox" not in has else ()
        style = r["_style"] if "_style" in has else style_of(r["fontname"], r["size"], r["color"])
        tag = html_tag(r["block_type"])
        return F.struct(
            F.coalesce(*old("bbox"), *([F.array(*box)] if box else [])).alias("bbox"),
            F.coalesce(*old("bbox_norm"), *([normalized_box(box, r["width"], r["height"])] if "bbox_norm" not in has else [])).alias("bbox_norm"),
            F.when(is_text, r["style_id"] if "style_id" in has else style_id(style)).alias("style_id"),
            F.when(is_text, style.withField("weight", safe_weight(style["weight"])).withField("align", safe_align(style["align"]))).alias("style"),
            F.when(is_text, r["html"] if "html" in has else html_of(r["block_type"], r["text"])).alias("html"),
            F.when(is_text, r["html_template"] if "html_template" in has else F.concat(F.lit("<"), tag, F.lit(">{{text}}</"), tag, F.lit(">"))).alias("html_template"),
        )

    j = j.withColumn("made", F.transform("rows", made))
    page = lambda r: F.struct(r["page_number"].alias("page_number"), r["width"].alias("width"), r["height"].alias("height"), F.lit(0).alias("rotation"), F.lit("pt").alias("unit"))
    present = lambda a: F.filter(a, lambda x: x.isNotNull())
    some = lambda a: F.get(F.filter(F.array(a), lambda x: F.size(x) > 0), F.lit(0))  # noqa: E731  a is made once, and not copied
    of = lambda one: F.transform("rows", lambda r, i: one(r, F.get("made", i), i))
    if edges is None:
        edge = lambda r, m, i: F.when(i > 0, F.struct(F.get("rows", i - 1)["id"].alias("from"), r["id"].alias("to"), F.lit("next").alias("relation")))
        j = j.withColumn("reading_graph", some(F.sort_array(present(of(edge)))))
    else:
        j = j.join(edges.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("from", "to", "relation"))).alias("reading_graph")), "doc_id", "left")
    if pages is None:
        first = lambda r, m, i: F.when((i == 0) | (F.get("rows", i - 1)["page_number"] != r["page_number"]), page(r))
        j = j.withColumn("pages", present(of(first)))
    else:
        p = pages.groupBy("doc_id").agg(F.sort_array(F.collect_list(page({c: F.col(c) for c in ("page_number", "width", "height")}))).alias("pages"))
        j = p.join(j, "doc_id", "left")
    parsed = [(c, read) for c, read in (("rhetoric", parsed_rhetoric), ("rhetoric_features", parsed_features)) if c in has]

    def block(r: Column, m: Column, i: Column) -> Column:
        optional = [F.when(r[c].isNotNull(), read(r[c])).alias(c) for c, read in parsed]
        order = F.when(text_in(r), r["reading_order"].cast("int")).otherwise(i)
        return F.struct(r["id"].alias("id"), r["block_type"].alias("type"), r["role"].alias("role"), r["page_number"].alias("page"), m["bbox"].alias("bbox"), m["bbox_norm"].alias("bbox_norm"), order.alias("reading_order"), F.lit(0).alias("z_index"), r["text"].alias("text"), m["style_id"].alias("style_id"), m["html"].alias("html"), m["html_template"].alias("html_template"), *optional)

    def span(r: Column, m: Column, i: Column) -> Column:
        return F.when(text_in(r), F.struct(F.concat(F.lit("s-"), r["id"]).alias("id"), r["id"].alias("block_id"), r["text"].alias("text"), m["bbox"].alias("bbox"), m["bbox_norm"].alias("bbox_norm"), m["style_id"].alias("style_id")))

    def tokens_in(r: Column, m: Column, i: Column) -> Column:
        return F.when(text_in(r), r["tokens"] if "tokens" in has else _tokens_of(r["words"], r["id"], r["width"], r["height"]))

    styles_in = lambda r, m, i: F.when(text_in(r), F.struct(m["style_id"].alias("style_id"), m["style"].alias("_style")))
    doc = F.struct(
        F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(source).alias("source"), F.size("pages").alias("page_count")).alias("document"),
        F.col("pages"),
        F.coalesce(of(block), F.array()).alias("blocks"),
        some(present(of(span))).alias("spans"),
        *([some(F.flatten(present(of(tokens_in)))).alias("tokens")] if has & {"tokens", "words"} else []),
        *([some(present(of(lambda r, m, i: r["table"]))).alias("tables")] if with_tables else []),
        F.map_from_entries(F.array_distinct(some(present(of(styles_in))))).alias("styles"),
        F.col("reading_graph"),
    )
    return j.select("doc_id", doc.alias("doc"))
