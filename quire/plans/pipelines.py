"""Whole conversions: positioned characters or DOCX files to document JSON, DOCX files to block trees, sinks, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.layout import title_from_name
from quire.functions.pages import clipped_pages
from quire.operators import assemble, docx_layout, geometry, semantics, tree
from quire.sources import docx, html, marker, scans
from quire.staging import written

# What the formats' extensions stand for.
READERS = {"pdf": (".pdf",), "docx": (".docx", ".doc"), "html": (".html", ".htm"), "image": (".png", ".jpg", ".jpeg", ".gif"), "json": (".json",), "other": (".pptx", ".xlsx", ".epub")}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def reader_of(path: Column) -> Column:
    """The reader of a file by its extension; quarantine for none."""
    ext, out = extension(path), F.lit("quarantine")
    for reader, known in READERS.items():
        out = F.when(ext.isin(*known), reader).otherwise(out)
    return out


def _any_case(text: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in text)


def glob_of(reader: str) -> str:
    """The file names of a reader, in any case."""
    return "*{" + ",".join(_any_case(x) for x in READERS[reader]) + "}"


def listed(spark: SparkSession, path: str) -> DataFrame:
    """path, reader and doc_id (a hash of the path) of every file under a path. No file is opened: the content is no column of the scan. Spark leaves out files of no bytes."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", reader_of(F.col("path")).alias("reader"), F.xxhash64("path").alias("doc_id"))


def files(spark: SparkSession, path: str, reader: str) -> DataFrame:
    """path, content, reader and doc_id of one reader's files. Others are left out by name when the files are listed, and never opened."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob_of(reader)).load(path)
    return f.select("path", "content", F.lit(reader).alias("reader"), F.xxhash64("path").alias("doc_id"))


def selected_pages(pages: DataFrame, page_range: str | None) -> DataFrame:
    """pages (doc_id, page_number, ...) of a range like 1,3-5. Selected before any geometry."""
    if not page_range:
        return pages
    counts = pages.groupBy("doc_id").agg(F.max("page_number").cast("int").alias("total"))
    wanted = counts.select("doc_id", F.explode(clipped_pages(F.lit(page_range), F.col("total"))).alias("page_number"))
    return pages.join(wanted, ["doc_id", "page_number"], "left_semi")


def layout_document(chars: DataFrame, pages: DataFrame, tables: DataFrame | None = None, tags: DataFrame | None = None, page_range: str | None = None, pretty: bool = False) -> DataFrame:
    """Characters to document JSON: doc_id, json.

    tables (doc_id, page_number, table_idx, id, x0, y0, x1, y1, and cells: rows of texts, if known) drop the blocks they
    cover and follow their page's text, as blocks and with their cells.
    Without tags, types come from the heuristics; with tags, by index, then by text, then as paragraphs.
    """
    chosen = selected_pages(pages, page_range)
    kept = chars.join(chosen.select("doc_id", "page_number"), ["doc_id", "page_number"], "left_semi")
    blocks = geometry.build_blocks(geometry.build_lines(geometry.build_words(geometry.filter_chars(kept)), with_words=True))
    if tables is not None:
        blocks = geometry.blocks_outside_tables(blocks, tables)
        place = Window.partitionBy("doc_id", "page_number").orderBy("block_idx")
        blocks = blocks.withColumn("block_idx", (F.row_number().over(place) - 1).cast("int"))
    blocks = semantics.heuristic(blocks) if tags is None else semantics.tagged(blocks, tags).drop("how")
    return _assembled(blocks, chosen, tables, "pdf", pretty)


def _assembled(blocks: DataFrame, pages: DataFrame, tables: DataFrame | None, source: str, pretty: bool) -> DataFrame:
    return assemble.document_json(pages, assemble.boxed(blocks, pages), None, source, pretty, tables)


def docx_document(elements: DataFrame, pretty: bool = False) -> DataFrame:
    """DOCX body elements, as sources.docx reads them, to document JSON. Page size is that of the document's section."""
    laid = docx_layout.lay_out(elements)
    rows = docx_layout.paginate(docx_layout.classified(laid))
    place = Window.partitionBy("doc_id", "page_number").orderBy("elem_idx")
    blocks = rows.withColumn("block_idx", (F.row_number().over(place) - 1).cast("int")).withColumn("size", F.col("font_size"))
    tables = docx_layout.paginate(laid.filter("kind = 'tbl'")).withColumn("table_idx", F.col("elem_idx")).withColumn("id", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit("table"), F.col("elem_idx").cast("string")), 256))
    sizes = elements.groupBy("doc_id").agg(F.first("page_w", True).alias("width"), F.first("page_h", True).alias("height"))
    pages = docx_layout.pages_of(laid, elements).join(sizes, "doc_id").withColumns({"width": F.coalesce("width", F.lit(612.0)), "height": F.coalesce("height", F.lit(792.0))})
    return _assembled(blocks, pages, tables, "docx", pretty)


_TREE_ROWS = "array<struct<path:array<int>,id:string,block_type:string,content:string,heading_level:int,list_type:string,row_count:int,column_count:int>>"


def docx_blocks(elements: DataFrame) -> DataFrame:
    """DOCX body elements to tree rows in pages of 35 top-level blocks: list paragraphs under a group, rows and cells under tables.

    Neighbouring list paragraphs of one kind (numbered or not) are one group; empty paragraphs are left out before that.
    Ids name the page of their top-level block; those of cells always name the first.
    """
    in_order = Window.partitionBy("doc_id").orderBy("elem_idx")
    spaced = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    style = F.lower(F.coalesce("style_name", F.lit("")))
    level = F.regexp_extract(style, r"heading\s*(\d)", 1).try_cast("int")
    listed_as = F.when((F.col("kind") == "p") & level.isNull() & F.contains(style, F.lit("list")), F.when(F.contains(style, F.lit("number")), "ordered").otherwise("unordered"))
    kind = F.when(F.col("kind") == "tbl", "Table").when(level.isNotNull(), "SectionHeader").when(F.col("list_type").isNotNull(), "ListGroup").when(F.contains(style, F.lit("code")), "Code").otherwise("Text")
    e = elements.filter((F.col("kind") == "tbl") | (F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != "")).withColumn("list_type", listed_as)
    e = e.withColumn("_goes_on", F.coalesce(F.col("list_type") == F.lag("list_type").over(in_order), F.lit(False)))
    e = e.withColumn("ordinal", (F.sum(F.when(F.col("_goes_on"), 0).otherwise(1)).over(in_order) - 1).cast("int"))
    e = e.withColumns({"block_type": kind, "heading_level": level, "page_number": F.floor(F.col("ordinal") / tree.PER_PAGE).cast("int") + 1, "pos": (F.row_number().over(Window.partitionBy("doc_id", "ordinal").orderBy("elem_idx")) - 1).cast("int")})
    number = lambda c: F.col(c).cast("string")
    ident = lambda of, *parts: F.concat(F.lit("page_"), (F.col("page_number") - 1).cast("string"), F.lit(f"/{of}/") if isinstance(of, str) else F.concat(F.lit("/"), of, F.lit("/")), *parts)
    none = F.lit(None)
    row = lambda path, own, block_type, content, heading=none, list_type=none, n_rows=none, n_cols=none: F.struct(
        path.cast("array<int>").alias("path"), own.alias("id"), block_type.alias("block_type"), content.alias("content"),
        heading.cast("int").alias("heading_level"), list_type.cast("string").alias("list_type"), n_rows.cast("int").alias("row_count"), n_cols.cast("int").alias("column_count"),
    )
    is_table = F.col("kind") == "tbl"
    all_cells = spaced(F.array_join(F.flatten("cells"), " "))
    content = F.when(is_table, all_cells).when(F.col("list_type").isNotNull(), "").otherwise(spaced(F.col("text")))
    first_row = F.coalesce(F.size(F.get("cells", F.lit(0))), F.lit(0))
    top = row(F.array("ordinal"), ident(F.col("block_type"), number("ordinal")), F.col("block_type"), content, F.col("heading_level"), F.col("list_type"), F.when(is_table, F.size("cells")), F.when(is_table, first_row))
    item = row(F.array("ordinal", "pos"), ident("ListItem", number("ordinal"), F.lit("_"), number("pos")), F.lit("ListItem"), spaced(F.col("text")))
    text_row = lambda r: row(F.array(F.col("ordinal"), r), ident("TableRow", number("ordinal"), F.lit("_r"), r.cast("string")), F.lit("Text"), F.lit(""))
    cell_id = lambda r, c: F.concat(F.lit("page_0/TableCell/"), number("ordinal"), F.lit("_r"), r.cast("string"), F.lit("_c"), c.cast("string"))
    cell = lambda r, c, text: row(F.array(F.col("ordinal"), r, c), cell_id(r, c), F.lit("Text"), spaced(text))
    grid = F.flatten(F.transform("cells", lambda cells, r: F.concat(F.array(text_row(r)), F.transform(cells, lambda text, c: cell(r, c, text)))))
    # An element gives all its rows at once: elements, which may come from files, are read and ordered once.
    at_top = F.when(F.col("pos") == 0, F.array(top)).otherwise(F.array().cast(_TREE_ROWS))
    below = F.when(is_table, F.coalesce(grid, F.array().cast(_TREE_ROWS))).when(F.col("list_type").isNotNull(), F.array(item)).otherwise(F.array().cast(_TREE_ROWS))
    return e.select("doc_id", "page_number", F.inline(F.concat(at_top, below)))


HTML_BLOCK = ("path", "id", "block_type", "content", "html", "heading_level", "list_type", "row_count", "column_count", "blockquote", "color", "bg_color", "font_family", "font_size")


def block_document(rows: DataFrame, source: str, order: list[str], kept: tuple[str, ...], pretty: bool = False) -> DataFrame:
    """Block rows to documents (doc_id, json) that list them in order."""
    blocks = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*kept).alias("b")))), lambda x: x["b"])
    head = F.struct(F.col("doc_id").cast("string").alias("document_id"), F.lit(source).alias("source"))
    docs = rows.groupBy("doc_id").agg(blocks.alias("blocks"))
    return docs.select("doc_id", F.to_json(F.struct(head.alias("document"), "blocks"), {"pretty": "true"} if pretty else {}).alias("json"))


def html_document(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """Block rows of HTML files, as sources.html reads them (doc_id for page_id), to documents."""
    return block_document(rows, "html", ["path"], HTML_BLOCK, pretty)


def called_blocks(f: DataFrame, extractor: scans.Extractor) -> DataFrame:
    """Block rows of image, HTML and DOCX files (doc_id, reader, content) by structured calls.

    An image is one page; HTML goes in chunks, which are the pages; DOCX goes as HTML.
    """
    images = f.filter("reader = 'image'").select("doc_id", F.lit(1).alias("page_number"), "reader", "content")
    shown = scans.page_images(images).select("doc_id", "page_number", scans.image_text(F.col("image")).alias("payload"))
    from_docx = docx.as_html(docx.read_paragraphs(f.filter("reader = 'docx'")).filter("kind <> 'error'"))
    texts = f.filter("reader = 'html'").select("doc_id", F.decode("content", "UTF-8").alias("html")).unionByName(from_docx)
    chunks = html.chunks(texts.withColumnRenamed("doc_id", "page_id"))
    pieces = chunks.select(F.col("page_id").alias("doc_id"), (F.col("chunk") + 1).cast("int").alias("page_number"), F.col("html").alias("payload"))
    return scans.extract(shown, extractor).unionByName(scans.extract(pieces, extractor, "html"))


def convert(spark: SparkSession, path: str, pretty: bool = False, parser: scans.Parser = scans.pdf.pages, extractor: scans.Extractor | None = None, page_range: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, json) of the PDF, DOCX, HTML and converter JSON files under a path, and the rest: path, reader, error.

    With an extractor, images are converted too. The rest are files without a reader here and broken ones, with what is
    wrong with them; a PDF file that breaks off gives its pages before, and its error.
    """
    every = listed(spark, path)
    # Each format is read once, into a table that all that needs it reads.
    read = written(scans.read_pages(files(spark, path, "pdf"), parser), "pages")
    elements = written(docx.read_paragraphs(files(spark, path, "docx")), "elements")
    pages = files(spark, path, "html").select(F.col("doc_id").alias("page_id"), F.decode("content", "UTF-8").alias("html"))
    web = html.baseline_blocks(pages, body_only=True).withColumnRenamed("page_id", "doc_id")
    trees = marker.blocks(files(spark, path, "json").select("doc_id", F.decode("content", "UTF-8").alias("json")))
    done = layout_document(scans.chars_of(read), scans.pages_of(read), scans.tables_of(read), page_range=page_range, pretty=pretty)
    done = done.unionByName(docx_document(elements.filter("kind <> 'error'"), pretty)).unionByName(html_document(web, pretty))
    done = done.unionByName(block_document(trees, "marker", ["page_number", "path"], ("page_number", "path", "id", "block_type", "content", "html", "bbox"), pretty))
    known = ["pdf", "docx", "html", "json"]
    if extractor is not None:
        known.append("image")
        called = called_blocks(files(spark, path, "image"), extractor)
        done = done.unionByName(block_document(called, "image", ["page_number", "pos"], ("page_number", "id", "block_type", "content"), pretty))
    broken = elements.filter("kind = 'error'").select("doc_id", F.col("text").alias("error")).unionByName(scans.errors_of(read))
    bad = every.join(broken, "doc_id").select("path", "reader", "error")
    return done, every.filter(~F.col("reader").isin(*known)).select("path", "reader", F.lit(None).cast("string").alias("error")).unionByName(bad)


def titles(f: DataFrame) -> DataFrame:
    """doc_id and title, from the file names."""
    return f.select("doc_id", title_from_name(F.col("path")).alias("title"))


def write_json(documents: DataFrame, path: str) -> None:
    """One document per line, or several lines if made with pretty."""
    documents.select("json").write.mode("overwrite").text(path)
