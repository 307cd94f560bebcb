"""DOCX files with the standard library: read body elements, write paragraphs and trees."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.staging import bounded_batches

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


_UNFIT = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")


def _xml(text: str) -> str:
    """Escaped, without characters that XML cannot hold."""
    return escape(_UNFIT.sub("", text), {"\r": "&#13;"})


def paragraph(text: str, style: str = "", font: str = "", size: float | None = None, bold: bool = False, italic: bool = False, color: str = "", center: bool = False) -> str:
    ppr = (f'<w:pStyle w:val="{_xml(style)}"/>' if style else "") + ('<w:jc w:val="center"/>' if center else "")
    rpr = (f'<w:rFonts w:ascii="{_xml(font)}"/>' if font else "") + ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f'<w:color w:val="{color.lstrip("#")}"/>' if color else "") + (f'<w:sz w:val="{int(size * 2)}"/>' if size else "")
    return f'<w:p><w:pPr>{ppr}</w:pPr><w:r><w:rPr>{rpr}</w:rPr><w:t xml:space="preserve">{_xml(text)}</w:t></w:r></w:p>'


def table(rows: list[list[str]]) -> str:
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


PAGE_BREAK = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'


def pack(body: str, width: float = 612.0, height: float = 792.0) -> bytes:
    """A DOCX file of a body; page size in points."""
    out = io.BytesIO()
    sect = f'<w:sectPr><w:pgSz w:w="{int(width * 20)}" w:h="{int(height * 20)}"/></w:sectPr>'
    doc = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{W[1:-1]}"><w:body>{body}{sect}</w:body></w:document>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", doc)):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def _runs(p: ElementTree.Element) -> list[ElementTree.Element]:
    """Runs of a paragraph in order, those inside hyperlinks too."""
    out = []
    for x in p:
        if x.tag == f"{W}r":
            out.append(x)
        elif x.tag == f"{W}hyperlink":
            out += x.findall(f"{W}r")
    return out


def _on(rpr: ElementTree.Element | None, tag: str) -> bool:
    x = None if rpr is None else rpr.find(W + tag)
    return x is not None and x.get(f"{W}val", "true") not in ("0", "false", "off")


def elements(content: bytes) -> Iterator[dict]:
    """The body's paragraphs and tables in order, with the first run's attributes."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    size = body.find(f"{W}sectPr/{W}pgSz")
    page = (612.0, 792.0) if size is None else (int(size.get(f"{W}w", 12240)) / 20, int(size.get(f"{W}h", 15840)) / 20)
    i = 0
    for x in body:
        base = {"elem_idx": i, "style_name": "", "text": "", "font_name": "Calibri", "font_size": 11.0, "bold": False, "italic": False, "color": "#000000", "n_rows": 0, "n_cols": 0, "cells": [], "page_w": page[0], "page_h": page[1]}
        if x.tag == f"{W}p":
            runs = _runs(x)
            base["text"] = "".join(t.text or "" for r in runs for t in r.findall(f"{W}t"))
            style = x.find(f"{W}pPr/{W}pStyle")
            base["style_name"] = "" if style is None else style.get(f"{W}val", "")
            rpr = runs[0].find(f"{W}rPr") if runs else None
            if rpr is not None:
                font, sz, color = rpr.find(f"{W}rFonts"), rpr.find(f"{W}sz"), rpr.find(f"{W}color")
                base["font_name"] = (font.get(f"{W}ascii") if font is not None else None) or "Calibri"
                base["font_size"] = float(sz.get(f"{W}val")) / 2 if sz is not None else 11.0
                base["color"] = "#" + color.get(f"{W}val") if color is not None else "#000000"
            base |= {"kind": "p", "bold": _on(rpr, "b"), "italic": _on(rpr, "i")}
        elif x.tag == f"{W}tbl":
            rows = [["".join(t.text or "" for t in c.iter(f"{W}t")).strip() for c in r.findall(f"{W}tc")] for r in x.findall(f"{W}tr")]
            base |= {"kind": "tbl", "n_rows": len(rows), "n_cols": max(map(len, rows), default=0), "cells": rows}
        else:
            continue
        yield base
        i += 1


ELEMENTS = "doc_id long, elem_idx int, kind string, style_name string, text string, font_name string, font_size double, bold boolean, italic boolean, color string, n_rows int, n_cols int, cells array<array<string>>, page_w double, page_h double"
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
_ELEMENTS = pa.schema([(n, _ARROW[t]) for n, t in (c.split() for c in ELEMENTS.split(", "))])
#: Elements, and bytes of files, that go to Spark together.
ROWS = 4096
CONTENT_BYTES = 4 << 20


def read_paragraphs(files: DataFrame) -> DataFrame:
    """files (doc_id, content) to body elements; a file that is no DOCX gives one row of kind error."""
    bounded_batches(files.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[dict] = []
            for doc_id, content in zip(*(batch.column(n) for n in ("doc_id", "content"))):
                of = {"doc_id": doc_id.as_py()}
                try:
                    found += [e | of for e in list(elements(content.as_py()))]
                except Exception as e:  # noqa: BLE001  any damage of the file
                    found.append(of | {"kind": "error", "text": str(e)})
                if len(found) >= ROWS:
                    yield pa.RecordBatch.from_pylist(found, _ELEMENTS)
                    found = []
            if found:
                yield pa.RecordBatch.from_pylist(found, _ELEMENTS)

    return files.select("doc_id", "content").mapInArrow(rows, ELEMENTS)


def as_html(elements: DataFrame) -> DataFrame:
    """Body elements to one HTML text per document: doc_id, html. Headings by style, runs of list paragraphs as lists."""
    order = Window.partitionBy("doc_id").orderBy("elem_idx")
    style = F.lower(F.coalesce("style_name", F.lit("")))
    level = F.regexp_extract(style, r"heading\s*([1-6])", 1)
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td><p>"), safe(c), F.lit("</p></td>"))), ""), F.lit("</tr>"))
    grid = F.concat(F.lit("<table>"), F.array_join(F.transform("cells", row), ""), F.lit("</table>"))
    inner = safe(F.col("text"))
    inner = F.when(F.col("italic"), F.concat(F.lit("<em>"), inner, F.lit("</em>"))).otherwise(inner)
    inner = F.when(F.col("bold"), F.concat(F.lit("<strong>"), inner, F.lit("</strong>"))).otherwise(inner)
    tag = F.when(level != "", F.concat(F.lit("h"), level)).when(F.contains(style, F.lit("title")), "h1").when(F.contains(style, F.lit("list")), "li").otherwise("p")
    e = elements.filter((F.col("kind") == "tbl") | (F.trim("text") != "")).withColumn("_tag", F.when(F.col("kind") == "tbl", "table").otherwise(tag))
    e = e.withColumns({"_before": F.lag("_tag").over(order), "_after": F.lead("_tag").over(order)})
    at_edge = lambda c, mark: F.when((F.col("_tag") == "li") & ~c.eqNullSafe("li"), mark).otherwise("")
    one = F.when(F.col("_tag") == "table", grid).otherwise(F.concat(at_edge(F.col("_before"), "<ul>"), F.lit("<"), "_tag", F.lit(">"), inner, F.lit("</"), "_tag", F.lit(">"), at_edge(F.col("_after"), "</ul>")))
    parts = F.sort_array(F.collect_list(F.struct("elem_idx", one.alias("html"))))
    return e.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["html"]), "").alias("html"))


_FILES = pa.schema([("doc_id", pa.int64()), ("content", pa.binary())])


def _files(bodies: Iterable[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    """doc_id and body to files in batches bounded by CONTENT_BYTES."""
    held, size = [], 0
    for doc_id, body in bodies:
        held.append((doc_id, pack(body)))
        size += len(held[-1][1])
        if size > CONTENT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _FILES.types)], schema=_FILES)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _FILES.types)], schema=_FILES)


def _packed(bodies: DataFrame) -> DataFrame:
    """doc_id and body to files (doc_id, content). One file of each row; what is written is bounded by CONTENT_BYTES."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _files((doc_id.as_py(), body.as_py() or "") for doc_id, body in zip(*(batch.column(n) for n in ("doc_id", "body"))))

    return bodies.select("doc_id", "body").mapInArrow(rows, "doc_id long, content binary")


def _xml_column(text: Column) -> Column:
    """_xml of a column."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\ufffe\\uffff]", "")
    for raw, safe in (("&", "&amp;"), (">", "&gt;"), ("<", "&lt;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def _paragraph_column(text: Column, style: Column, font: Column, size: Column, bold: Column, italic: Column) -> Column:
    """paragraph of columns; nulls are as absent."""
    some = lambda c, before, after: F.when(F.length(c) > 0, F.concat(F.lit(before), _xml_column(c), F.lit(after))).otherwise("")
    on = lambda c, mark: F.when(c, mark).otherwise("")
    points = F.when(F.coalesce(size, F.lit(0.0)) != 0, F.concat(F.lit('<w:sz w:val="'), (size * 2).cast("long").cast("string"), F.lit('"/>'))).otherwise("")
    return F.concat(F.lit("<w:p><w:pPr>"), some(style, '<w:pStyle w:val="', '"/>'), F.lit("</w:pPr><w:r><w:rPr>"), some(font, '<w:rFonts w:ascii="', '"/>'), on(bold, "<w:b/>"), on(italic, "<w:i/>"), points, F.lit('</w:rPr><w:t xml:space="preserve">'), _xml_column(text), F.lit("</w:t></w:r></w:p>"))


def _table_column(cells: Column) -> Column:
    """table of a column of rows of texts."""
    bare = paragraph("")
    start, end = (f"<w:tc>{bare}</w:tc>".split("</w:t></w:r>")[0], "</w:t></w:r></w:p></w:tc>")
    row = lambda r: F.concat(F.lit("<w:tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit(start), _xml_column(c), F.lit(end))), ""), F.lit("</w:tr>"))
    return F.concat(F.lit("<w:tbl>"), F.array_join(F.transform(cells, row), ""), F.lit("</w:tbl>"))


def write_paragraphs(paras: DataFrame) -> DataFrame:
    """paras, as read_paragraphs gives them, to files (doc_id, content). Tables without cells have rows of one empty cell.

    The XML of each element is an expression; a document's elements are put together by Spark, and Python only packs them.
    """
    if "cells" not in paras.columns:
        paras = paras.withColumn("cells", F.lit(None).cast("array<array<string>>"))
    empty = F.array_repeat(F.array(F.lit("")), F.coalesce(F.col("n_rows"), F.lit(0)).cast("int"))
    one = F.when(F.col("kind") == "tbl", _table_column(F.coalesce("cells", empty))).otherwise(_paragraph_column(*[F.col(c) for c in ("text", "style_name", "font_name", "font_size", "bold", "italic")]))
    parts = F.sort_array(F.collect_list(F.struct("elem_idx", one.alias("xml"))))
    return _packed(paras.groupBy("doc_id").agg(F.array_join(parts["xml"], "").alias("body")))


class _Block(NamedTuple):
    """A block row as it is written."""

    page_number: int
    path: list[int]
    block_type: str | None
    content: str | None
    list_type: str | None
    heading_level: int | None
    blockquote: bool | None


def _tree_body(rows: list[_Block]) -> str:
    """A document's block rows in depth-first order as a body. Lists and tables write their children themselves."""
    kids: dict[tuple, list] = {}
    for r in rows:
        kids.setdefault((r.page_number, *r.path[:-1]), []).append(r)
    out: list[str] = []

    def write(r) -> None:
        below = kids.get((r.page_number, *r.path), [])
        text = r.content or ""
        if not text and not below:
            return
        kind = r.block_type
        if kind == "List":
            style = "ListNumber" if r.list_type == "ordered" else "ListBullet"
            out.extend(([paragraph(text)] if text else []) + [paragraph(c.content or "", style) for c in below])
            return
        if kind == "Table" and below:
            grid = [[c.content or "" for c in kids.get((r.page_number, *row.path), [])] for row in below]
            cols = len(grid[0]) or 1
            out.append(table([(g + [""] * cols)[:cols] for g in grid]))
            return
        if kind == "SectionHeader":
            given = r.heading_level or 1
            out.append(paragraph(text, f"Heading{min(9, max(1, given))}"))
        elif kind == "Equation":
            out.append(paragraph(f"[Equation] {text}", center=True))
        elif kind in ("Code", "Table"):
            out.append(paragraph(text, "MacroText"))
        else:
            out.append(paragraph(text, "Quote" if kind == "Text" and r.blockquote else ""))
        for c in below:
            write(c)

    pages = sorted({r.page_number for r in rows})
    for p in pages:
        for r in kids.get((p,), []):
            write(r)
        if p != pages[-1]:
            out.append(PAGE_BREAK)
    return "".join(out)


def export(blocks: DataFrame) -> DataFrame:
    """Block trees to files (doc_id, content). Spark gathers and orders a document's rows; Python writes them."""
    return export_gathered(blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*_Block._fields))).alias("rows")))


def export_gathered(docs: DataFrame) -> DataFrame:
    """export of docs (doc_id, rows) whose block rows are an array in depth-first order already."""
    bounded_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
        rows = batch.column("rows")
        ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy()).tolist()
        flat = rows.flatten()
        for doc_id, start, end in zip(batch.column("doc_id").to_pylist(), [0, *ends], ends):
            # A document at a time, column by column.
            own = flat.slice(start, end - start)
            yield doc_id, _tree_body(list(map(_Block, *(own.field(n).to_pylist() for n in _Block._fields))))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _files(of(batch))

    return docs.select("doc_id", "rows").mapInArrow(files, "doc_id long, content binary")
