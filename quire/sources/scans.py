"""What a parser, renderer or model gives: positioned pages of files, page images, blocks by structured calls.

The foreign code is a function that every worker can import; what it builds once (a model, a client) comes from made().
An error of a file, page or call becomes a row, never a lost job; a retried task calls again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quire.functions.layout import color_hex, stable_id
from quire.sources import pdf
from quire.staging import BATCH_BYTES, bounded_batches
from quire.streaming.progress import Progress

BOX = "x0 double, y0 double, x1 double, y1 double"
PAGES = f"doc_id long, page_number int, width double, height double, chars array<struct<text string, {BOX}, fontname string, size double, color array<double>>>, tables array<struct<{BOX}, cells array<array<string>>>>, error string"
_BOX = [pa.field(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")]
_CHAR = pa.struct([pa.field("text", pa.string()), *_BOX, pa.field("fontname", pa.string()), pa.field("size", pa.float64()), pa.field("color", pa.list_(pa.float64()))])
_TABLE = pa.struct([*_BOX, pa.field("cells", pa.list_(pa.list_(pa.string())))])
_PAGES = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("chars", pa.list_(_CHAR)), ("tables", pa.list_(_TABLE)), ("error", pa.string())])

Parser = Callable[[bytes], Iterable[dict]]
#: Characters of pages that go to Spark together.
CHARS = 50_000
#: Structured calls that a worker has open at a time.
CALLS = 15


@lru_cache(maxsize=8)
def made(make: Callable, *options):
    """make(*options), once per worker and options; the eight last used are kept."""
    return make(*options)


def _chars(found: Iterable[dict] | pdf.Chars) -> pa.StructArray:
    """Characters of a page as Arrow has them; those of the own parser go over column by column."""
    if not isinstance(found, pdf.Chars):
        return pa.array(list(found), _CHAR)
    run = np.repeat(np.arange(len(found.runs)), found.lengths())
    _, y0, y1, names, sizes, colors = zip(*found.runs) if found.runs else [()] * 6
    shared = lambda values, of: pa.array(values, of).take(pa.array(run))
    columns = [pa.array(found.texts, pa.string()), pa.array(found.x0, pa.float64()), shared(y0, pa.float64()), pa.array(found.x1, pa.float64()), shared(y1, pa.float64()), shared(names, pa.string()), shared(sizes, pa.float64()), shared(colors, pa.list_(pa.float64()))]
    return pa.StructArray.from_arrays(columns, fields=list(_CHAR))


def _page_batch(held: list[dict]) -> pa.RecordBatch:
    """Pages, with chars as Arrow arrays; those with an error have none."""
    chars = [p.get("chars") for p in held]
    ends = np.cumsum([0, *(0 if c is None else len(c) for c in chars)]).astype(np.int32)
    values = pa.concat_arrays([pa.array([], _CHAR), *(c for c in chars if c is not None)])
    lists = pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(_CHAR), mask=pa.array([c is None for c in chars]))
    return pa.RecordBatch.from_arrays([lists if f.name == "chars" else pa.array([p.get(f.name) for p in held], f.type) for f in _PAGES], schema=_PAGES)


def read_pages(files: DataFrame, parser: Parser = pdf.pages) -> DataFrame:
    """files (doc_id, content) to a row per page. A file that breaks keeps the pages before, and adds a row with the error."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, content in zip(*(batch.column(n) for n in ("doc_id", "content"))):
                try:
                    for page in parser(content.as_py() or b""):
                        held.append(page | {"doc_id": doc_id.as_py(), "chars": _chars(page["chars"])})
                        size += len(page["chars"])
                        if size > CHARS:
                            yield _page_batch(held)
                            held, size = [], 0
                except Exception as e:  # noqa: BLE001  any damage of the file
                    held.append({"doc_id": doc_id.as_py(), "error": f"{type(e).__name__}: {e}"})
            if held:
                yield _page_batch(held)

    bounded_batches(files.sparkSession)
    return files.select("doc_id", "content").mapInArrow(rows, PAGES)


EXTENTS = f"doc_id long, page_number int, width double, height double, n_chars int, text string, {BOX}, error string"
_EXTENTS = pa.schema([("doc_id", pa.int64()), ("page_number", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("n_chars", pa.int32()), ("text", pa.string()), *_BOX, ("error", pa.string())])


def _extent(found: Iterable[dict] | pdf.Chars) -> dict:
    """Number, text in the order in which it is shown, and box of a page's characters; no box without any."""
    if isinstance(found, pdf.Chars):
        texts, x0, x1 = found.texts, found.x0, found.x1
        y0, y1 = [r[1] for r in found.runs], [r[2] for r in found.runs]
    else:
        found = list(found)
        texts, x0, y0, x1, y1 = ([c[n] for c in found] for n in ("text", "x0", "y0", "x1", "y1"))
    box = {n: f(v) for n, f, v in (("x0", min, x0), ("y0", min, y0), ("x1", max, x1), ("y1", max, y1))} if texts else {}
    return {"n_chars": len(texts), "text": "".join(texts)} | box


def page_extents(files: DataFrame, parser: Parser = pdf.pages) -> DataFrame:
    """read_pages with the number, text and box of each page's characters in place of a struct for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc_id, content in zip(*(batch.column(n) for n in ("doc_id", "content"))):
                of = {"doc_id": doc_id.as_py()}
                try:
                    for page in parser(content.as_py() or b""):
                        held.append({n: page[n] for n in ("page_number", "width", "height")} | of | _extent(page["chars"]))
                        size += held[-1]["n_chars"]
                        if size > BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(held, _EXTENTS)
                            held, size = [], 0
                except Exception as e:  # noqa: BLE001  any damage of the file
                    held.append(of | {"error": f"{type(e).__name__}: {e}"})
            if held:
                yield pa.RecordBatch.from_pylist(held, _EXTENTS)

    bounded_batches(files.sparkSession)
    return files.select("doc_id", "content").mapInArrow(rows, EXTENTS)


def pages_of(read: DataFrame) -> DataFrame:
    return read.filter("error IS NULL").select("doc_id", "page_number", "width", "height")


def chars_of(read: DataFrame) -> DataFrame:
    """The characters, as operators.geometry takes them."""
    each = read.select("doc_id", "page_number", F.posexplode("chars").alias("char_idx", "c"))
    return each.select("doc_id", "page_number", "char_idx", "c.text", "c.x0", "c.y0", "c.x1", "c.y1", "c.fontname", "c.size", color_hex(F.col("c.color")).alias("color"))


def tables_of(read: DataFrame) -> DataFrame:
    """The tables with their cells; one without rows is none."""
    each = read.select("doc_id", "page_number", F.posexplode("tables").alias("table_idx", "t")).filter(F.size("t.cells") > 0)
    return each.select("doc_id", "page_number", "table_idx", stable_id(F.col("doc_id"), F.col("page_number"), F.lit("table"), F.col("table_idx")).alias("id"), "t.*")


def errors_of(read: DataFrame) -> DataFrame:
    return read.filter("error IS NOT NULL").select("doc_id", "error")


def write_pages(rows: DataFrame, font: str = "Courier") -> DataFrame:
    """rows (doc_id, page_number, x, y, text, size; y is the baseline from the top) to PDF files (doc_id, content).

    One group is one document; pages without rows are left out.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for rows in batch.column("rows"):
                sheets = [[(r["x"], r["y"], r["text"], r["size"]) for r in page] for _, page in groupby(rows.as_py(), lambda r: r["page_number"])]
                files.append(pdf.pack(sheets, font))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(files, pa.binary())], ["doc_id", "content"])

    bounded_batches(rows.sparkSession)
    docs = rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "y", "x", "text", "size"))).alias("rows"))
    return docs.mapInArrow(packed, "doc_id long, content binary")


Renderer = Callable[[bytes, int, int], bytes]


def page_images(units: DataFrame, render: Renderer | None = None, dpi: int = 200) -> DataFrame:
    """units (doc_id, page_number, reader, content) with image: an image file is its own page, others are rendered (file, page, dpi).

    A page that cannot be rendered has a null image and the error.
    """

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for unit in it:
            found = []
            for doc_id, page, content in zip(unit["doc_id"], unit["page_number"], unit["content"]):
                image, error = None, None
                try:
                    if render is None:
                        raise ValueError("no renderer")
                    image = render(bytes(content), int(page), dpi)
                except Exception as e:  # noqa: BLE001  foreign code
                    error = str(e)
                found.append((doc_id, page, image, error))
            yield pd.DataFrame(found, columns=["doc_id", "page_number", "image", "error"])

    is_image = F.coalesce(F.col("reader") == "image", F.lit(False))
    own = units.filter(is_image).select("doc_id", "page_number", F.col("content").alias("image"), F.lit(None).cast("string").alias("error"))
    others = units.filter(~is_image).select("doc_id", "page_number", "content")
    return own.unionByName(others.mapInPandas(rows, "doc_id long, page_number int, image binary, error string"))


def image_text(image: Column) -> Column:
    """An image as models take it: base64 in one line."""
    return F.replace(F.base64(image), F.lit("\r\n"), F.lit(""))


# The block that stands for a page or chunk whose call failed.
FAILED = {"page": "API Extraction failed for this page: ", "html": "API Extraction failed for HTML: "}
BLOCKS = "doc_id long, page_number int, pos int, id string, block_type string, content string"
Extractor = Callable[[str, int], list[dict]]


def engine(*choices: tuple[str, Extractor | None]) -> tuple[str, Extractor]:
    """The first engine that is set up, by precedence."""
    for name, extractor in choices:
        if extractor is not None:
            return name, extractor
    raise ValueError("none of " + ", ".join(n for n, _ in choices) + " is set up")


def extract(units: DataFrame, extractor: Extractor, kind: str = "page", progress: Progress | None = None) -> DataFrame:
    """units (doc_id, page_number, payload) to block rows by one call each, CALLS at a time in a worker.

    The extractor gets payload and page number and gives blocks (id, block_type, content); the page number stays the
    unit's. A failed call gives one block of type Error with the message. progress counts pages done and failed.
    """
    done, failed = (progress.done, progress.failed) if progress else (None, None)

    def call(unit: tuple) -> list[tuple]:
        doc_id, page, payload = unit
        try:
            return [(doc_id, page, i, b["id"], b["block_type"], b.get("content", "")) for i, b in enumerate(extractor(payload, int(page)))]
        except Exception as e:  # noqa: BLE001  foreign code
            return [(doc_id, page, 0, f"page_{page - 1}/Error/0", "Error", FAILED[kind] + str(e))]

    def rows(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(CALLS) as pool:
            for pdf_ in it:
                found = list(pool.map(call, zip(pdf_["doc_id"], pdf_["page_number"], pdf_["payload"])))
                if done is not None:
                    done.add(len(found))
                    failed.add(sum(len(rs) == 1 and rs[0][4] == "Error" for rs in found))
                yield pd.DataFrame([r for rs in found for r in rs], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return units.select("doc_id", "page_number", "payload").mapInPandas(rows, BLOCKS)


def watched(blocks: DataFrame) -> tuple[DataFrame, Observation]:
    """blocks, and what an action on them saw: pages done, and pages that failed. For progress reports."""
    seen = Observation()
    first, failed = F.col("pos") == 0, F.col("block_type") == "Error"
    return blocks.observe(seen, F.count_if(first).alias("pages"), F.count_if(first & failed).alias("failed")), seen
