"""Word-processor paragraphs to boxes: vertical cursor, wrapped words, pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import classify_paragraph, stable_id, strip

# Fixed values of the layout rule, in points.
TOP, LEFT, BLANK, ROW, AFTER_TABLE = 36.0, 72.0, 6.0, 20.0, 12.0
LINE, CHAR, HALF, AFTER = 1.4, 0.6, 0.5, 0.4
WORD, GAP = 0.55, 0.3
#: Sums are kept as decimals, so that their order does not matter.
EXACT = "decimal(24,8)"


def _height(text: Column, size: Column, width: float) -> Column:
    """Height of a paragraph; the number of lines is a fraction."""
    return size * LINE * F.greatest(F.lit(1.0), F.length(text) * size * CHAR / width + HALF)


def lay_out(paras: DataFrame, page_w: float = 612.0) -> DataFrame:
    """paras (doc_id, elem_idx, kind, text, ...) with x0, y0, x1, y1 on one tall page. Blank ones only move the cursor."""
    width = page_w - 2 * LEFT
    text = strip(F.coalesce("text", F.lit("")))
    size = F.coalesce("font_size", F.lit(11.0))
    height = F.when(F.col("kind") == "tbl", F.col("n_rows") * ROW).when(F.length(text) == 0, 0.0).otherwise(_height(text, size, width))
    after = F.when(F.col("kind") == "tbl", F.when(F.col("n_rows") > 0, AFTER_TABLE).otherwise(0.0)).when(F.length(text) == 0, BLANK).otherwise(size * AFTER)
    p = paras.withColumn("text", text).withColumn("_h", height.cast(EXACT)).withColumn("_adv", F.col("_h") + after.cast(EXACT))
    above = F.coalesce(F.sum("_adv").over(Window.partitionBy("doc_id").orderBy("elem_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(EXACT))
    p = p.withColumn("_y", above + F.lit(TOP).cast(EXACT))
    p = p.withColumn("x0", F.lit(LEFT)).withColumn("y0", F.round("_y", 2).cast("double")).withColumn("x1", F.lit(LEFT + width)).withColumn("y1", F.round(F.col("_y") + F.col("_h"), 2).cast("double"))
    return p.filter((F.length("text") > 0) | ((F.col("kind") == "tbl") & (F.col("n_rows") > 0))).drop("_h", "_adv", "_y")


def classified(laid: DataFrame) -> DataFrame:
    """Paragraph blocks with type, role, reading order and font name with its suffixes."""
    paras = laid.filter("kind = 'p'")
    c = classify_paragraph(F.lower(F.coalesce("style_name", F.lit(""))), F.coalesce("font_size", F.lit(11.0)), F.coalesce("bold", F.lit(False)), F.col("text"))
    font = F.concat(F.coalesce("font_name", F.lit("Calibri")), F.when(F.col("bold"), "-Bold").otherwise(""), F.when(F.col("italic"), "-Italic").otherwise(""))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("elem_idx")) - 1
    return paras.withColumn("_c", c).select(*paras.columns, F.col("_c.block_type").alias("block_type"), F.col("_c.role").alias("role"), font.alias("fontname"), order.alias("reading_order"), stable_id(F.col("doc_id"), F.lit("para"), F.col("elem_idx")).alias("id"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once a row wherever use has it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def wrap_words(laid: DataFrame) -> DataFrame:
    """A row per word with its x span: a word starts at the left again after one that ended beyond the right.

    The place of a word depends on all before it since the last wrap: an ordered fold finds the wraps, whose number is
    the number of text lines, and a fold over each text line places its words. Nothing is moved or sorted. Points are
    counted as integers of 1/1000, so the sums are exact.
    """
    words = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    unit = lambda c: F.round(c * 1000).cast("bigint")
    size = F.coalesce("font_size", F.lit(11.0))
    zero = F.lit(0).cast("bigint")

    def wraps(steps: Column, most: Column) -> Column:
        def step(a: Column, w: Column) -> Column:
            x, i = a["x"] + w, a["i"] + 1
            return F.when(x > most, F.struct(zero.alias("x"), i.alias("i"), F.concat(a["at"], F.array(i)).alias("at"))).otherwise(F.struct(x.alias("x"), i.alias("i"), a["at"].alias("at")))

        return F.aggregate(steps, F.struct(zero.alias("x"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("at")), step)["at"]

    # What does not depend on the word is reckoned once a paragraph: rounding costs far more than the fold.
    fixed = F.struct(unit(size * WORD).alias("char"), unit(size * GAP).alias("gap"), unit(F.col("x1") - F.col("x0")).alias("most"))
    steps = lambda u: F.transform("_words", lambda w: F.length(w) * u["char"] + u["gap"])
    folded = _once(fixed, lambda u: _once(steps(u), lambda s: F.struct(u["char"].alias("char"), s.alias("steps"), wraps(s, u["most"]).alias("at"))))
    p = laid.filter("kind = 'p'").withColumn("_words", words).withColumn("_f", folded)
    # The words of each text line are cut out before lines become rows, so no row holds the whole paragraph.
    first = F.struct(zero.alias("x"), F.array().cast("array<bigint>").alias("all"))
    along = lambda steps: F.aggregate(steps, first, lambda a, w: F.struct((a["x"] + w).alias("x"), F.concat(a["all"], F.array(a["x"])).alias("all")))["all"]

    def line(s: Column, i: Column) -> Column:
        n = F.coalesce(F.get("_f.at", i + 1), F.size("_words")) - s
        return F.struct(s.alias("s"), F.slice("_words", s + 1, n).alias("text"), along(F.slice("_f.steps", s + 1, n)).alias("x"))

    # Every paragraph has a line. Of a plain inline Spark checks the array's size first, and folds again for that.
    rows = p.select("doc_id", "elem_idx", "x0", "x1", "y0", "y1", F.col("_f.char").alias("_char"), F.inline_outer(F.transform("_f.at", line)))
    out = rows.select("doc_id", "elem_idx", "_char", "x0", "x1", "y0", "y1", "s", F.posexplode(F.arrays_zip("text", "x")).alias("_k", "_w"))
    wide = F.length("_w.text") * F.col("_char")
    left, right = F.col("x0") + F.col("_w.x") / 1000.0, F.col("x0") + (F.col("_w.x") + wide) / 1000.0
    return out.select("doc_id", "elem_idx", (F.col("s") + F.col("_k")).alias("word_idx"), "_w.text", F.round(left, 2).alias("wx0"), F.round(F.least(right, F.col("x1")), 2).alias("wx1"), F.col("y0").alias("wy0"), F.col("y1").alias("wy1"))


def paginate(rows: DataFrame, page_h: float = 792.0) -> DataFrame:
    """rows with page_number and page-relative y: a row belongs to the page of its top and may reach below the end."""
    page = F.floor(F.col("y0") / page_h)
    out = rows.withColumn("page_number", (page + 1).cast("int"))
    top = (page * page_h).cast("decimal(18,2)")
    on_page = lambda y: (F.col(y).cast("decimal(18,2)") - top).cast("double")
    return out.withColumns({"y0": on_page("y0"), "y1": on_page("y1")})


def pages_of(rows: DataFrame, docs: DataFrame, page_h: float = 792.0) -> DataFrame:
    """Every page of every document of docs (doc_id), empty ones too; a document without rows has one."""
    top = rows.groupBy("doc_id").agg(F.max("y1").alias("_y"))
    n = F.greatest(F.lit(1), F.floor(F.coalesce("_y", F.lit(0.0)) / page_h) + 1).cast("int")
    return docs.select("doc_id").distinct().join(top, "doc_id", "left").select("doc_id", F.explode(F.sequence(F.lit(1), n)).alias("page_number"))
