"""Characters to words, lines and blocks; tables against text.

All three steps work inside (doc_id, page_number), so one hash exchange by that key serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.layout import font_family, rounded, stable_id, visible_char

PAGE = ("doc_id", "page_number")
# Gap and tolerance factors of the document format.
GAP_OF_WIDTH, GAP_OF_SIZE = 0.35, 0.25
LINE_OF_SIZE, LINE_LEAST = 0.6, 3.0
BLOCK_OF_SIZE, BLOCK_LEAST, SHIFT = 1.5, 4.0, 40.0


#: A word as it is carried into the line and the block that it becomes a part of.
WORD = ("text", "x0", "y0", "x1", "y1")


def _merged(groups: DataFrame, keys: list[str], pos: str, sep: str, words: Column | None = None) -> DataFrame:
    """Box, ordered text, dominant font (first seen on a tie), mean size, first colour of each group of rows.

    One aggregation; fonts are counted in the group's own array, of which most groups have one. words: the array of words
    of a row; the group has them all, in its rows' order.
    """
    carried = [] if words is None else [words.alias("w")]
    rows = groups.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("text").alias("t"), F.col("fontname").alias("f"), *carried))).alias("_rows"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
        F.sum("size").alias("_size"),
        F.min(F.struct(F.col(pos).alias("p"), F.col("color").alias("c"))).alias("_color"),
    )
    fonts = F.col("_rows")["f"]
    # Distinct keeps the order of first sight, so among equal counts the largest negated place is the first seen.
    kinds = F.array_distinct(fonts)
    counted = F.transform(kinds, lambda f, i: F.struct(F.size(F.filter(fonts, lambda g: g.eqNullSafe(f))).alias("n"), (-i).alias("i"), f.alias("f")))
    font = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(F.array_max(counted)["f"])
    return rows.select(*keys, F.array_join(F.col("_rows")["t"], sep).alias("text"), "x0", "y0", "x1", "y1", font.alias("fontname"), rounded(F.col("_size") / F.size("_rows"), 2).alias("size"), F.col("_color")["c"].alias("color"), *([] if words is None else [F.flatten(F.col("_rows")["w"]).alias("words")]))


def filter_chars(chars: DataFrame) -> DataFrame:
    """Without empty characters and white space other than the plain space; sizes to two places."""
    return chars.filter(visible_char(F.col("text"))).withColumn("size", rounded(F.col("size"), 2))


def build_words(chars: DataFrame) -> DataFrame:
    """A word ends where the next character is not on the same line or too far to the right.

    Only the previous character matters, so a lag finds the breaks and a running sum numbers the words.
    """
    order = Window.partitionBy(*PAGE).orderBy("_row", "x0", "char_idx")
    c = chars.withColumn("_row", rounded(F.col("y0"), 1))
    names = ("x0", "y0", "x1", "y1", "size")
    c = c.withColumns({f"_p_{n}": F.lag(n).over(order) for n in names} | {"_pos": F.row_number().over(order)})
    p = {n: F.col(f"_p_{n}") for n in names}
    overlap = F.least(p["y1"], F.col("y1")) - F.greatest(p["y0"], F.col("y0"))
    least = F.least(p["y1"] - p["y0"], F.col("y1") - F.col("y0"))
    same = (overlap > 0) & (overlap / F.greatest(least, F.lit(0.1)) > 0.5)
    mean = (p["x1"] - p["x0"] + F.col("x1") - F.col("x0")) / 2.0
    near = F.col("x0") - p["x1"] <= F.greatest(mean * GAP_OF_WIDTH, p["size"] * GAP_OF_SIZE)
    start = F.when((F.col("_pos") > 1) & same & near, 0).otherwise(1)
    c = c.withColumn("_start", start).withColumn("word_idx", (F.sum("_start").over(order) - 1).cast("int"))
    return _merged(c, [*PAGE, "word_idx"], "_pos", "")


def _breaks(rows: Column, tolerance: float, least: float) -> Column:
    """Positions where a line starts: the first word of a line is the reference of all others.

    An ordered fold whose state grows by one number per line.
    """
    start = F.struct(F.lit(None).cast("double").alias("mid"), F.lit(0.0).alias("tol"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, w: Column) -> Column:
        stays = a["mid"].isNotNull() & (F.abs(w["mid"] - a["mid"]) <= a["tol"])
        fresh = F.struct(w["mid"].alias("mid"), F.greatest(w["size"] * tolerance, F.lit(least)).alias("tol"), F.concat(a["at"], F.array(w["n"])).alias("at"))
        return F.when(stays, a).otherwise(fresh)

    return F.aggregate(rows, start, step)["at"]


def assign_lines(words: DataFrame) -> DataFrame:
    """words with line_idx."""
    own = [c for c in words.columns if c not in PAGE]
    row = F.struct("y0", "x0", "word_idx", ((F.col("y0") + F.col("y1")) / 2.0).alias("mid"), F.col("size").alias("size"), F.struct(*own).alias("w"))
    pages = words.groupBy(*PAGE).agg(F.sort_array(F.collect_list(row)).alias("_rows"))
    numbered = F.transform("_rows", lambda r, i: F.struct(i.alias("n"), r["mid"].alias("mid"), r["size"].alias("size")))
    # The words come out of the page's own array with their line: no join, and words are built once.
    lines = pages.select(*PAGE, "_rows", _breaks(numbered, LINE_OF_SIZE, LINE_LEAST).alias("_at"))
    each = lines.select(*PAGE, "_at", F.posexplode("_rows").alias("_n", "_row"))
    return each.select(*PAGE, "_row.w.*", (F.size(F.filter("_at", lambda x: x <= F.col("_n"))) - 1).alias("line_idx"))


def build_lines(words: DataFrame, with_words: bool = False) -> DataFrame:
    """Words of a line from left to right, joined by a space; with_words keeps them, as words."""
    w = assign_lines(words)
    return _merged(w.withColumn("_pos", F.struct("x0", "y0", "word_idx")), [*PAGE, "line_idx"], "_pos", " ", F.array(F.struct(*WORD)) if with_words else None)


def assign_blocks(lines: DataFrame) -> DataFrame:
    """lines with block_idx: a block goes on while the next line is near, aligned and of the same font family."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "line_idx")
    ln = lines.withColumn("_prev", F.lag(F.struct("x0", "y1", "size", font_family(F.col("fontname")).alias("family"))).over(order)).withColumn("_pos", F.row_number().over(order))
    p = F.col("_prev")
    joins = (F.col("y0") - p["y1"] <= F.greatest(p["size"] * BLOCK_OF_SIZE, F.lit(BLOCK_LEAST))) & (F.abs(F.col("x0") - p["x0"]) <= SHIFT) & (font_family(F.col("fontname")) == p["family"])
    ln = ln.withColumn("_start", F.when(p.isNotNull() & joins, 0).otherwise(1))
    return ln.withColumn("block_idx", (F.sum("_start").over(order) - 1).cast("int")).drop("_prev", "_start")


def build_blocks(lines: DataFrame) -> DataFrame:
    """Blocks with a stable id, and with the words of their lines if lines have them."""
    blocks = _merged(assign_blocks(lines), [*PAGE, "block_idx"], "_pos", "\n", F.col("words") if "words" in lines.columns else None)
    return blocks.withColumn("id", stable_id(F.col("doc_id"), F.col("page_number"), F.lit("block"), F.col("block_idx")))


def blocks_outside_tables(blocks: DataFrame, tables: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Blocks of which no single table covers more than threshold: an anti join on the page with a residual."""
    b, t = blocks.alias("b"), tables.alias("t")
    side = lambda lo, hi: F.greatest(F.least(F.col(f"b.{hi}"), F.col(f"t.{hi}")) - F.greatest(F.col(f"b.{lo}"), F.col(f"t.{lo}")), F.lit(0.0))
    area = (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0"))
    covered = side("x0", "x1") * side("y0", "y1") / F.greatest(area, F.lit(0.01)) > threshold
    return b.join(t, (F.col("b.doc_id") == F.col("t.doc_id")) & (F.col("b.page_number") == F.col("t.page_number")) & covered, "left_anti")


def table_grid(cells: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """cells (table_id, row, col, text) with the table's dimensions and each cell's box on a uniform grid."""
    from quire.functions.layout import cell_box, strip

    over = Window.partitionBy("table_id")
    n_rows, n_cols = F.max("row").over(over) + 1, F.max("col").over(over) + 1
    sized = cells.withColumn("n_rows", n_rows).withColumn("n_cols", n_cols)
    lits = tuple(F.lit(v) for v in box)
    return sized.select("table_id", "row", "col", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), strip(F.coalesce("text", F.lit(""))).alias("text"), "n_rows", "n_cols", cell_box(lits, F.col("n_rows"), F.col("n_cols"), F.col("row"), F.col("col")).alias("bbox"))
