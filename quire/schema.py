"""Types of the document model: legal values, Spark schemas and checks of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "3.0"

# Legal members of the document format.
SOURCE_TYPES = ("pdf", "docx", "html", "image")
BLOCK_TYPES = ("heading", "paragraph", "list_item", "table", "figure", "caption", "header", "footer", "page_number", "code_block")
ROLES = ("title", "section_title", "subsection_title", "paragraph", "list_item", "table", "figure", "caption", "header", "footer")
WEIGHTS = ("normal", "bold")
ALIGNS = ("left", "center", "right", "justify")
RELATIONS = ("next", "parent", "child", "caption_of")
RHETORIC = {
    "tone": ("formal", "neutral", "conversational", "legal", "compliance", "academic"),
    "voice": ("active", "passive", "mixed"),
    "modality": ("mandatory", "advisory", "descriptive"),
    "tense": ("present", "past", "future", "mixed"),
    "domain": ("legal", "banking", "technical", "general"),
}
PAGE_UNITS = ("pt", "px")
RHETORIC_FEATURES = ("avg_sentence_length", "modal_density", "passive_ratio", "legal_term_density")

BOX = [T.StructField(c, T.DoubleType()) for c in ("x0", "y0", "x1", "y1")]
CHAR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page_number", T.IntegerType()), T.StructField("char_idx", T.IntegerType()), T.StructField("text", T.StringType()), *BOX, T.StructField("fontname", T.StringType()), T.StructField("size", T.DoubleType()), T.StructField("color", T.StringType())])
PAGE = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page_number", T.IntegerType()), T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])
EDIT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("block_id", T.StringType()), T.StructField("new_content", T.StringType())])
RHETORIC_TYPE = T.StructType([T.StructField(c, T.StringType()) for c in RHETORIC])
FEATURES_TYPE = T.StructType([T.StructField(c, T.DoubleType()) for c in RHETORIC_FEATURES])


def member_or(col: Column, legal: tuple[str, ...], default: str | None) -> Column:
    """col where it is a legal value, else default."""
    return F.when(col.isin(*legal), col).otherwise(F.lit(default))


def page_problems() -> Column:
    """Names of the checks that a page row fails."""
    checks = {"page_number": F.col("page_number") >= 1, "width": F.col("width") > 0, "height": F.col("height") > 0}
    return _problems(checks)


def block_problems() -> Column:
    checks = {"page": F.col("page_number") >= 1, "reading_order": F.col("reading_order") >= 0, "bbox": F.size("bbox") == 4}
    return _problems(checks)


def cell_problems() -> Column:
    checks = {"row": F.col("row") >= 0, "col": F.col("col") >= 0, "row_span": F.col("row_span") >= 1, "col_span": F.col("col_span") >= 1}
    return _problems(checks)


def _problems(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in checks.items()]), lambda c: c.isNotNull())


def quarantine(rows: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that fail with the names of their failed checks."""
    seen = rows.withColumn("problems", problems)
    return seen.filter(F.size("problems") == 0).drop("problems"), seen.filter(F.size("problems") > 0)
