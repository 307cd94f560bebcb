"""Column expressions of the layout model: geometry, fonts, colours, heuristics, styles. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.schema import ALIGNS, BLOCK_TYPES, FEATURES_TYPE, RHETORIC, RHETORIC_FEATURES, ROLES, WEIGHTS, member_or

# Font suffixes in the order in which they are cut, bullets, modal verbs, maps of the document format.
FONT_SUFFIXES = ("-Bold", "-Italic", "-BoldItalic", ",Bold", ",Italic", "-Regular", ",Regular", "+")
BULLETS = "•-–▪◦"
PARAGRAPH_BULLETS = "•–—▪◦○"
MODALS = ("shall", "must", "may", "should", "will", "can", "could", "would", "might")
ROLE_OF_TYPE = {"heading": "section_title", "paragraph": "paragraph", "list_item": "list_item", "table": "table", "figure": "figure", "caption": "caption", "header": "header", "footer": "footer", "page_number": "footer", "code_block": "paragraph"}
TAG_OF_TYPE = {"heading": "h2", "paragraph": "p", "list_item": "li", "table": "table", "figure": "figure", "caption": "figcaption", "header": "header", "footer": "footer", "page_number": "span", "code_block": "pre"}

#: Our lexicon of legal terms, version 1: the document format leaves it open.
LEGAL_TERMS = ("agreement", "clause", "compliance", "contract", "hereby", "herein", "indemnify", "jurisdiction", "liability", "license", "obligation", "party", "pursuant", "regulation", "statute", "thereof", "warranty")

STRIP = r"(?U)^\s+|\s+$"


def lookup(col: Column, table: dict[str, str], default: str) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, col), F.lit(default))


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(col, STRIP, "")


def rounded(c: Column, places: int) -> Column:
    """Half-way values to even. Only values next to a half are rounded as decimals, which is much dearer."""
    scaled = c * float(10**places)
    clear = (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3) & (F.abs(scaled) < float(1 << 40))
    return F.when(clear, F.rint(scaled) / float(10**places)).otherwise(F.bround(c, places))


def visible_char(text: Column) -> Column:
    """Non-empty, and no white space but the plain space."""
    plain = text.between("!", "~")  # most characters, without a pattern
    return (F.length(text) > 0) & (plain | (text == " ") | ~text.rlike(r"(?U)^\s+$"))


def font_family(font: Column) -> Column:
    """The part before the first of the style suffixes; a subset prefix before + stays alone."""
    return F.trim(reduce(lambda c, s: F.substring_index(c, s, 1), FONT_SUFFIXES, font))


def clean_font(font: Column) -> Column:
    """The part after the first +."""
    return F.regexp_replace(font, r"^[^+]*\+", "")


def _byte(v: Column) -> Column:
    return F.lower(F.lpad(F.hex(v.cast("int")), 2, "0"))


def color_hex(c: Column) -> Column:
    """#rrggbb of an array of 1 (grey), 3 (RGB) or 4 (CMYK) shares; black for anything else."""
    held = lambda i: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(c, F.lit(i)))) * 255
    ink = lambda i: 255 * (1 - F.get(c, F.lit(i))) * (1 - F.get(c, F.lit(3)))
    rgb = F.concat(F.lit("#"), *[_byte(held(i)) for i in range(3)])
    grey = F.concat(F.lit("#"), *[_byte(held(0))] * 3)
    cmyk = F.concat(F.lit("#"), *[_byte(ink(i)) for i in range(3)])
    return F.coalesce(F.when(F.size(c) == 3, rgb).when(F.size(c) == 1, grey).when(F.size(c) == 4, cmyk), F.lit("#000000"))


def normalized_box(box: tuple[Column, Column, Column, Column], width: Column, height: Column) -> Column:
    """Shares of the page, to six places; zeros for a page without area."""
    x0, y0, x1, y1 = box
    share = F.array(rounded(x0 / width, 6), rounded(y0 / height, 6), rounded(x1 / width, 6), rounded(y1 / height, 6))
    return F.when((width <= 0) | (height <= 0), F.array(*[F.lit(0.0)] * 4)).otherwise(share)


def cell_box(box: tuple[Column, Column, Column, Column], n_rows: Column, n_cols: Column, row: Column, col: Column) -> Column:
    """The cell's share of a uniform grid over the table, to two places."""
    x0, y0, x1, y1 = box
    w, h = (x1 - x0) / F.greatest(n_cols, F.lit(1)), (y1 - y0) / F.greatest(n_rows, F.lit(1))
    return F.array(F.bround(x0 + col * w, 2), F.bround(y0 + row * h, 2), F.bround(x0 + (col + 1) * w, 2), F.bround(y0 + (row + 1) * h, 2))


def guess_block_type(text: Column, size: Column, font: Column) -> Column:
    """Type from font size, weight and the text's start."""
    big = (size >= 14) | (F.contains(F.lower(font), F.lit("bold")) & (size >= 12))
    number = text.rlike(r"(?U)^\s*\p{Nd}+\s*$")  # so it is one word
    bullet = text.rlike(rf"(?U)^\s*({'|'.join(BULLETS)})")
    numbered = (F.length(text) > 2) & text.rlike(r"^\p{Nd}[.)]")
    return F.when(big, "heading").when(number, "page_number").when(bullet | numbered, "list_item").otherwise("paragraph")


def guess_role(block_type: Column) -> Column:
    return lookup(block_type, ROLE_OF_TYPE, "paragraph")


def classify_paragraph(style: Column, size: Column, bold: Column, text: Column) -> Column:
    """struct(block_type, role) from a paragraph's style name (lower case), size, weight and text."""
    kind = lambda t, r: F.struct(F.lit(t).alias("block_type"), F.lit(r).alias("role"))
    has = lambda s: F.contains(style, F.lit(s))
    level = F.array_min(F.array(*[F.when(has(str(i)), F.lit(i)) for i in range(1, 7)]))
    bare = F.regexp_replace(text, r"(?U)^\s+", "")
    return (
        F.when(has("title"), kind("heading", "title"))
        .when(has("heading") & (level > 2), kind("heading", "subsection_title"))
        .when(has("heading"), kind("heading", "section_title"))
        .when(has("list") | has("bullet"), kind("list_item", "list_item"))
        .when(has("caption"), kind("caption", "caption"))
        .when(has("code") | has("mono"), kind("code_block", "paragraph"))
        .when(bold & (size >= 14), kind("heading", "section_title"))
        .when(bare.rlike(f"^[{PARAGRAPH_BULLETS}]"), kind("list_item", "list_item"))
        .when((F.length(bare) > 2) & bare.rlike(r"^\p{Nd}[.)]"), kind("list_item", "list_item"))
        .otherwise(kind("paragraph", "paragraph"))
    )


def style_of(font: Column, size: Column, color: Column) -> Column:
    """The style a block's font, size and colour stand for."""
    name = F.coalesce(font, F.lit("unknown"))
    low = F.lower(name)
    return F.struct(
        clean_font(name).alias("font_family"),
        F.bround(F.coalesce(size, F.lit(0.0)), 1).alias("size"),
        F.when(F.contains(low, F.lit("bold")), "bold").otherwise("normal").alias("weight"),
        (F.contains(low, F.lit("italic")) | F.contains(low, F.lit("oblique"))).alias("italic"),
        F.lit(False).alias("underline"),
        F.coalesce(color, F.lit("#000000")).alias("color"),
        F.lit("left").alias("align"),
    )


def style_id(style: Column) -> Column:
    """First 12 hex digits of SHA-256 over family, size, weight, italic and colour."""
    slanted = F.when(style["italic"], "True").otherwise("False")
    return F.left(F.sha2(F.concat_ws("|", style["font_family"], style["size"].cast("string"), style["weight"], slanted, style["color"]), 256), F.lit(12))


def safe_block_type(c: Column) -> Column:
    return member_or(c, BLOCK_TYPES, "paragraph")


def safe_role(c: Column) -> Column:
    return member_or(c, ROLES, "paragraph")


def safe_weight(c: Column) -> Column:
    return member_or(c, WEIGHTS, None)


def safe_align(c: Column) -> Column:
    return member_or(c, ALIGNS, None)


def html_tag(block_type: Column) -> Column:
    return lookup(block_type, TAG_OF_TYPE, "p")


def html_of(block_type: Column, text: Column) -> Column:
    """The block as an element; the text is not escaped here."""
    t = html_tag(block_type)
    return F.concat(F.lit("<"), t, F.lit(">"), text, F.lit("</"), t, F.lit(">"))


def rhetoric(raw: Column) -> Column:
    """The struct, or null if a member has an illegal value."""
    ok = reduce(lambda a, b: a & b, [raw[k].isNull() | raw[k].isin(*v) for k, v in RHETORIC.items()])
    return F.when(ok, F.struct(*[raw[k].alias(k) for k in RHETORIC]))


def rhetoric_features(raw: Column) -> Column:
    """raw: struct of strings. The struct of doubles, or null if a member is no number."""
    ok = reduce(lambda a, b: a & b, [raw[k].isNull() | raw[k].try_cast("double").isNotNull() for k in RHETORIC_FEATURES])
    return F.when(ok, F.struct(*[raw[k].try_cast("double").alias(k) for k in RHETORIC_FEATURES]).cast(FEATURES_TYPE))


def measured_features(text: Column) -> Column:
    """Words per sentence, and shares of modal verbs, passive sentences and legal terms (English)."""
    low = F.lower(text)
    words = F.filter(F.split(low, r"[^\p{L}\p{Nd}']+"), lambda w: w != "")
    sentences = F.filter(F.split(low, r"[.!?]+"), lambda s: s.rlike(r"\S"))
    n, m = F.size(words), F.greatest(F.size(sentences), F.lit(1))
    passive = F.size(F.filter(sentences, lambda s: s.rlike(r"(^|[^\p{L}\p{Nd}'])(is|are|was|were|be|been|being|am) [\p{L}\p{Nd}']*(ed|en)($|[^\p{L}\p{Nd}'])")))
    per = lambda terms: F.when(n > 0, F.size(F.filter(words, lambda w: w.isin(*terms))) / n).otherwise(0.0)
    return F.struct(
        F.when(n > 0, F.bround(n / m, 6)).otherwise(0.0).alias("avg_sentence_length"),
        F.bround(per(MODALS), 6).alias("modal_density"),
        F.when(n > 0, F.bround(passive / m, 6)).otherwise(0.0).alias("passive_ratio"),
        F.bround(per(LEGAL_TERMS), 6).alias("legal_term_density"),
    )


def truncated(text: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(mark))).otherwise(text)


def stable_id(*parts: Column) -> Column:
    """An id that reruns repeat."""
    return F.left(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), F.lit(32))


def title_from_name(name: Column) -> Column:
    """File name without extension, separators as spaces, each run of letters capitalised."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    plain = F.lower(F.translate(stem, "_-", "  "))
    runs = F.regexp_extract_all(plain, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.substring(r, 2, 1 << 30))), "")
