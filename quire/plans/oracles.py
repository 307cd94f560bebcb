"""The same results as quire.plans.queries in SQL (DuckDB), written apart from the DataFrame plans."""

from __future__ import annotations


def _pick(n: str, *values: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][(({n}) % {len(values)}) + 1]"


LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents)"""

CHARS = (
    LINES
    + """,
l2 AS (SELECT *, ceil(length(line) / 78.0)::INT + 2 AS n_rows FROM lines),
l3 AS (SELECT *, coalesce(sum(n_rows) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS row0, doc_id + line_no AS k FROM l2),
ch AS (SELECT doc_id, line_no, row0, k, unnest(string_split(line, '')) AS text, unnest(range(len(string_split(line, '')))) AS pos FROM l3),
c1 AS (SELECT *, row0 + pos // 78 AS r, CASE WHEN line_no = 0 THEN 16.0::DOUBLE ELSE 12.0::DOUBLE END AS size FROM ch WHERE text <> '' AND (text <> ' ' OR k % 2 = 1)),
chars AS (SELECT doc_id, (r // 50 + 1)::INT AS page_number, (r * 78 + pos % 78)::INT AS char_idx, text, 72.0::DOUBLE + 6 * (pos % 78) AS x0, 72.0::DOUBLE + 14 * (r % 50) AS y0, 78.0::DOUBLE + 6 * (pos % 78) AS x1, 72.0::DOUBLE + 14 * (r % 50) + size AS y1, """
    + _pick("k", "Arial", "ABCDEF+Times-Bold", "Arial-BoldItalic")
    + " AS fontname, size, "
    + _pick("line_no", "#000000", "#0a0a0a")
    + " AS color FROM c1)"
)

FILTERED = CHARS + """,
kept AS (SELECT * REPLACE (round_even(size, 2) AS size) FROM chars WHERE text = ' ' OR NOT regexp_full_match(text, '\\s+'))"""


def _merged(src: str, keys: str, pos: str, sep: str, out: str) -> str:
    return f"""
{out}_f AS (SELECT {keys}, fontname, count(*) AS n, min({pos}) AS p FROM {src} GROUP BY ALL),
{out}_d AS (SELECT {keys}, arg_max(fontname, [n, -p]) AS fontname FROM {out}_f GROUP BY ALL),
{out} AS (SELECT * FROM (SELECT {keys}, string_agg(text, {sep} ORDER BY {pos}) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, round_even(sum(size) / count(*), 2) AS size, arg_min(color, {pos}) AS color FROM {src} GROUP BY ALL) JOIN {out}_d USING ({keys}))"""


WORDS = (
    FILTERED
    + """,
w1 AS (SELECT *, row_number() OVER w AS pos, lag(x0) OVER w AS px0, lag(x1) OVER w AS px1, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(size) OVER w AS ps FROM kept WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY round_even(y0, 1), x0, char_idx)),
w2 AS (SELECT *, CASE WHEN px0 IS NOT NULL AND least(py1, y1) - greatest(py0, y0) > 0 AND (least(py1, y1) - greatest(py0, y0)) / greatest(least(py1 - py0, y1 - y0), 0.1) > 0.5 AND x0 - px1 <= greatest((px1 - px0 + x1 - x0) / 2.0 * 0.35, ps * 0.25) THEN 0 ELSE 1 END AS s FROM w1),
w3 AS (SELECT *, (sum(s) OVER (PARTITION BY doc_id, page_number ORDER BY pos) - 1)::INT AS word_idx FROM w2),"""
    + _merged("w3", "doc_id, page_number, word_idx", "pos", "''", "words")
)

MADE_LINES = (
    WORDS
    + """,
n1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y0, x0, word_idx) AS n FROM words),
n2 AS (SELECT doc_id, page_number, list({'mid': (y0 + y1) / 2.0, 'tol': greatest(size * 0.6, 3.0), 'at': [n]} ORDER BY n) AS ws FROM n1 GROUP BY ALL),
n3 AS (SELECT doc_id, page_number, list_reduce(ws, lambda a, x: CASE WHEN abs(x.mid - a.mid) <= a.tol THEN a ELSE {'mid': x.mid, 'tol': x.tol, 'at': list_concat(a.at, x.at)} END).at AS starts FROM n2),
n4 AS (SELECT n1.*, (len(list_filter(starts, lambda v: v <= n)) - 1)::INT AS line_idx FROM n1 JOIN n3 USING (doc_id, page_number)),
n5 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, line_idx ORDER BY x0, y0, word_idx) AS pos FROM n4),"""
    + _merged("n5", "doc_id, page_number, line_idx", "pos", "' '", "made")
)


def _family(c: str) -> str:
    for s in ("-Bold", "-Italic", "-BoldItalic", ",Bold", ",Italic", "-Regular", ",Regular", "+"):
        c = f"split_part({c}, '{s}', 1)"
    return f"trim({c})"


BLOCKS = (
    MADE_LINES
    + f""",
b1 AS (SELECT *, {_family("fontname")} AS fam, row_number() OVER w AS pos, lag(x0) OVER w AS px0, lag(y1) OVER w AS py1, lag(size) OVER w AS ps, lag({_family("fontname")}) OVER w AS pfam FROM made WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY y0, line_idx)),
b2 AS (SELECT *, CASE WHEN px0 IS NOT NULL AND y0 - py1 <= greatest(ps * 1.5, 4.0) AND abs(x0 - px0) <= 40 AND fam = pfam THEN 0 ELSE 1 END AS s FROM b1),
b3 AS (SELECT *, (sum(s) OVER (PARTITION BY doc_id, page_number ORDER BY pos) - 1)::INT AS block_idx FROM b2),"""
    + _merged("b3", "doc_id, page_number, block_idx", "pos", "chr(10)", "blocks")
)


def _id(*parts: str) -> str:
    return f"left(sha256(concat_ws('|', {', '.join(parts)})), 32)"


def _guess(text: str, size: str, font: str) -> str:
    return f"""CASE WHEN {size} >= 14 OR (contains(lower({font}), 'bold') AND {size} >= 12) THEN 'heading'
 WHEN len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')) <= 3 AND regexp_full_match(trim({text}), '[0-9]+') THEN 'page_number'
 WHEN regexp_matches({text}, '^\\s*[•\\-–▪◦]') OR (length({text}) > 2 AND regexp_matches({text}, '^[0-9][.)]')) THEN 'list_item' ELSE 'paragraph' END"""


ROLE = "CASE block_type WHEN 'heading' THEN 'section_title' WHEN 'page_number' THEN 'footer' WHEN 'code_block' THEN 'paragraph' ELSE block_type END"

PARAS = (
    LINES
    + ",\nq1 AS (SELECT *, doc_id + line_no AS k FROM lines),\nq2 AS (SELECT doc_id, line_no, k, "
    + _pick("k", "Normal", "Title", "Heading 2", "Heading 3", "List Bullet", "Caption", "Source Code", "Normal")
    + " AS style_name, CASE WHEN k % 13 = 0 THEN (k + 1)::VARCHAR ELSE "
    + _pick("k + k // 8", "", "• ", "1. ", "2)", "- ", " 3. ")
    + " || line END AS text, "
    + _pick("k", "Calibri", "Arial", "ABCDEF+Times-Bold")
    + """ AS font_name, CASE WHEN k % 7 = 0 THEN 14.0::DOUBLE ELSE 11.0::DOUBLE END AS font_size, k % 3 = 0 AS bold, k % 5 = 0 AS italic FROM q1),
paras AS (SELECT doc_id, (line_no * 3)::INT AS elem_idx, 'p' AS kind, style_name, text, font_name, font_size, bold, italic, 0 AS n_rows FROM q2
 UNION ALL SELECT doc_id, (line_no * 3 + 1)::INT, 'p', style_name, '', font_name, font_size, bold, italic, 0 FROM q2 WHERE k % 10 = 0
 UNION ALL SELECT doc_id, (line_no * 3 + 2)::INT, 'tbl', style_name, '', font_name, font_size, bold, italic, (k % 4 + 1)::INT FROM q2 WHERE k % 9 = 0)"""
)

CLASSIFY = """CASE WHEN contains(st, 'title') THEN 'heading/title' WHEN contains(st, 'heading') AND regexp_matches(st, '[1-6]') AND NOT regexp_matches(st, '[12]') THEN 'heading/subsection_title' WHEN contains(st, 'heading') THEN 'heading/section_title'
 WHEN contains(st, 'list') OR contains(st, 'bullet') THEN 'list_item/list_item' WHEN contains(st, 'caption') THEN 'caption/caption' WHEN contains(st, 'code') OR contains(st, 'mono') THEN 'code_block/paragraph'
 WHEN bold AND font_size >= 14 THEN 'heading/section_title' WHEN regexp_matches(ltrim(text), '^[•–—▪◦○]') THEN 'list_item/list_item' WHEN length(ltrim(text)) > 2 AND regexp_matches(ltrim(text), '^[0-9][.)]') THEN 'list_item/list_item' ELSE 'paragraph/paragraph' END"""

LAID = (
    PARAS
    + """,
y1_ AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text) FROM paras),
y2_ AS (SELECT *, CASE WHEN kind = 'tbl' THEN n_rows * 20.0::DOUBLE WHEN text = '' THEN 0.0::DOUBLE ELSE font_size * 1.4::DOUBLE * greatest(1.0::DOUBLE, length(text) * font_size * 0.6::DOUBLE / 468.0::DOUBLE + 0.5::DOUBLE) END::DECIMAL(24, 8) AS h,
 CASE WHEN kind = 'tbl' THEN 12.0::DOUBLE WHEN text = '' THEN 6.0::DOUBLE ELSE font_size * 0.4::DOUBLE END::DECIMAL(24, 8) AS aft FROM y1_),
y3_ AS (SELECT *, coalesce(sum(h + aft) OVER (PARTITION BY doc_id ORDER BY elem_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 36 AS y FROM y2_),
laid AS (SELECT *, round(y, 2)::DOUBLE AS y0, round(y + h, 2)::DOUBLE AS y1 FROM y3_ WHERE text <> '' OR kind = 'tbl')"""
)

CLASSIFIED = LAID + f""",
cl AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY elem_idx) - 1 AS reading_order, split_part(c, '/', 1) AS block_type, split_part(c, '/', 2) AS role, font_name || CASE WHEN bold THEN '-Bold' ELSE '' END || CASE WHEN italic THEN '-Italic' ELSE '' END AS fontname
 FROM (SELECT *, {CLASSIFY} AS c FROM (SELECT *, lower(style_name) AS st FROM laid WHERE kind = 'p')))"""

PARA_BLOCKS = LINES + ",\npb AS (SELECT doc_id, (line_no // 20 + 1)::INT AS page_number, (line_no % 20)::INT AS block_idx, line AS text, " + _id("doc_id", "line_no // 20 + 1", "'block'", "line_no % 20") + " AS id FROM lines)"

TAGS = (
    PARA_BLOCKS
    + """,
t1 AS (SELECT *, doc_id + page_number * 20 + block_idx AS k FROM pb),
t2 AS (SELECT *, 0 AS copy FROM t1 WHERE k % 4 <> 0 UNION ALL SELECT *, 1 FROM t1 WHERE k % 4 <> 0 AND k % 5 = 0),
tags AS (SELECT doc_id, page_number, (block_idx * 2 + copy)::INT AS tag_pos, CASE WHEN k % 11 = 0 THEN block_idx + 1000 ELSE block_idx END AS block_index, """
    + _pick("k + copy", "heading", "paragraph", "caption", "banner", "list_item", "figure", "sidebar")
    + " AS block_type, "
    + _pick("k + copy", "section_title", "paragraph", "caption", "list_item", "subtitle")
    + " AS role, CASE WHEN k % 6 <> 0 THEN block_idx + 1 END AS reading_order, "
    + _pick("k + copy", "formal", "legal", "angry")
    + " AS tone, "
    + _pick("k", "active", "passive", "loud", "mixed")
    + " AS voice, "
    + _pick("k + copy", "0.5", "0.25", "x")
    + " AS density, (k % 30)::VARCHAR AS sentence FROM t2)"
)

MATCHED = TAGS + """,
m1 AS (SELECT * FROM tags QUALIFY row_number() OVER (PARTITION BY doc_id, page_number, block_index ORDER BY tag_pos DESC) = 1),
m AS (SELECT pb.doc_id, pb.page_number, pb.block_idx, pb.id, CASE WHEN m1.block_type IN ('heading','paragraph','list_item','table','figure','caption','header','footer','page_number','code_block') THEN m1.block_type ELSE 'paragraph' END AS block_type,
 CASE WHEN m1.role IN ('title','section_title','subsection_title','paragraph','list_item','table','figure','caption','header','footer') THEN m1.role ELSE 'paragraph' END AS role, coalesce(m1.reading_order, pb.block_idx) AS reading_order, m1.tag_pos IS NOT NULL AS matched
 FROM pb LEFT JOIN m1 ON pb.doc_id = m1.doc_id AND pb.page_number = m1.page_number AND pb.block_idx = m1.block_index)"""

TABLES = """pt AS (SELECT doc_id, page_number, table_idx, doc_id + page_number + table_idx AS k FROM (SELECT DISTINCT doc_id, page_number FROM pb), (SELECT unnest([0, 1]) AS table_idx)),
tb AS (SELECT doc_id, page_number, table_idx, """ + _id("doc_id", "page_number", "'table'", "table_idx") + """ AS id, 72.0::DOUBLE AS x0, 72.0::DOUBLE + 30 * (k % 5) + 150 * table_idx AS y0, 540.0::DOUBLE - 60 * (k % 5) AS x1, 82.0::DOUBLE + 30 * (k % 5) + 150 * table_idx + 5 * (k % 4) AS y1 FROM pt)"""

EMITTED = MATCHED + ",\n" + TABLES + """,
e1 AS (SELECT doc_id, page_number, 0 AS is_table, reading_order, block_idx AS pos, id FROM m UNION ALL SELECT doc_id, page_number, 1, 0, table_idx, id FROM tb),
em AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, is_table, reading_order, pos) - 1 AS emit_idx FROM e1)"""

TREE = (
    LINES
    + ",\nr0 AS (SELECT doc_id, line, line_no, (line_no // 35 + 1)::INT AS page_number, "
    + _pick("line_no", "SectionHeader", "Text", "List", "Table", "Code", "Equation")
    + """ AS bt FROM lines),
ti AS (SELECT doc_id, page_number, line_no, unnest(string_split(line, ', ')) AS part, unnest(range(len(string_split(line, ', ')))) AS i FROM r0 WHERE bt = 'List'),
tr AS (SELECT doc_id, page_number, line_no, unnest(string_split(line, '. ')) AS part, unnest(range(len(string_split(line, '. ')))) AS r FROM r0 WHERE bt = 'Table'),
tc AS (SELECT doc_id, page_number, line_no, r, unnest(string_split(part, ' ')) AS cell, unnest(range(len(string_split(part, ' ')))) AS c FROM tr),
tree AS (SELECT doc_id, page_number, [line_no::INT] AS path, 'page_' || (page_number - 1) || '/' || bt || '/' || line_no AS id, bt AS block_type, CASE WHEN bt IN ('List', 'Table') THEN '' ELSE line END AS content, '<p>' || line || '</p>' AS html, CASE WHEN bt = 'List' THEN """
    + _pick("line_no // 6", "ordered", "unordered")
    + """ END AS list_type, CASE WHEN bt = 'SectionHeader' THEN ((doc_id + line_no) % 9)::INT END AS heading_level, bt = 'Text' AND doc_id % 3 = 0 AS blockquote, CASE WHEN line_no % 4 <> 3 THEN 72.0::DOUBLE + 14 * (line_no % 35) END AS by0 FROM r0
 UNION ALL SELECT doc_id, page_number, [line_no::INT, i::INT], 'page_0/ListItem/' || line_no || '_' || i, 'ListItem', part, '<i>' || part || '</i>', NULL, NULL, false, NULL FROM ti
 UNION ALL SELECT doc_id, page_number, [line_no::INT, 0], 'page_0/Text/' || line_no || '_0', 'Text', '<note> & ' || line_no, '<i><note> & ' || line_no || '</i>', NULL, NULL, false, NULL FROM r0 WHERE bt = 'SectionHeader'
 UNION ALL SELECT doc_id, page_number, [line_no::INT, r::INT], 'page_0/TableRow/' || line_no || '_r' || r, 'Text', '', '<i></i>', NULL, NULL, false, NULL FROM tr
 UNION ALL SELECT doc_id, page_number, [line_no::INT, r::INT, c::INT], 'page_0/TableCell/' || line_no || '_r' || r || '_c' || c, 'Text', cell, '<i>' || cell || '</i>', NULL, NULL, false, NULL FROM tc)"""
)

EDITS = """ed AS (SELECT doc_id, unnest(['page_0/SectionHeader/0', 'page_0/Text/1', 'page_0/ListItem/2_0', '__title__']) AS block_id, unnest(['New heading ' || doc_id, '', 'First item', 'Title ' || doc_id]) AS new_content FROM documents WHERE doc_id % 5 = 0)"""

PATH = "array_to_string(path, '.') AS path"

SPECS = (
    "sp AS (SELECT p_partkey, p_partkey AS k, (p_partkey % 12)::VARCHAR AS a, (p_partkey * 3 % 15)::VARCHAR AS b, (p_partkey * 7 % 10)::VARCHAR AS c, (p_partkey % 9 + 1)::INT AS total FROM part),\n"
    "sq AS (SELECT p_partkey, total, [a || ',' || b || '-' || c, a || ' , x,' || c, b || '-99', ' ', '9' || a, '1-' || b || ',,' || c, c || '-' || a || '-2'][k % 7 + 1] AS spec FROM sp),\n"
    "su AS (SELECT p_partkey, total, spec, unnest(string_split(spec, ',')) AS part FROM sq),\n"
    "sv AS (SELECT *, trim(part) AS p, CASE WHEN contains(part, '-') THEN try_cast(trim(split_part(trim(part), '-', 1)) AS INT) ELSE try_cast(trim(part) AS INT) END AS lo, CASE WHEN contains(part, '-') THEN try_cast(trim(substr(trim(part), instr(trim(part), '-') + 1)) AS INT) ELSE try_cast(trim(part) AS INT) END AS hi, contains(part, '-') AS rng FROM su)"
)

_ESC = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


ELEMENTS = (
    PARAS
    + """,
el1 AS (SELECT * REPLACE (regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text), doc_id + elem_idx // 3 AS k FROM paras),
el2 AS (SELECT doc_id, elem_idx, kind, text, n_rows, k, lower("""
    + _pick("k // 3", "Normal", "List Bullet", "List Number", "Heading 2", "Normal", "Source Code", "List Bullet", "Title")
    + """) AS st, CASE WHEN kind = 'tbl' THEN list_transform(range(n_rows), lambda r: list_transform(range((k + r) % 3 + 1), lambda c: 'c' || (k + r)::VARCHAR || ' .' || c::VARCHAR)) END AS cells FROM el1),
el3 AS (SELECT *, CASE WHEN kind = 'p' AND NOT contains(st, 'heading') AND contains(st, 'list') THEN CASE WHEN contains(st, 'number') THEN 'ordered' ELSE 'unordered' END END AS lt FROM el2 WHERE kind = 'tbl' OR text <> ''),
el4 AS (SELECT *, CASE WHEN lt = lag(lt) OVER (PARTITION BY doc_id ORDER BY elem_idx) THEN 0 ELSE 1 END AS s FROM el3),
el5 AS (SELECT *, (sum(s) OVER (PARTITION BY doc_id ORDER BY elem_idx) - 1)::INT AS o FROM el4),
el AS (SELECT *, o // 35 AS p, (row_number() OVER (PARTITION BY doc_id, o ORDER BY elem_idx) - 1)::INT AS pos, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, CASE WHEN kind = 'tbl' THEN 'Table' WHEN contains(st, 'heading') THEN 'SectionHeader' WHEN lt IS NOT NULL THEN 'ListGroup' WHEN contains(st, 'code') THEN 'Code' ELSE 'Text' END AS bt FROM el5),
er AS (SELECT doc_id, p, o, unnest(cells) AS row, unnest(range(len(cells))) AS r FROM el WHERE kind = 'tbl'),
ec AS (SELECT doc_id, p, o, r, unnest(row) AS cell, unnest(range(len(row))) AS c FROM er)"""
)

_BLOCK_ID = _id("doc_id", "page_number", "'block'", "block_idx")
_NORM = ", ".join(f"round_even({c} / {e}, 6) AS n{c}" for c, e in (("x0", 612), ("y0", 792), ("x1", 612), ("y1", 792)))

JSON_BLOCKS = (
    BLOCKS
    + f""",
jb1 AS (SELECT *, {_guess("text", "size", "fontname")} AS block_type, regexp_replace(fontname, '^[^+]*\\+', '') AS family, CASE WHEN contains(lower(fontname), 'bold') THEN 'bold' ELSE 'normal' END AS weight, contains(lower(fontname), 'italic') OR contains(lower(fontname), 'oblique') AS ital, {_BLOCK_ID} AS id FROM blocks),
jb2 AS (SELECT *, {ROLE} AS role, left(sha256(concat_ws('|', family, round_even(size, 1)::VARCHAR, weight, CASE WHEN ital THEN 'True' ELSE 'False' END, color)), 12) AS style_id, CASE block_type WHEN 'heading' THEN 'h2' WHEN 'list_item' THEN 'li' WHEN 'page_number' THEN 'span' ELSE 'p' END AS tag FROM jb1),
jb AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_idx) - 1)::INT AS place, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_idx) - 1)::INT AS reading_order FROM jb2)"""
)


def _export() -> str:
    from quire.operators.tree import CHILDREN_OPEN, HEAD_STYLE, PAGE_BREAK

    q = lambda s: "'" + s.replace("'", "''") + "'"
    kids = "(block_type = 'SectionHeader' AND len(path) = 1)"
    return f"""WITH {TREE},
x AS (SELECT *, {_ESC.format("content")} AS t, {kids} AS nest, least(6, greatest(1, CASE WHEN coalesce(heading_level, 0) <> 0 THEN heading_level ELSE 2 END)) AS lv FROM tree),
-- parents of every path: the type of the first step decides who renders it
root AS (SELECT doc_id, path[1] AS p1, block_type AS rt FROM tree WHERE len(path) = 1),
ev AS (SELECT x.doc_id, page_number, path, block_type, t, nest, lv, list_type, blockquote, content, rt, len(path) AS d FROM x JOIN root ON x.doc_id = root.doc_id AND x.path[1] = root.p1),
op AS (SELECT doc_id, page_number, path AS key, CASE WHEN d = 2 AND rt = 'List' THEN '<li>' || t || '</li>' WHEN d = 2 AND rt = 'Table' THEN '<tr>' WHEN d = 3 THEN '<td>' || t || '</td>'
  WHEN block_type = 'List' THEN CASE WHEN list_type = 'ordered' THEN '<ol>' ELSE '<ul>' END WHEN block_type = 'Table' THEN '<table>' WHEN content = '' AND NOT nest THEN NULL
  WHEN block_type = 'SectionHeader' THEN '<h' || lv || '>' || t || '</h' || lv || '>' || chr(10) || {q(CHILDREN_OPEN)} WHEN block_type = 'Text' AND blockquote THEN '<blockquote><p>' || t || '</p></blockquote>' WHEN block_type = 'Text' THEN '<p>' || t || '</p>'
  WHEN block_type = 'Code' THEN '<pre><code>' || t || '</code></pre>' WHEN block_type = 'Equation' THEN '<div class=''equation''>\\[ ' || t || ' \\]</div>' ELSE '<div>' || t || '</div>' END AS piece FROM ev
 UNION ALL SELECT doc_id, page_number, list_append(path, 2147483647), CASE WHEN d = 2 AND rt = 'Table' THEN '</tr>' WHEN d > 1 THEN NULL WHEN block_type = 'List' THEN CASE WHEN list_type = 'ordered' THEN '</ol>' ELSE '</ul>' END WHEN block_type = 'Table' THEN '</table>' WHEN nest THEN '</div>' END FROM ev),
pg AS (SELECT doc_id, page_number, coalesce(string_agg(piece, chr(10) ORDER BY key), '') AS inner_ FROM op GROUP BY ALL),
dc AS (SELECT doc_id, string_agg('<div class=''page'' id=''page-' || page_number || '''>' || chr(10) || CASE WHEN inner_ = '' THEN '' ELSE inner_ || chr(10) END || '</div>', chr(10) || {q(PAGE_BREAK)} || chr(10) ORDER BY page_number) AS pages FROM pg GROUP BY ALL)
SELECT doc_id, '<!DOCTYPE html>' || chr(10) || '<html>' || chr(10) || '<head>' || chr(10) || '  <title>Doc &amp; ' || doc_id || '</title>' || chr(10) || {q(HEAD_STYLE)} || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || pages || chr(10) || '</body>' || chr(10) || '</html>' AS html FROM dc"""


def _color() -> str:
    b = lambda v: f"lpad(lower(to_hex(trunc({v})::INT)), 2, '0')"
    held = lambda i: f"(greatest(0.0::DOUBLE, least(1.0::DOUBLE, s[{i}])) * 255)"
    ink = lambda i: f"(255 * (1 - s[{i}]) * (1 - s[4]))"
    return f"""WITH a AS (SELECT p_partkey, [(p_partkey % 9) / 8.0::DOUBLE, (p_partkey * 2 % 9) / 8.0::DOUBLE, (p_partkey * 5 % 9) / 8.0::DOUBLE, (p_partkey * 7 % 9) / 8.0::DOUBLE][1:[1, 3, 4, 2][p_partkey % 4 + 1]] AS s FROM part)
SELECT p_partkey, CASE len(s) WHEN 3 THEN '#' || {b(held(1))} || {b(held(2))} || {b(held(3))} WHEN 1 THEN '#' || {b(held(1))} || {b(held(1))} || {b(held(1))} WHEN 4 THEN '#' || {b(ink(1))} || {b(ink(2))} || {b(ink(3))} ELSE '#000000' END AS color FROM a"""


def _chunk_fold() -> str:
    return f"""WITH {LINES},
a AS (SELECT doc_id, list({{'n': length(line)::BIGINT, 'at': [line_no]}} ORDER BY line_no) AS rs FROM lines WHERE line <> '' GROUP BY ALL),
b AS (SELECT doc_id, list_reduce(rs, lambda x, y: CASE WHEN x.n + y.n > 8000 THEN {{'n': y.n, 'at': list_concat(x.at, y.at)}} ELSE {{'n': x.n + y.n, 'at': x.at}} END).at AS starts FROM a)
SELECT doc_id, line_no::INT AS pos, length(line)::INT AS n, (len(list_filter(starts, lambda v: v <= line_no)) - 1)::INT AS chunk FROM lines JOIN b USING (doc_id) WHERE line <> ''"""


def _features() -> str:
    from quire.functions.layout import LEGAL_TERMS, MODALS

    w = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{Nd}'']+'), lambda w: w <> '')"
    s = "list_filter(regexp_split_to_array(lower(text), '[.!?]+'), lambda s: regexp_matches(s, '\\S'))"
    terms = lambda t: "[" + ", ".join(f"'{x}'" for x in t) + "]"
    be = "(^|[^\\p{L}\\p{Nd}''])(is|are|was|were|be|been|being|am) [\\p{L}\\p{Nd}'']*(ed|en)($|[^\\p{L}\\p{Nd}''])"
    return f"""WITH a AS (SELECT doc_id, {w} AS w, {s} AS s FROM documents), b AS (SELECT *, len(w) AS n, greatest(len(s), 1) AS m FROM a)
SELECT doc_id, CASE WHEN n > 0 THEN round_even(n / m, 6) ELSE 0.0 END AS avg_sentence_length, CASE WHEN n > 0 THEN round_even(len(list_filter(w, lambda x: list_contains({terms(MODALS)}, x))) / n, 6) ELSE 0.0 END AS modal_density,
 CASE WHEN n > 0 THEN round_even(len(list_filter(s, lambda x: regexp_matches(x, '{be}'))) / m, 6) ELSE 0.0 END AS passive_ratio, CASE WHEN n > 0 THEN round_even(len(list_filter(w, lambda x: list_contains({terms(LEGAL_TERMS)}, x))) / n, 6) ELSE 0.0 END AS legal_term_density FROM b"""


def _display() -> str:
    from quire.operators.tree import COLORS, DEFAULT_COLOR, DEFAULT_ICON, ICONS

    case = lambda t, d: "CASE block_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE '{d}' END"
    chip = lambda k, v: f"'<span class=\"property-chip\">🏷 {k}: ' || {v} || '</span>'"
    return f"""WITH {TREE}, a AS (SELECT *, {case(COLORS, DEFAULT_COLOR)} AS c, {case(ICONS, DEFAULT_ICON)} AS icon FROM tree WHERE len(path) = 1)
SELECT doc_id, id, '<span class="block-badge" style="background: ' || c || '15; color: ' || c || '; border: 1px solid ' || c || '30;"><span class="block-badge-dot" style="background: ' || c || ';"></span>' || block_type || '</span>' AS badge, icon,
 {chip("blockquote", "blockquote::VARCHAR")} || CASE WHEN list_type IS NULL THEN '' ELSE ' ' || {chip("list_type", "list_type")} END AS chips, CASE WHEN length(content) > 100 THEN least(200, greatest(80, length(content) // 2)) END::INT AS height FROM a"""


BOX_COLS = "text, x0, y0, x1, y1, fontname, size, color"

ORACLES: dict[str, str] = {
    "chars_filtered": f"WITH {FILTERED} SELECT doc_id, page_number, fontname, count(*) AS n_chars, max(size) AS size, sum(char_idx)::BIGINT AS sum_idx FROM kept GROUP BY ALL",
    "color_hex": _color(),
    "words_gap_cluster": f"WITH {WORDS} SELECT doc_id, page_number, word_idx, {BOX_COLS} FROM words",
    "lines_anchor_cluster": f"WITH {MADE_LINES} SELECT doc_id, page_number, line_idx, {BOX_COLS} FROM made",
    "blocks_merge": f"WITH {BLOCKS} SELECT doc_id, page_number, block_idx, {_id('doc_id', 'page_number', chr(39) + 'block' + chr(39), 'block_idx')} AS id, {BOX_COLS} FROM blocks",
    "dominant_font": f"WITH {CHARS}, p AS (SELECT doc_id, fontname, count(*) AS n, min(page_number * 1000000 + char_idx % 3900) AS f0, min([page_number, char_idx]) AS f FROM chars GROUP BY ALL) SELECT doc_id, arg_max(fontname, [n, -f[1], -f[2]]) AS fontname, max(n) AS n FROM p GROUP BY ALL",
    "blocks_heuristic": f"WITH {BLOCKS}, g AS (SELECT *, {_guess('text', 'size', 'fontname')} AS block_type FROM blocks) SELECT doc_id, page_number, block_idx, block_type, {ROLE} AS role, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_idx) - 1)::INT AS reading_order FROM g",
    "block_type_heuristic": f"WITH {PARAS}, g AS (SELECT *, {_guess('text', 'font_size', chr(40) + 'font_name || CASE WHEN bold THEN ' + chr(39) + '-Bold' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END)')} AS block_type FROM paras WHERE kind = 'p') SELECT doc_id, elem_idx, block_type, {ROLE} AS role FROM g",
    "para_classify": f"WITH {PARAS}, g AS (SELECT doc_id, elem_idx, {CLASSIFY} AS c FROM (SELECT *, lower(style_name) AS st FROM paras WHERE kind = 'p')) SELECT doc_id, elem_idx, split_part(c, '/', 1) AS block_type, split_part(c, '/', 2) AS role FROM g",
    "style_distinct": f"""WITH {CLASSIFIED}, s AS (SELECT *, regexp_replace(fontname, '^[^+]*\\+', '') AS font_family, round_even(font_size, 1) AS size, CASE WHEN contains(lower(fontname), 'bold') THEN 'bold' ELSE 'normal' END AS weight, contains(lower(fontname), 'italic') OR contains(lower(fontname), 'oblique') AS ital, {_pick('elem_idx', '#000000', '#333333')} AS color FROM cl),
 h AS (SELECT *, left(sha256(concat_ws('|', font_family, size::VARCHAR, weight, CASE WHEN ital THEN 'True' ELSE 'False' END, color)), 12) AS style_id FROM s)
 SELECT style_id, font_family, size, weight, ital AS italic, false AS underline, color, 'left' AS align, count(*) AS n_blocks FROM h GROUP BY ALL""",
    "table_cell_grid": """WITH r AS (SELECT l_orderkey AS table_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) - 1)::INT AS row, list_filter([l_partkey::VARCHAR, l_quantity::INT::VARCHAR, ' ' || l_returnflag || ' ', CASE WHEN l_partkey % 5 = 0 THEN '*' END], lambda x: x IS NOT NULL) AS cs FROM lineitem),
 c AS (SELECT table_id, row, unnest(cs) AS text, unnest(range(len(cs)))::INT AS col FROM r), z AS (SELECT *, max(row) OVER (PARTITION BY table_id) + 1 AS n_rows, max(col) OVER (PARTITION BY table_id) + 1 AS n_cols FROM c)
 SELECT table_id, row, col, 1 AS row_span, 1 AS col_span, trim(text) AS text, n_rows, n_cols, round_even(72.0::DOUBLE + col * (468.0::DOUBLE / n_cols), 2) AS x0, round_even(72.0::DOUBLE + row * (200.0::DOUBLE / n_rows), 2) AS y0, round_even(72.0::DOUBLE + (col + 1) * (468.0::DOUBLE / n_cols), 2) AS x1, round_even(72.0::DOUBLE + (row + 1) * (200.0::DOUBLE / n_rows), 2) AS y1 FROM z""",
    "blocks_not_in_tables": f"WITH {PARA_BLOCKS}, {TABLES}, bb AS (SELECT *, 72.0::DOUBLE + 30 * block_idx AS y0 FROM pb) SELECT doc_id, page_number, block_idx, y0 FROM bb WHERE NOT EXISTS (SELECT 1 FROM tb WHERE tb.doc_id = bb.doc_id AND tb.page_number = bb.page_number AND greatest(least(540.0, tb.x1) - greatest(72.0, tb.x0), 0) * greatest(least(bb.y0 + 20, tb.y1) - greatest(bb.y0, tb.y0), 0) / greatest(468.0 * 20, 0.01) > 0.5)",
    "tag_index_join": f"WITH {MATCHED} SELECT doc_id, page_number, block_idx, block_type, role, reading_order::INT AS reading_order, matched FROM m",
    "fallback_cases": f"""WITH {CLASSIFIED}, g AS (SELECT doc_id, elem_idx, block_type AS t, role AS r, reading_order::INT AS reading_order, {_guess('text', 'font_size', 'fontname')} AS block_type FROM cl)
 SELECT 'no_vision' AS "case", doc_id, elem_idx, block_type, {ROLE} AS role, reading_order FROM g UNION ALL SELECT 'vision_error', doc_id, elem_idx, block_type, 'paragraph', reading_order FROM g
 UNION ALL SELECT 'no_tags', doc_id, elem_idx, 'paragraph', 'paragraph', reading_order FROM g UNION ALL SELECT 'docx', doc_id, elem_idx, t, r, reading_order FROM g""",
    "tag_one_step": f"WITH {MATCHED} SELECT doc_id, page_number, block_idx, id, block_type, role, reading_order::INT AS reading_order, CASE WHEN matched THEN 'index' ELSE 'default' END AS how FROM m",
    "quarantined_tags": f"""WITH {TAGS}, o AS (SELECT doc_id, page_number, tag_pos, CASE WHEN tag_pos % 7 = 0 THEN -reading_order ELSE reading_order END::INT AS reading_order FROM tags)
 SELECT doc_id, page_number, tag_pos, reading_order, CASE WHEN reading_order IS NULL THEN 'no order' WHEN reading_order < 0 THEN 'negative order' END AS problem FROM o""",
    "doc_tokens": f"""WITH {BLOCKS}, k AS (SELECT n5.doc_id, n5.page_number, block_idx, n5.text, n5.x0, n5.y0, n5.x1, n5.y1, b3.pos AS line_pos, n5.pos AS word_pos FROM n5 JOIN b3 USING (doc_id, page_number, line_idx))
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, block_idx, line_pos, word_pos) - 1)::INT AS place, text, {_BLOCK_ID} AS block_id, 's-' || {_BLOCK_ID} AS span_id, x0, y0, x1, y1, {_NORM} FROM k""",
    "doc_json_blocks": f"WITH {JSON_BLOCKS} SELECT doc_id, place, id, block_type AS type, role, page_number AS page, reading_order, 0 AS z_index, text, style_id, '<' || tag || '>' || text || '</' || tag || '>' AS html, '<' || tag || '>{{{{text}}}}</' || tag || '>' AS html_template, x0, y0, x1, y1, {_NORM} FROM jb",
    "doc_json_parts": f"""WITH {JSON_BLOCKS}, g AS (SELECT doc_id, lag(id) OVER (PARTITION BY doc_id ORDER BY place) AS f, id FROM jb)
 SELECT doc_id, 'document' AS part, doc_id::VARCHAR AS key, '3.0|pdf|' || count(DISTINCT page_number)::VARCHAR AS value FROM jb GROUP BY doc_id
 UNION ALL SELECT DISTINCT doc_id, 'page', page_number::VARCHAR, '612.0|792.0|0|pt' FROM jb
 UNION ALL SELECT doc_id, 'span', 's-' || id, id || '|' || style_id || '|' || text FROM jb
 UNION ALL SELECT DISTINCT doc_id, 'style', style_id, concat_ws('|', family, round_even(size, 1)::VARCHAR, weight, ital::VARCHAR, 'false', color, 'left') FROM jb
 UNION ALL SELECT doc_id, 'edge', f, id || '|next' FROM g WHERE f IS NOT NULL""",
    "doc_assemble_tables": f"""WITH {EMITTED}, w AS (SELECT doc_id, page_number, block_index AS block_idx, list(CASE WHEN tone <> 'angry' AND voice <> 'loud' THEN tone END ORDER BY tag_pos DESC)[1] AS tone FROM tags GROUP BY ALL)
 SELECT em.doc_id, emit_idx::INT AS place, em.id, CASE WHEN is_table = 1 THEN 'table' ELSE m.block_type END AS type, CASE WHEN is_table = 1 THEN 'table' ELSE m.role END AS role, em.page_number AS page, CASE WHEN is_table = 1 THEN emit_idx ELSE em.reading_order END::INT AS reading_order, CASE WHEN is_table = 1 THEN '[TABLE]' ELSE pb.text END AS text, CASE WHEN is_table = 0 THEN w.tone END AS tone
 FROM em LEFT JOIN m ON em.doc_id = m.doc_id AND em.id = m.id LEFT JOIN pb ON em.doc_id = pb.doc_id AND em.id = pb.id LEFT JOIN w ON em.doc_id = w.doc_id AND em.page_number = w.page_number AND em.pos = w.block_idx""",
    "marker_json_blocks": f"""WITH {TREE}, a AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS words, len(regexp_extract_all(html, '<tr\\b')) AS trs FROM tree)
 SELECT doc_id, page_number, array_to_string(list_concat([path[1] % 35], path[2:]), '.') AS path, id, block_type, words AS content, html, CASE WHEN block_type = 'SectionHeader' THEN try_cast(regexp_extract(html, '<h(\\d)', 1) AS INT) END AS heading_level, CASE WHEN block_type = 'Table' THEN trs END::INT AS row_count, CASE WHEN block_type = 'Table' AND trs > 0 THEN len(regexp_extract_all(regexp_extract(html, '(?s)<tr\\b(.*?)(</tr>|<tr\\b|$)', 1), '<t[dh]\\b')) END::INT AS column_count,
 CASE WHEN block_type = 'ListItem' THEN CASE WHEN contains(html, '<ol') THEN 'ordered' ELSE 'unordered' END END AS list_type, CASE WHEN block_type = 'Code' THEN nullif(regexp_extract(html, 'class="language-(\\w+)"', 1), '') END AS language, CASE WHEN contains(lower(html), 'blockquote') THEN true END AS blockquote,
 CASE WHEN by0 IS NOT NULL THEN 72.0::DOUBLE END AS x0, by0 AS y0, CASE WHEN by0 IS NOT NULL THEN 540.0::DOUBLE END AS x1, by0 + 12 AS y1 FROM a""",
    "docx_batch_tags": f"""WITH {CLASSIFIED}, g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY elem_idx) - 1)::INT AS gi FROM cl)
 SELECT doc_id, elem_idx, gi // 50 AS batch, gi % 50 AS batch_idx, CASE WHEN gi % 3 = 0 AND gi % 2 = 0 THEN 'caption' ELSE block_type END AS block_type, CASE WHEN gi % 3 = 0 THEN 'caption' ELSE role END AS role, CASE WHEN gi % 3 = 0 AND gi % 5 = 0 THEN 7 ELSE reading_order END::INT AS reading_order, CASE WHEN gi % 3 = 0 THEN '{{"tone":"legal"}}' END AS rhetoric FROM g""",
    "docx_batch_calls": f"""WITH {CLASSIFIED}, g AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY elem_idx) - 1)::INT AS gi FROM cl), b AS (SELECT *, gi // 50 AS batch, gi % 50 AS bi FROM g), n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, batch) % 7 = 3 AS fails FROM b), h AS (SELECT *, NOT fails AND bi % 3 = 0 AS hit FROM n)
 SELECT doc_id, elem_idx, batch::INT AS batch, bi::INT AS batch_idx, CASE WHEN hit AND length(text) >= 80 THEN 'caption' ELSE block_type END AS block_type, CASE WHEN hit THEN 'caption' ELSE role END AS role, (CASE WHEN hit AND bi % 5 = 0 THEN 7 ELSE reading_order END)::INT AS reading_order, CASE WHEN hit THEN '{{"tone":"legal"}}' END AS rhetoric, CASE WHEN fails THEN 'no answer' END AS error FROM h""",
    "export_docx": f"""WITH {TREE}, x AS (SELECT tree.*, r0.bt AS root, max(tree.page_number) OVER (PARTITION BY tree.doc_id) AS pages FROM tree JOIN r0 ON tree.doc_id = r0.doc_id AND tree.path[1] = r0.line_no),
 cells AS (SELECT doc_id, path[1] AS a, path[2] AS b, list(trim(content) ORDER BY path[3]) AS row, count(*) AS n FROM x WHERE len(path) = 3 GROUP BY ALL),
 cut AS (SELECT c.doc_id, c.a, c.b, f.n AS cols, list_slice(c.row, 1, f.n) AS have FROM cells c JOIN cells f ON c.doc_id = f.doc_id AND c.a = f.a AND f.b = 0),
 grid AS (SELECT doc_id, a, max(cols) AS n_cols, count(*) AS n_rows, string_agg(array_to_string(have, chr(31)) || repeat(chr(31), (cols - len(have))::INT), chr(30) ORDER BY b) AS cells FROM cut GROUP BY ALL),
 e AS (
  SELECT doc_id, page_number, path AS key, 'p' AS kind, CASE WHEN len(path) = 2 AND root = 'List' THEN (SELECT CASE WHEN t.list_type = 'ordered' THEN 'ListNumber' ELSE 'ListBullet' END FROM x t WHERE t.doc_id = x.doc_id AND t.path = [x.path[1]])
   WHEN block_type = 'SectionHeader' THEN 'Heading' || CASE WHEN heading_level = 0 THEN 1 ELSE heading_level END WHEN block_type = 'Code' THEN 'MacroText' WHEN block_type = 'Text' AND blockquote THEN 'Quote' ELSE '' END AS style_name,
   CASE WHEN block_type = 'Equation' THEN '[Equation] ' ELSE '' END || content AS text, 0 AS n_rows, 0 AS n_cols, '' AS cells
  FROM x WHERE block_type IN ('SectionHeader', 'ListItem') OR (block_type IN ('Text', 'Code', 'Equation') AND root <> 'Table' AND content <> '')
  UNION ALL SELECT x.doc_id, page_number, path, 'tbl', '', '', n_rows, n_cols, grid.cells FROM x JOIN grid ON x.doc_id = grid.doc_id AND path[1] = a WHERE block_type = 'Table'
  UNION ALL SELECT DISTINCT doc_id, page_number, [2147483647], 'p', '', '', 0, 0, '' FROM x WHERE page_number < pages)
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_number, key) - 1)::INT AS elem_idx, kind, style_name, text, n_rows::INT AS n_rows, n_cols::INT AS n_cols, cells FROM e""",
    "docx_tree": f"""WITH {ELEMENTS}
 SELECT doc_id, (p + 1)::INT AS page_number, o::VARCHAR AS path, 'page_' || p || '/' || bt || '/' || o AS id, bt AS block_type, CASE WHEN kind = 'tbl' THEN array_to_string(flatten(cells), ' ') WHEN lt IS NOT NULL THEN '' ELSE clean END AS content, CASE WHEN bt = 'SectionHeader' THEN 2 END AS heading_level, lt AS list_type, CASE WHEN kind = 'tbl' THEN len(cells)::INT END AS row_count, CASE WHEN kind = 'tbl' THEN len(cells[1])::INT END AS column_count FROM el WHERE pos = 0
 UNION ALL SELECT doc_id, p + 1, o || '.' || pos, 'page_' || p || '/ListItem/' || o || '_' || pos, 'ListItem', clean, NULL, NULL, NULL, NULL FROM el WHERE lt IS NOT NULL
 UNION ALL SELECT doc_id, p + 1, o || '.' || r, 'page_' || p || '/TableRow/' || o || '_r' || r, 'Text', '', NULL, NULL, NULL, NULL FROM er
 UNION ALL SELECT doc_id, p + 1, o || '.' || r || '.' || c, 'page_0/TableCell/' || o || '_r' || r || '_c' || c, 'Text', cell, NULL, NULL, NULL, NULL FROM ec""",
    "docx_cells": f"""WITH {LAID}, p AS (SELECT doc_id, elem_idx, n_rows, doc_id + elem_idx // 3 AS k, floor(y0 / 792.0)::INT AS pg, y0, y1 FROM laid WHERE kind = 'tbl'),
 t AS (SELECT doc_id, elem_idx, n_rows, pg + 1 AS page, (y0::DECIMAL(18, 2) - (pg * 792)::DECIMAL(18, 2))::DOUBLE AS y0, (y1::DECIMAL(18, 2) - (pg * 792)::DECIMAL(18, 2))::DOUBLE AS y1, list_transform(range(n_rows), lambda r: list_transform(range((k + r) % 3 + 1), lambda c: 'c' || (k + r)::VARCHAR || ' .' || c::VARCHAR)) AS cells FROM p),
 u AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY page, elem_idx) - 1)::INT AS table_no, list_max(list_transform(cells, lambda x: len(x))) AS n_cols FROM t),
 r AS (SELECT *, unnest(cells) AS rw, unnest(range(n_rows)) AS ri FROM u), c AS (SELECT *, unnest(rw) AS text, unnest(range(len(rw))) AS ci FROM r)
 SELECT doc_id, table_no, page::INT AS page, n_rows::INT AS rows, n_cols::INT AS cols, ri::INT AS row, ci::INT AS col, text, round_even(72.0::DOUBLE + ci * (468.0::DOUBLE / n_cols), 2) AS x0, round_even(y0 + ri * ((y1 - y0) / n_rows), 2) AS y0, round_even(72.0::DOUBLE + (ci + 1) * (468.0::DOUBLE / n_cols), 2) AS x1, round_even(y0 + (ri + 1) * ((y1 - y0) / n_rows), 2) AS y1 FROM c""",
    "rhetoric_validate": f"""WITH {TAGS}, v AS (SELECT *, tone <> 'angry' AND voice <> 'loud' AS ok, density <> 'x' AS fok FROM tags)
 SELECT doc_id, page_number, tag_pos, ok AS rhetoric_ok, CASE WHEN ok THEN tone END AS tone, CASE WHEN ok THEN voice END AS voice, fok AS features_ok, CASE WHEN fok THEN density::DOUBLE END AS modal_density, CASE WHEN fok THEN sentence::DOUBLE END AS avg_sentence_length FROM v""",
    "rhetoric_features": _features(),
    "docx_layout_cursor": f"WITH {LAID} SELECT doc_id, elem_idx, kind, y0, y1 FROM laid",
    "docx_paginate": f"WITH {LAID} SELECT doc_id, elem_idx, (floor(y0 / 792.0) + 1)::INT AS page_number, (y0::DECIMAL(18, 2) - (floor(y0 / 792.0) * 792)::DECIMAL(18, 2))::DOUBLE AS y0, (y1::DECIMAL(18, 2) - (floor(y0 / 792.0) * 792)::DECIMAL(18, 2))::DOUBLE AS y1 FROM laid",
    "docx_pages": f"""WITH {LAID}, n AS (SELECT d.doc_id, greatest(1, floor(coalesce(max(y1), 0) / 792.0) + 1)::INT AS n FROM documents d LEFT JOIN laid l ON d.doc_id = l.doc_id GROUP BY ALL), p AS (SELECT doc_id, unnest(range(1, n + 1))::INT AS page_number FROM n),
 c AS (SELECT doc_id, (floor(y0 / 792.0) + 1)::INT AS page_number, count(*) AS k FROM laid GROUP BY ALL) SELECT p.doc_id, p.page_number, coalesce(k, 0) AS n_rows FROM p LEFT JOIN c USING (doc_id, page_number)""",
    "docx_word_wrap": f"""WITH {LAID}, s AS (SELECT doc_id, elem_idx, font_size, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS ws FROM laid WHERE kind = 'p'),
 u AS (SELECT *, round(font_size * 0.55::DOUBLE * 1000)::BIGINT AS cw, round(font_size * 0.3::DOUBLE * 1000)::BIGINT AS gap FROM s),
 f AS (SELECT *, list_transform(list_zip(ws, range(len(ws))), lambda z: {{'x': length(z[1]) * cw + gap, 'at': [z[2]], 'w': length(z[1]) * cw}}) AS els FROM u WHERE len(ws) > 0),
 r AS (SELECT doc_id, elem_idx, ws, cw, gap, list_reduce(els, lambda a, y: CASE WHEN a.x > 468000 THEN {{'x': y.x, 'at': list_concat(a.at, y.at), 'w': y.w}} ELSE {{'x': a.x + y.x, 'at': a.at, 'w': y.w}} END).at AS starts FROM f),
 e AS (SELECT doc_id, elem_idx, cw, gap, starts, unnest(ws) AS text, unnest(range(len(ws))) AS word_idx FROM r),
 l AS (SELECT *, len(list_filter(starts, lambda v: v <= word_idx)) AS line FROM e),
 x AS (SELECT *, coalesce(sum(length(text) * cw + gap) OVER (PARTITION BY doc_id, elem_idx, line ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS x FROM l)
 SELECT doc_id, elem_idx, word_idx::INT AS word_idx, text, round(72.0::DOUBLE + x / 1000.0::DOUBLE, 2) AS wx0, round(least(72.0::DOUBLE + (x + length(text) * cw) / 1000.0::DOUBLE, 540.0::DOUBLE), 2) AS wx1 FROM x""",
    "bbox_normalize": f"WITH {PARA_BLOCKS} SELECT doc_id, page_number, block_idx, round_even(72.0::DOUBLE / 612, 6) AS nx0, round_even((72.0::DOUBLE + 30 * block_idx) / 792, 6) AS ny0, round_even(540.0::DOUBLE / 612, 6) AS nx1, round_even((92.0::DOUBLE + 30 * block_idx) / 792, 6) AS ny1 FROM pb",
    "tokens_explode": f"WITH {PARA_BLOCKS}, t AS (SELECT id, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM pb) SELECT id AS block_id, 's-' || id AS span_id, unnest(range(len(ws))) AS pos, unnest(ws) AS text FROM t",
    "reading_graph": f"WITH {EMITTED}, g AS (SELECT doc_id, lag(id) OVER (PARTITION BY doc_id ORDER BY emit_idx) AS f, id FROM em) SELECT doc_id, f AS \"from\", id AS \"to\", 'next' AS relation FROM g WHERE f IS NOT NULL",
    "table_reading_order": f"WITH {EMITTED} SELECT doc_id, page_number, id, emit_idx::INT AS reading_order FROM em WHERE is_table = 1",
    "doc_assemble_counts": f"""WITH {BLOCKS}, s AS (SELECT doc_id, page_number, block_idx, concat_ws('|', regexp_replace(fontname, '^[^+]*\\+', ''), round_even(size, 1)::VARCHAR, contains(lower(fontname), 'bold'), contains(lower(fontname), 'italic'), color) AS st FROM blocks)
 SELECT doc_id, count(DISTINCT page_number)::INT AS page_count, count(*)::INT AS n_blocks, count(*)::INT AS n_spans, (count(*) - 1)::INT AS n_edges, count(DISTINCT st)::INT AS n_styles FROM s GROUP BY ALL""",
    "page_range_a": f"""WITH {SPECS}, h AS (SELECT p_partkey, unnest(range(greatest(lo, 1), least(hi, total) + 1)) AS pg FROM sv WHERE lo IS NOT NULL AND hi IS NOT NULL), g AS (SELECT p_partkey, list_sort(list_distinct(list(pg))) AS ps FROM h GROUP BY ALL)
 SELECT sq.p_partkey, spec, total, array_to_string(coalesce(ps, range(1, total + 1)), ',') AS pages FROM sq LEFT JOIN g USING (p_partkey)""",
    "page_range_b": f"""WITH {SPECS}, h AS (SELECT p_partkey, unnest(range(lo, hi + 1)) AS pg FROM sv WHERE lo >= 1 AND hi <= total AND lo <= hi), g AS (SELECT p_partkey, list_sort(list_distinct(list(pg))) AS ps FROM h GROUP BY ALL)
 SELECT sq.p_partkey, spec, total, array_to_string(CASE WHEN trim(spec) = '' THEN range(1, total + 1) ELSE coalesce(ps, range(1, least(total, 5) + 1)) END, ',') AS pages FROM sq LEFT JOIN g USING (p_partkey)""",
    "html_headings": "SELECT page_id, trim(regexp_replace(html_unescape_(regexp_extract(html, '<h1>(.*?)</h1>', 1)), '\\s+', ' ', 'g')) AS heading FROM pages",
    "html_chunk_fold": _chunk_fold(),
    "block_pages_35": f"WITH {LINES} SELECT doc_id, line_no::INT AS ordinal, 'page_' || (line_no // 35) || '/' || {_pick('line_no', 'SectionHeader', 'Text', 'List', 'Table', 'Code', 'Equation')} || '/' || line_no AS id, 'page_' || (line_no // 35) || '/ListItem/' || line_no AS child_id, (line_no // 35 + 1)::INT AS page_number FROM lines",
    "type_counts": f"WITH {TREE} SELECT doc_id, block_type, count(*) AS n FROM tree WHERE len(path) = 1 GROUP BY ALL",
    "doc_metrics": f"WITH {TREE} SELECT doc_id, count(DISTINCT page_number) AS n_pages, count(*) FILTER (len(path) = 1) AS n_blocks, count(*) FILTER (content <> '') AS n_editable, count(DISTINCT CASE WHEN len(path) = 1 THEN block_type END) AS n_types FROM tree GROUP BY ALL",
    "flatten_tree": f"WITH {TREE} SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY path) - 1)::INT AS dfs_idx, (len(path) - 1)::INT AS depth, id, block_type, content FROM tree",
    "apply_edits": f"WITH {TREE}, {EDITS} SELECT tree.doc_id, page_number, {PATH}, id, coalesce(new_content, content) AS content FROM tree LEFT JOIN ed ON tree.doc_id = ed.doc_id AND tree.id = ed.block_id",
    "first_match_edit": f"WITH {TREE}, {EDITS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY page_number, path) AS rn FROM tree) SELECT f.doc_id, page_number, {PATH}, id, CASE WHEN rn = 1 THEN coalesce(new_content, content) ELSE content END AS content FROM f LEFT JOIN ed ON f.doc_id = ed.doc_id AND f.id = ed.block_id",
    "title_edits": f"WITH {EDITS} SELECT d.doc_id, coalesce(new_content, 'Doc & ' || d.doc_id) AS title FROM documents d LEFT JOIN ed ON d.doc_id = ed.doc_id AND block_id = '__title__'",
    "strip_html": f"WITH {TREE} SELECT doc_id, {PATH}, '{{\"id\":' || to_json(id) || ',\"block_type\":' || to_json(block_type) || ',\"content\":' || to_json(content) || ',\"list_type\":' || coalesce(to_json(list_type)::VARCHAR, 'null') || '}}' AS json FROM tree",
    "empty_template": f"WITH {TREE} SELECT doc_id, {PATH}, id, '' AS content, html FROM tree",
    "export_html": _export(),
    "doc_title": r"""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(
  lower(translate(regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/\\]*)$', 1), '(.)\.[^.]*$', '\1'), '_-', '  ')),
  '\p{L}+|\P{L}+'), lambda r: upper(r[1]) || r[2:]), '') AS title
FROM pages""",
    "format_dispatch": f"""WITH a AS (SELECT page_id, '/in/file_' || page_id || {_pick('page_id', '.PDF', '.docx', '.doc', '.html', '.png', '.pptx', '')} AS path FROM pages), b AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$')) AS ext FROM a)
 SELECT page_id, path, ext, CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.docx', '.doc') THEN 'docx' WHEN ext IN ('.html', '.htm') THEN 'html' WHEN ext IN ('.png', '.jpg', '.jpeg', '.gif') THEN 'image' WHEN ext = '.json' THEN 'json' WHEN ext IN ('.pptx', '.xlsx', '.epub') THEN 'other' ELSE 'quarantine' END AS reader FROM b""",
    "blocks_summary": f"WITH {PARA_BLOCKS} SELECT doc_id, page_number, (row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_idx) - 1)::INT AS \"index\", CASE WHEN length(text) > 120 THEN left(text, 120) || '...' ELSE text END AS text, 'Arial' AS font, 11.0::DOUBLE AS size FROM pb",
    "pdf_overlay_plan": f"WITH {TREE} SELECT doc_id, page_number - 1 AS page_index, {PATH}, by0 AS y0, content AS text, 'Helvetica' AS font, 11 AS font_size FROM tree WHERE by0 IS NOT NULL AND content <> ''",
    "display_helpers": _display(),
    "editor_view": f"""WITH {TREE}, a AS (SELECT * FROM tree WHERE len(path) = 1)
 SELECT doc_id, id, CASE WHEN length(content) > 50 THEN left(content, 50) || '...' ELSE content END AS preview, CASE WHEN length(content) > 120 THEN left(content, 120) || '...' ELSE content END AS long_preview,
 CASE WHEN by0 IS NOT NULL THEN '72.0, ' || round_even(by0, 1)::VARCHAR || ', 540.0, ' || round_even(by0 + 12, 1)::VARCHAR END AS box, block_type || CASE WHEN heading_level > 4 THEN ' → ' || id ELSE '' END AS hierarchy,
 '<div class="metric-card"><div class="metric-value" style="color: #A29BFE;">' || length(content)::VARCHAR || '</div><div class="metric-label">Characters</div></div>' AS card FROM a""",
    "quarantine_pages": "WITH a AS (SELECT o_orderkey, concat_ws(',', CASE WHEN o_custkey % 7 - 1 < 1 THEN 'page_number' END, CASE WHEN NOT coalesce(o_totalprice - 1000 > 0, false) THEN 'width' END, CASE WHEN o_orderkey % 3 = 0 THEN 'height' END) AS problems FROM orders) SELECT * FROM a WHERE problems <> ''",
    "page_counts": f"WITH {CHARS}, n AS (SELECT doc_id, count(DISTINCT page_number) AS n FROM chars GROUP BY ALL) SELECT doc_id, greatest(coalesce(n, 0), 1) AS n_pages FROM documents LEFT JOIN n USING (doc_id)",
    "conversation_graph": "SELECT conv_id, f AS from_turn, turn AS to_turn, 'next' AS relation FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM conversations) WHERE f IS NOT NULL",
    "event_props": """WITH k AS (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events), v AS (SELECT event_id, k, json_extract_string(props, '$."' || k || '"') AS v FROM k),
 g AS (SELECT event_id, string_agg(k, ',' ORDER BY k) AS keys, string_agg(k || '=' || v, ',' ORDER BY k) AS entries, '{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}' AS json FROM v GROUP BY event_id)
 SELECT event_id, keys, entries, json FROM events LEFT JOIN g USING (event_id)""",
    "stream_pages": "SELECT doc_id, ceil(len(string_split(text, chr(10))) / 20)::INT AS n_pages, md5(text) AS text_md5 FROM documents",
    "stream_documents": f"WITH f AS ({_features()}) SELECT doc_id, len(string_split(text, chr(10)))::INT AS n_lines, avg_sentence_length FROM documents JOIN f USING (doc_id)",
}

#: DuckDB has no HTML unescape: this query's pages hold &amp; and &quot; only.
ORACLES["html_headings"] = "SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS heading FROM pages WHERE regexp_matches(html, '<h1>')"

#: Characters that XML cannot hold are not in DOCX files.
SCANNED = PARAS + """,
sc AS (SELECT * REPLACE (regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x{FFFE}\\x{FFFF}]', '', 'g') AS text), (row_number() OVER (PARTITION BY doc_id ORDER BY elem_idx) - 1)::INT AS no FROM paras)"""

ORACLES["docx_scan"] = f"""WITH {SCANNED} SELECT doc_id, no AS elem_idx, kind, CASE WHEN kind = 'p' THEN style_name ELSE '' END AS style_name, text, CASE WHEN kind = 'p' THEN font_name ELSE 'Calibri' END AS font_name,
 CASE WHEN kind = 'p' THEN font_size ELSE 11.0::DOUBLE END AS font_size, kind = 'p' AND bold AS bold, kind = 'p' AND italic AS italic, '#000000' AS color, n_rows, (kind = 'tbl')::INT AS n_cols, 612.0::DOUBLE AS page_w, 792.0::DOUBLE AS page_h FROM sc"""

ORACLES["docx_html"] = f"""WITH {SCANNED}, h1 AS (SELECT *, lower(style_name) AS st, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM sc WHERE kind = 'tbl' OR trim(text) <> ''),
h2 AS (SELECT *, CASE WHEN kind = 'tbl' THEN 'table' WHEN regexp_matches(st, 'heading\\s*[1-6]') THEN 'h' || regexp_extract(st, 'heading\\s*([1-6])', 1) WHEN contains(st, 'title') THEN 'h1' WHEN contains(st, 'list') THEN 'li' ELSE 'p' END AS tag, CASE WHEN italic THEN '<em>' || t || '</em>' ELSE t END AS i FROM h1),
h3 AS (SELECT *, CASE WHEN bold THEN '<strong>' || i || '</strong>' ELSE i END AS b, lag(tag) OVER w AS before, lead(tag) OVER w AS after FROM h2 WINDOW w AS (PARTITION BY doc_id ORDER BY no))
SELECT doc_id, string_agg(CASE WHEN tag = 'table' THEN '<table>' || repeat('<tr><td><p></p></td></tr>', n_rows) || '</table>' ELSE CASE WHEN tag = 'li' AND before IS DISTINCT FROM 'li' THEN '<ul>' ELSE '' END || '<' || tag || '>' || b || '</' || tag || '>' || CASE WHEN tag = 'li' AND after IS DISTINCT FROM 'li' THEN '</ul>' ELSE '' END END, '' ORDER BY no) AS html FROM h3 GROUP BY doc_id"""

ORACLES["pdf_scan"] = f"""WITH {LINES}, p1 AS (SELECT doc_id, line_no, regexp_replace(line, '[^ -~¡-ÿ]', '?', 'g') AS line FROM lines), p2 AS (SELECT doc_id, line_no, line, unnest(range(greatest(ceil(length(line) / 90.0)::INT, 1))) AS part FROM p1),
p3 AS (SELECT doc_id, substr(line, part::INT * 90 + 1, 90) AS text, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS r FROM p2),
p4 AS (SELECT *, 792 - (r % 50 * 14 + 50) AS base FROM p3)
SELECT doc_id, (r // 50 + 1)::INT AS page_number, sum(length(text))::INT AS n_chars, md5(string_agg(text, '' ORDER BY r)) AS text_md5, round_even(max(CASE WHEN text <> '' THEN 36 + 6.0::DOUBLE * length(text) END), 2) AS x1,
 round_even(min(CASE WHEN text <> '' THEN 792 - (base - 1.57::DOUBLE + 10) END), 2) AS y0, round_even(max(CASE WHEN text <> '' THEN 792 - (base - 1.57::DOUBLE) END), 2) AS y1 FROM p4 GROUP BY doc_id, r // 50"""

ORACLES["image_text"] = "SELECT page_id AS doc_id, 1 AS page_number, to_base64(encode(html)) AS payload FROM pages"

ORACLES["page_calls"] = """WITH a AS (SELECT page_id AS doc_id, (page_id % 10 + 1)::INT AS page_number, html FROM pages)
SELECT doc_id, page_number, i::INT AS pos, 'page_' || (page_number - 1) || '/Text/' || i AS id, 'Text' AS block_type, (length(html) + i)::VARCHAR AS content FROM (SELECT *, unnest(range(page_number % 3)) AS i FROM a WHERE page_number % 7 <> 0)
UNION ALL SELECT doc_id, page_number, 0, 'page_' || (page_number - 1) || '/Error/0', 'Error', 'API Extraction failed for this page: no answer' FROM a WHERE page_number % 7 = 0"""

ORACLES["edit_gate"] = """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '{"title":"New","pages":[{"page_number":1,"blocks":[{"id":"a","block_type":"Text","content":"' || length(text) || '","children":[{"id":"b","block_type":"Text"}]}]}]}' ELSE '{"title":"Old","pages":[]}' END AS json,
 [NULL, 'json', 'block', 'page', 'block', 'block,page'][doc_id % 6 + 1] AS reasons FROM documents"""
