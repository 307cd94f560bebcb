"""HTML extraction, SentencePiece, WARC, license scans, the pipeline and the queries' SQL."""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import html_extract, licenses, warc
from quire.llm.pieces import PieceCoder, coder, decoded_column, default_model, encoded, ids_column
from quire.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Agree, please, now.</div><article><header><h1>The &amp; title</h1></header><p><b>First  line,\n with <a href="x">a link</a>.<br><p>Second&nbsp;&lt;one&gt;.</p><div class="ad">Buy, buy, buy this very long advert now.</div><ul><li>one<li>two</ul>
<table><tr><td>c1<td>c2</table><form><p>Mail me</p><input></form><section id="comments"><p>Nice post, really, I mean it, thanks.</p></section></article><aside>More, more.</aside><div id="sidebar"><p>Links, a lot.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The & title\nFirst line, with a link.\nSecond <one>.\none\ntwo\nc1\nc2"


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("  ", ""), ("<p></p>", ""), ("plain text", "plain text"), ("<article><p>cut of", "cut of"), ("<article><p>a &am", "a &am"), ("<article><p>a</p><p cla", "a"), ("<nav>x</nav>", ""), ("<article><p>1 < 2</p></article>", "1 < 2"), ('<article><p title="a>b">q</p></article>', "q")])
def test_main_text_edges(page, text):
    assert html_extract.main_text(page) == text


def test_main_text_without_article():
    paras = "".join(f"<p>This is paragraph {i}, it is long enough, and has marks. It goes on, and on.</p>" for i in range(6))
    page = f"<html><body><div class='top'><a>Home</a> <a>News</a></div><div class='links'><p>One</p><p>Two</p></div><div class='story'><h2>Head</h2>{paras}</div><div class='foot'>Imprint</div></body></html>"
    got = html_extract.main_text(page)
    assert got.startswith("Head\nThis is paragraph 0") and got.endswith("and on.") and "Home" not in got and "Imprint" not in got


def sentences(n, word="text"):
    return "".join(f"<p>Sentence {i} of the {word}, long enough to be told from menus, goes on here. And it ends.</p>" for i in range(n))


def test_main_text_beside_an_article():
    """An article that does not hold the content does not stand for the page."""
    page = f"<html><body><main><div class='story'>{sentences(90, 'story')}</div><article class='card'><p>A teaser, short, but with marks.</p></article></main></body></html>"
    got = html_extract.main_text(page)
    assert got.count("of the story") == 90 and "teaser" in got
    page = f"<html><body><article class='post-1'>{sentences(9, 'first')}</article><article class='post-2'>{sentences(4, 'second')}</article><article class='post-3'>{sentences(60, 'third')}<p>End</p></article></body></html>"
    got = html_extract.main_text(page)
    assert [got.count(f"of the {w}") for w in ("first", "second", "third")] == [9, 4, 60] and got.endswith("\nEnd")


@pytest.mark.parametrize("n", [20, 300])
def test_main_text_beside_the_body(n):
    """Content beside the longest element is kept, however long that is; menus beside a long one are not."""
    lead = "<div class='lead'><p>The lead, of two hundred characters or so, says what the story is about, and who wrote it. It is a paragraph like others, only in an element of its own.</p><ul><li>x</li></ul></div>"
    page = f"<html><body><div class='top'><a>Home</a> <a>News</a></div><div class='links'><p>One</p><p>Two</p></div><h1>The title of the story</h1>{lead}<div class='story'>{sentences(n)}</div><section><p>The last section, short.</p></section><div class='foot'>Imprint</div></body></html>"
    got = html_extract.main_text(page)
    assert "The title of the story\nThe lead, of" in got and "And it ends.\nThe last section, short." in got
    assert got.count("of the text") == n and "\nx\n" in got and (n == 20 or "Home" not in got and "Imprint" not in got)


@pytest.mark.parametrize(
    "page",
    [
        "<body class='single comments-open'><h1>Head</h1>{}</body>",
        "<body><h1>Head</h1><div id=content class='with-sidebar'>{}</div></body>",
        "<body><article class='tag-social related'><h1>Head</h1>{}</article></body>",
        "<body><form action=x><div class=top><a>Home</a></div><h1>Head</h1>{}</form></body>",
        "<body><div class='widget'><h1>Head</h1>{}</div><div>Imprint</div></body>",
        "<body><main class='search'><h1>Head</h1><div class='promo'>{}</div></main></body>",
        "<body><div class='reply'><h1>Head</h1>{}</div></body>",
        "<body><div class='has-sidebar'><h1>Head</h1>{}</div><div class='sidebar'><p>Links, a lot of them.</p></div><div id=comments><p>Nice, but long, so long. It says a lot, and more than the page. Really, it does, it does.</p></div></body>",
    ],
)
def test_main_text_of_named_containers(page):
    """No name makes furniture of what holds the content; menus, sidebars and comments beside it still are."""
    got = html_extract.main_text(page.format(sentences(6)))
    assert got.count("of the text") == 6 and "Head" in got and "Links" not in got and "Nice" not in got
    rest = "".join(f"<p>Comment {i}, which is longer than the page, by far, and goes on and on. Yes, it does, on and on.</p>" for i in range(20))
    assert "Comment" not in html_extract.main_text(f"<body><article>{sentences(6)}</article><div class='related'>{rest}</div></body>")
    assert "Comment" not in html_extract.main_text(f"<body><div class='story'>{sentences(6)}</div><div id='comments'>{rest}</div></body>")


LONG = "A sentence of the text, which goes on. And a second one, too. " * 4


def test_unseen_elements():
    page = f"<article><p hidden>secret</p><p style='color:red; display: none'>x1</p><p aria-hidden=true>x2</p><p title='hidden'>{LONG}</p><p class=hidden>seen</p><div hidden=''><p>{LONG}</p></div><p style=\"visibility:hidden\">x3</p><p title=\"style='display:none'\">seen too</p></article>"
    assert html_extract.main_text(page).split("\n") == [LONG.strip(), "seen", "seen too"]


def test_inline_elements_end_no_block():
    page = "<article><p>alpha <button>x</button> beta <svg viewBox='0 0'><g><text>q</text></g><path/></svg> gamma <span hidden>no<b>o</b></span>delta <select><option>1<option>2</select>end <math><mi>x</mi></math>.</p><p>next <canvas>c</canvas></p></article>"
    assert html_extract.main_text(page) == "alpha beta gamma delta end .\nnext"
    assert html_extract.main_text(f"<article><p>{LONG}</p><div><button>open<p>in it</p></div><p>{LONG}</p></article>").count("\n") == 1


def test_leads():
    body = f"<div class=b><p>{LONG}</p><p>{LONG}</p></div>"
    assert html_extract.main_text(f"<body><div class=lead><p>Lead text without marks</p></div>{body}</body>").startswith("Lead text without marks\nA sentence")
    assert html_extract.main_text(f"<body><div class=top><p><a href=1>Home page here</a> <a>About</a></p></div>{body}</body>").startswith("A sentence")
    assert html_extract.main_text(f"<body><span>Loose words before it</span><ul><li>One two three</li></ul>{body}</body>").startswith("A sentence")


def test_replies_by_structure():
    story = f"<div class=post><p>{LONG}</p><p>{LONG}</p></div>"
    reply = lambda who, inner="": f"<div class=c><p class=m>{who}</p><p>{LONG * 3}</p>{inner}</div>"
    alone = html_extract.main_text(f"<body>{story}</body>")
    many = reply("Ann on 3 May 2024") + reply("Bob at 10:30") + reply("Eve, 2 days ago")
    assert html_extract.main_text(f"<body>{story}<section id=xyz>{many}</section></body>") == alone
    assert html_extract.main_text(f"<body>{story}<section id=xyz>{reply('Ann, 3 May', reply('Bob, 4 May'))}</section></body>").startswith(alone)
    assert html_extract.main_text(f"<body>{story}<section id=discussion>{reply('Ann, 3 May')}</section></body>") == alone
    assert html_extract.main_text(f"<body>{story}<section id=discussion>{reply('Ann')}{reply('Bob')}</section></body>") == alone
    paper = html_extract.main_text(f"<article><h1>T</h1><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>{LONG}</p><p>{LONG}</p></section></article>")
    assert "Discussion" in paper and paper.count("A sentence") == 12
    parts = "".join(f"<section class=s><h2>Part {i}</h2><p>{LONG}</p></section>" for i in range(4))
    assert html_extract.main_text(f"<article><h1>T</h1>{parts}</article>").count("Part ") == 4
    asked = "".join(f"<div class=qa><p class=q>What is question {i}?</p><p>{LONG}</p></div>" for i in range(4))
    assert html_extract.main_text(f"<article><p>{LONG}</p>{asked}</article>").count("question") == 4


def test_main_text_of_pages(spark):
    """The tables' pages have one article of h1 and p: brute force by pattern."""
    import html as h

    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        m = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        parts = re.split(r"</?p>|</?h1>", m[1] if m else "")
        want = "\n".join(x for x in (re.sub(r"[ \n]+", " ", h.unescape(re.sub(r"<[^>]*>|<[^>]*$", "", p))).strip() for p in parts) if x)
        assert html_extract.main_text(r.html) == want


def test_ratios_by_brute_force():
    """Mean length and marks per node of a path, smoothed over five nodes of the same kind, fused, averaged per path."""
    import math

    a, b, c = ("body", "article", "p"), ("body", "article", "h1"), ("body", "nav")
    nodes = [(c, "Home, x", 0.002), (b, "Head", 1.0), (a, "One, two. Three.", 1.0), (a, "Four", 1.0), (c, "More", 0.002)]
    length, marks = {a: (16 + 4) / 2, b: 4.0, c: (7 + 4) / 2}, {a: 3.5 / 2, b: 0.5, c: 1.5 / 2}

    def smooth(values, i):
        w = {d: math.exp(-d * d / 2) for d in range(-2, 3) if 0 <= i + d < len(values)}
        return sum(w[d] * values[i + d] for d in w) / sum(w.values())

    want = {}
    for kind in ([b, a, a], [c, c]):
        for i, p in enumerate(kind):
            want.setdefault(p, []).append(math.sqrt(smooth([length[x] for x in kind], i) * smooth([marks[x] for x in kind], i)) * (0.002 if p == c else 1))
    got = html_extract.fused_ratios(nodes)
    assert set(got) == set(want) and all(abs(got[p] - sum(v) / len(v)) < 1e-12 for p, v in want.items())
    assert html_extract._content(nodes) == {a, b}


@pytest.mark.parametrize("ratio", [lambda p: 1.0, lambda p: random.Random(repr(p)).random()])
def test_ratios_decide(spark, monkeypatch, ratio):
    """With constant or random ratios the texts are others, on the tables' pages and without an article."""
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    n = len(pages)
    pages += [x.replace("<article>", "<div>").replace("</article>", "</div>") for x in pages]
    right = [html_extract.main_text(x) for x in pages]
    assert sum(a == b for a, b in zip(right[:n], right[n:], strict=True)) >= 0.95 * n  # an advert can outweigh a page of one line
    monkeypatch.setattr(html_extract, "fused_ratios", lambda nodes: {p: ratio(p) for p, _, _ in nodes})
    changed = [html_extract.main_text(x) != t for x, t in zip(pages, right, strict=True)]
    assert sum(changed[:n]) > n / 3 and sum(changed[n:]) > n / 3


@pytest.mark.parametrize("name", ["right-sidebar", "has-header", "search-results", "with-comments", "single"])
def test_no_name_of_the_body_hides_a_page(name):
    page = f"<body class='{name}'><article><h1>Head</h1>{sentences(5)}<p class='share'>{sentences(1, 'leaf')[3:-4]}</p><p id='side'>{sentences(1, 'other')[3:-4]}</p><p class='tags'>Share</p></article></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Head\nSentence 0") and got.count("of the text") == 5 and "of the leaf" in got and "of the other" in got and not got.endswith("Share")


def test_html_tables(spark):
    """Empty tables, repeated and null rows, clashing columns, very long pages."""
    long = f"<article>{sentences(4000)}</article>"
    rows = [(1, "u", "<p>a</p>", "x", 3), (1, "u", "<p>a</p>", "x", 3), (None, None, None, None, None), (2, "v", long, "x", 1)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = docs.select("page_id", html_extract.main_text_column().alias("text")).collect()
    assert [r.text for r in got][:3] == ["a", "a", ""] and got[3].text.count("\n") == 3999
    assert docs.limit(0).select(html_extract.main_text_column()).count() == 0


def texts():
    rng = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "<s>", "<0x41>", "ing", ".", "\x00", "​", "1", "ß"]
    return [None, "", " ", "  ", "▁", "a ", " a", "a  b", *["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(600)], "x" * 3000, "word " * 5000]


@pytest.mark.parametrize("limit", [500_000, 50])
def test_pieces_equal_the_library(limit):
    c = PieceCoder(default_model(), limit)
    assert c.apart
    for t, (ids, decoded) in zip(texts(), c.encode_all(texts()), strict=True):
        want = [1, *c.sp.encode(t or ""), 2]
        assert ids.tolist() == want, t
        assert decoded.decode() == c.sp.decode(want), t


def test_decoding_follows_the_ids(monkeypatch):
    """One wrong id in the table changes what its texts decode to, as it would in the library."""
    c = PieceCoder(default_model())
    own = c._segment

    def spoiled(chunks):
        flat, lens = own(chunks)
        k = chunks.index("word")
        flat[lens[:k].sum()] = c.sp.piece_to_id("▁the")
        return flat, lens

    monkeypatch.setattr(c, "_segment", spoiled)
    found = list(c.encode_all(["a word here", "no such", "word", "漢 word"]))
    for ids, decoded in found:
        assert decoded.decode() == c.sp.decode(ids.tolist())
    assert [d.decode() for _, d in found] == ["a the here", "no such", "the", "漢 the"]


def test_pieces_columns(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts()[:100])], "doc_id long, text string, tokens string")
    sp = coder(default_model()).sp
    for r in encoded(docs.union(docs), ids=True).select("_doc.*", F.col("tokens").alias("made")).withColumn("own", ids_column()).withColumn("back", decoded_column("own")).collect():
        want = [1, *sp.encode(r.text or ""), 2]
        assert r["tokens"] == "clash"
        assert r.own == want == r.made.ids and r.back == sp.decode(want) and r.made.n_tokens == len(want)
        assert r.made.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r.made.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert encoded(docs.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, payload string, n int"


def pages():
    return [(3, "u3", "<p>é</p>", "x", 1), (1, "u1", "<p>é</p>", "x", 1), (2, "u\r\n2", None, "x", 1), (4, None, "", "x", 1), (5, "u5", "a\r\n\r\nWARC/1.1\r\nx", "x", 1), (None, "u6", "<p>é</p>", "x", 1), (7, "u7", "only", "x", 1), (7, "u7", "only", "x", 1), (8, "big", "y" * 300_000, "x", 1)]


def test_warc_round_trip(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    warc.write_warc(spark.createDataFrame(pages(), PAGES), path)
    rows = warc.read_warc(spark, path).collect()
    assert all(r.kind == "record" for r in rows) and len(rows) == len(pages())
    payload = {p: (h or "").encode() for p, _, h, *_ in pages()}
    got = {}
    for r in rows:
        data = payload[r.page_id]
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.record_type == "revisit" or bytes(r.payload) == data
        got.setdefault(r.page_id, []).append((r.record_type, r.refers_to))
    assert {k: sorted(v, key=str) for k, v in got.items()} == {3: [("revisit", 1)], 1: [("response", None)], 2: [("response", None)], 4: [("revisit", 2)], 5: [("response", None)], None: [("revisit", 1)], 7: [("response", None), ("revisit", 7)], 8: [("response", None)]}
    assert len({r.record_id for r in rows}) == len(rows)
    warc.write_warc(spark.createDataFrame([], PAGES), path + "2")
    assert warc.read_warc(spark, path + "2").filter("kind = 'record'").count() == 0


def test_warc_repeated_rows_and_size_classes(spark, tmp_path, monkeypatch):
    """Many equal rows have one response; archives stay under ROLL bytes of payload or hold one record."""
    monkeypatch.setattr(warc, "ROLL", 4000)
    monkeypatch.setattr(warc, "CLASSES", (100, 1000))
    rows = [(1, "a", "same")] * 40 + [(1, "b", "same")] * 3 + [(2, "c", "same"), (9, None, None)] + [(100 + i, "d", "x" * (i * 30)) for i in range(60)] + [(500, "e", "y" * 9000)]
    path = f"file://{tmp_path}/out"
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(rows) == len({r.record_id for r in got})
    same = [r for r in got if r.page_id in (1, 2)]
    assert [(r.page_id, r.url) for r in same if r.record_type == "response"] == [(1, "a")] and all(r.refers_to == 1 for r in same if r.record_type == "revisit")
    per = {}
    for r in got:
        per.setdefault(r.archive, []).append(r.payload_bytes if r.record_type == "response" else 0)
    assert all(sum(v) <= 4000 or len(v) == 1 for v in per.values())


def record(payload: bytes, n: int) -> bytes:
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    digest = base64.b32encode(hashlib.sha1(block).digest())
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (n, digest, len(block), block)


@pytest.mark.parametrize("packed", [False, True])
def test_salvage(packed):
    wrap = gzip.compress if packed else bytes
    parts = [wrap(record(b"payload %d" % i * 20, i)) for i in range(8)]
    bad = bytearray(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(9)]
    for i in (2, 5):  # a flipped byte inside the record
        bad[starts[i] + len(parts[i]) // 2] ^= 0xFF
    data = b"garbage" + bytes(bad) + wrap(record(b"tail", 9))[:40]
    found = list(warc.salvage(data))
    assert [int(f[3]["warc-record-id"][10:-1]) for f in found if f[0] == "record"] == [0, 1, 3, 4, 6, 7]
    gaps = [(f[1], f[2]) for f in found if f[0] == "gap"]
    assert gaps == [(0, 7), (starts[2] + 7, starts[3] + 7), (starts[5] + 7, starts[6] + 7), (starts[8] + 7, len(data))]
    assert all(f[5] for f in found if f[0] == "gap")


def test_salvage_takes_no_quoted_record():
    """A whole record quoted in a page whose payload is damaged is no record."""
    quoted = record(b"quoted", 77)
    parts = [bytearray(record(b"one " + quoted + b" end", 1)), record(b"two", 2)]
    parts[0][-20] ^= 0xFF
    data = b"".join(map(bytes, parts))
    found = list(warc.salvage(data))
    assert [(f[0], f[1], f[2]) for f in found] == [("gap", 0, len(parts[0])), ("record", len(parts[0]), len(data))]
    in_text = record(b"a WARC/1.1 line, WARC/1.0 and more", 1).replace(b"Content-Length: ", b"Content-Length: x")
    found = list(warc.salvage(record(b"zero", 0) + in_text + record(b"two", 2)))
    assert [f[0] for f in found] == ["record", "gap", "record"]


def test_salvage_of_members(monkeypatch):
    """Members of many records, damaged ones, ones over the held size, and false marks: what is right comes back, in linear time."""
    import time

    many = gzip.compress(b"".join(record(b"m%d" % i * 50, i) for i in range(100)))
    cut = many[: len(many) // 2]
    data = many + cut + gzip.compress(record(b"after", 500)) + warc.GZIP * 50 + record(b"plain", 501) + gzip.compress(b"no record") + gzip.compress(record(b"last", 502))
    ids = lambda f: [int(x[3]["warc-record-id"][10:-1]) for x in f if x[0] == "record"]
    assert ids(warc.salvage(data)) == [*range(100), 500, 502]  # nothing tells that a record follows the false marks
    monkeypatch.setattr(warc, "HOLD", 1000)
    monkeypatch.setattr(warc, "CHUNK", 500)
    assert ids(warc.salvage(many + gzip.compress(record(b"after", 500)))) == [*range(100), 500]
    monkeypatch.undo()

    def took(n):
        data = b"".join(gzip.compress(record(os.urandom(3000), i), 1) for i in range(n))
        began = time.process_time()
        assert sum(1 for _ in warc.salvage(data)) == n
        return time.process_time() - began

    took(200)
    assert took(16000) < 30 * took(1600)


def brute_scan(text, templates, least=0.8):
    def shingles(t):
        w = [x.strip(licenses.OUTER) for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower())]
        w = [x for x in w if x]
        return ({" ".join(w)} if w else set()) if len(w) < 5 else {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    have = shingles(text)
    return {(i, round(len(shingles(t) & have) / len(shingles(t)), 6)) for i, t in templates if shingles(t) and len(shingles(t) & have) / len(shingles(t)) >= least}


def test_license_scan(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = [(None, None), (1, ""), (2, "MIT"), (3, "released UNDER the\nMIT   license"), (3, "released UNDER the\nMIT   license")]
    for i in range(150):
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randrange(150))) for _ in range(2))
        _, text = rng.choice(licenses.TEMPLATES)
        t = text.split()
        for _ in range(rng.choice([0, 0, 1, 2])):
            t[rng.randrange(len(t))] = "changed"
        rows.append((100 + i, f"{before} {' '.join(t)} {after}"))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, words string, key int")
    got = sorted((str(r.doc_id), r.template_id, round(r.containment, 6)) for r in licenses.scan(docs).collect())
    want = sorted((str(i), *m) for i, t in rows for m in brute_scan(t, licenses.TEMPLATES))
    assert got == want and len(want) > 100
    own = spark.createDataFrame([("short", "all rights reserved"), ("word", "unlicense"), ("four", "see the license file"), ("none", "..."), ("null", None)], "template_id string, text string")
    few = spark.createDataFrame([(1, "All rights reserved."), (2, "no"), (3, "x y z all rights reserved by us today, (UNLICENSE)"), (4, "rights reserved all"), (5, "Do see the license file.")], "doc_id long, text string")
    assert sorted((r.doc_id, r.template_id) for r in licenses.scan(few, own).collect()) == [(1, "short"), (3, "short"), (3, "word"), (5, "four")]
    assert licenses.scan(docs.limit(0)).count() == 0
    assert licenses.scan(docs, own.limit(0)).count() == 0


def test_scattered_licenses(spark):
    """Every notice and some full texts, cut into one to four passages with other words between, in order and not: no match is lost."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [(i, t) for i, t in licenses.TEMPLATES if i.endswith("-notice") or i in ("mit-text", "bsd-3-clause-text", "gpl-3.0-text", "zlib-text")]
    rows = []
    for _, text in texts:
        for cuts in range(4):
            for mixed in (False, True):
                t = text.split()
                at = sorted(rng.sample(range(1, len(t)), cuts)) if len(t) > 8 else []
                parts = [t[i:j] for i, j in zip([0, *at], [*at, len(t)], strict=True)]
                if mixed:
                    rng.shuffle(parts)
                rows.append((len(rows), " ".join(" ".join(rng.choice(words) for _ in range(150)) + " " + " ".join(p) for p in parts)))
    rows.append((len(rows), " ".join(rng.choice(words) for _ in range(200_000)) + " " + dict(licenses.TEMPLATES)["isc-notice"]))
    got = {(r.doc_id, r.template_id) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    def shingles(t):
        w = [x for x in (y.strip(licenses.OUTER) for y in re.split(r"[\x20\x09-\x0D]+", t.lower())) if x]
        return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)}

    have = [(i, shingles(t)) for i, t in rows]
    own = [(k, shingles(t)) for k, t in licenses.TEMPLATES]
    want = {(i, k) for k, s in own for i, h in have if len(s & h) / len(s) >= 0.8}
    assert got == want and len(want) > 150


def test_common_licenses_are_found(spark):
    texts = dict(licenses.TEMPLATES)
    assert len(texts) == len(licenses.TEMPLATES)
    lines = {
        "mit": "This work is licensed under the MIT License",
        "cc-by-4.0": "Text is available under a Creative Commons Attribution 4.0 International License.",
        "cc-by-sa-3.0": "Released under CC BY-SA 3.0, see below.",
        "agpl-3.0": "It is free under the terms of the GNU Affero General Public License.",
        "apache-2.0": "Distributed under the Apache License 2.0 as it is.",
        "bsd-3-clause": "Available under the 3-Clause BSD License.",
        "epl-2.0": "It is under the Eclipse Public License 2.0 now.",
        "mpl-2.0": "See the terms of the Mozilla Public License, v. 2.0, please.",
    }
    whole = ["apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "cc0-1.0", "cc-by-sa-4.0", "epl-1.0", "unlicense"]
    rows = [*((f"{k}-line", t) for k, t in lines.items()), *((f"{k}-text", f"Some words before. {texts[f'{k}-text']} And after.") for k in whole)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    found = {i: {r.template_id for r in got if r.doc_id == i} for i, _ in rows}
    assert all(any(t.startswith(i) for t in found[i]) for i, _ in rows), found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted(repr(tuple(r[cols.index(c)] for c in df.columns)) for r in cur.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline(spark):
    """Each stage on its own input against brute force; the run is the stages in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_doc", F.lit(1))
    from test_exact_dedup import SPACE
    from test_simhash import brute_fingerprint, brute_groups

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "simhash", "mixing", "sentencepiece"]
    rules = spark.createDataFrame(stages["quality_rules"](spark, docs, SF).collect(), docs.schema)
    assert rules.columns == docs.columns and 0 < rules.count() < docs.count()
    exact = spark.createDataFrame(stages["exact_dedup"](spark, rules, SF).collect(), docs.schema)
    assert sorted(r.text.translate(SPACE) for r in exact.collect()) == sorted({r.text.translate(SPACE) for r in rules.collect()})
    near = spark.createDataFrame(stages["simhash"](spark, exact, SF).collect(), docs.schema)
    rows = sorted(exact.collect(), key=lambda r: r.doc_id)
    least = {}
    for g, r in zip(brute_groups([brute_fingerprint(r.text) for r in rows]), rows, strict=True):
        least[g] = min(least.get(g, r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in near.collect()) == sorted(least.values())
    mixed = stages["mixing"](spark, near, SF)
    assert mixed.columns == docs.columns
    tokens = stages["sentencepiece"](spark, mixed, SF)
    assert tokens.count() == mixed.count() and tokens.columns[0] == "doc_id"
    assert sorted(corpus_pipeline.run(spark, SF).columns) == sorted(tokens.columns)
