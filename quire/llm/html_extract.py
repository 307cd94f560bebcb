"""Main text of web pages by tag-path ratios.

A page is read as text nodes in order, each with its root-to-leaf path of block tags (with their class and id; inline
tags are no part of a path). Nodes of one path are aggregated: mean text length per node, and punctuation marks per
node. Both ratios are smoothed along the page with a Gaussian window over the nodes and fused (geometric mean) with what
tags and names say of the path: furniture (menus, headers, footers, sidebars, notices, adverts, forms) has a small
factor, readers' comments none. The threshold is a share of the spread of the ratios over the page's nodes without
such evidence, and a small share of their mean at least. Paths that reach it are content paths, whatever their names.

The content region is an article, else a main element, if one holds all of the content paths' text; else it is the
deepest element that holds nearly all of it, with every article that has some, and with each element beside it (or
beside what it is in) that has some. Blocks of content paths are taken wherever they are; other blocks of the region
(headings, short items) are taken too, but for furniture. Names count for less on a leaf (p, li, headings), where the
ratio decides, and not at all for an element that holds most of the content paths' text (for comments, nearly all; and,
beside an article or main element with content, only forms and names like has-sidebar), nor for body, main and article.

A lead before the region is taken if its path differs from a content path only in the class or id of one step and it has
three words or more and links are less than half of it. Readers' replies are also known by their structure: siblings of one kind, three or more or one in another, behind
the first content, most of which begin with a short line without punctuation that holds a number (who and when), no heading.
In an element named as a talk (discussion and such) one such element is enough, and its first line needs no number.

Elements that no reader sees (hidden, aria-hidden, display:none, visibility:hidden) and controls and drawings (button,
select, svg, math and such) have no text; inside a sentence they do not end its block.

Nulls and pages without text give an empty text; a null page_id is reported as null; repeated rows repeatedly; very
long pages are read whole. Markup that breaks off is closed at its end. Further columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import table

#: Elements of HTML without an end tag, of raw text, of phrasing; elements and names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = frozenset("iframe textarea title head script style".split())
MUTE = frozenset("button select option template noscript svg math canvas object".split())
FURNITURE = frozenset("nav header footer aside menu dialog".split())
NAMES = frozenset(
    "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal newsletter subscribe signup login nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget related recommended share sharing social comment comments commentlist disqus reply replies respond footer header masthead topbar toolbar pagination pager tags search form skip".split()
)
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An open element of the first kind ends when one of the second kind begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article main section div body html nav aside header footer td th".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|(?:^|\s)aria-hidden\s*=\s*["']?true|(?:^|\s)style\s*=\s*(?:"[^"]*|'[^']*|[^\s"']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
QUOTED = re.compile(r"""(?<![\s"'](?i:style)=)(?<!^(?i:style)=)(?:"[^"]*"|'[^']*')""")
ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?。、，！？；：]")
SPACE = re.compile(r"\s+")
#: Elements that no name makes furniture, names of readers' replies, and words by which a name tells of something inside.
CONTAINERS = frozenset("html body main article".split())
ADVERTS = frozenset("ad ads advert advertisement advertising adbox sponsor sponsored promo promotion cookie cookies consent newsletter subscribe login".split())
REPLIES = frozenset("comment comments commentlist disqus reply replies respond".split())
#: Names of what may hold replies or content; their structure tells.
TALK = frozenset("discussion discussions responses feedback guestbook thread opinions talk".split())
MODIFIERS = frozenset("with without has have no open opened closed enabled disabled".split())
SIGMA = 1.0
SHARE = 0.5
LEAST = 0.1
#: Factors of the ratio of furniture, and of a leaf with a name of furniture.
EVIDENCE = {"": 1.0, "leaf": 0.25, "tag": 0.002, "name": 0.002, "hint": 0.002, "replies": 0.0, "signed": 0.0}
REGION = 0.9
#: The share of the content paths' text over which a named element is no furniture; replies often outweigh an article.
MOST = 0.5
MOST_REPLIES = 0.95
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li td pre blockquote dd dt".split())
#: Siblings of one kind that can be replies, and code points of a line that tells who wrote one and when.
LEAST_REPLIES = 3
#: Words that a block before the region has at least, if it is a lead.
LEAD_WORDS = 3
BYLINE = 60


class _Block:
    __slots__ = ("path", "parts", "kinds", "ids", "linked")

    def __init__(self, path: tuple[str, ...], kinds: tuple[str, ...], ids: tuple[int, ...]) -> None:
        """ids: a number for each element of the path; linked: characters in links."""
        self.path, self.parts, self.kinds, self.ids, self.linked = path, [], kinds, ids, 0

    @property
    def hidden(self) -> bool:
        """Whether it is no text of the page at all."""
        return "hidden" in self.kinds


def _names(attrs: str) -> list[list[str]]:
    """The words of each class, id and role."""
    return [w for _, v in ATTR.findall(attrs) for x in v.strip("\"'").lower().split() if (w := [y for y in re.split(r"[^a-z0-9]+", x) if y])]


def _unseen(attrs: str) -> bool:
    """Whether an element's attributes hide it. Values other than of style do not count."""
    low = attrs.lower()
    return ("hidden" in low or "display" in low) and UNSEEN.search(QUOTED.sub(lambda m: '"true"' if m[0][1:-1].strip().lower() == "true" else '""', attrs)) is not None


def _kind(tag: str, names: list[list[str]], within: tuple[str, ...]) -> str:
    """What makes an element furniture: its tag, a name of replies, another name (on a leaf, a weak one), a hint (form, has-sidebar), or nothing."""
    own = FURNITURE, NAMES
    if any(p.split(".")[0] in ("article", "main") for p in within):
        own = FURNITURE - {"header"}, NAMES - {"header"}  # an article's own heading
    if tag in HIDDEN:
        return "hidden"
    if tag in own[0]:
        return "tag"
    if tag in CONTAINERS:
        return ""
    hits = [w for w in names if not own[1].isdisjoint(w)]
    strong = [w for w in hits if MODIFIERS.isdisjoint(w)]
    if any(not REPLIES.isdisjoint(w) for w in strong):
        return "replies"
    if strong and tag in LEAVES and all(ADVERTS.isdisjoint(w) for w in strong):
        return "leaf"
    return "name" if strong else "hint" if hits or tag == "form" else ""


def blocks(page: str) -> list[_Block]:
    """Text blocks in page order with their paths."""
    out: list[_Block] = []
    stack: list[tuple[str, str, str, int]] = []  # tag, path step, kind of furniture, number; of a muted element the step is empty
    current: _Block | None = None
    at, n, links, made = 0, len(page), 0, 0
    muted = 0  # muted elements that are open

    def text(raw: str) -> None:
        nonlocal current
        if not raw or muted:
            return
        if current is None:
            if not raw.strip(" \t\n\x0b\x0c\r"):
                return
            current = _Block(tuple(x[1] for x in stack), tuple(x[2] for x in stack), tuple(x[3] for x in stack))
            out.append(current)
        current.parts.append(raw)
        if links:
            current.linked += len(raw)

    def close(depth: int) -> bool:
        """Closes the elements from depth on; whether one of them ends a block."""
        nonlocal muted
        gone = stack[depth:]
        del stack[depth:]
        muted -= sum(not x[1] for x in gone)
        return not muted and bool(gone[0][1])

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[2] is None and not page.endswith(">", 0, m.end()):
            break  # a tag that breaks off at the end of the page
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        if closing and tag in INLINE and muted == 0:
            continue
        if closing:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None and (tag != "p" or depth == len(stack) - 1):
                if close(depth):
                    current = None
            elif not muted:
                current = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in VOID:
            if tag not in INLINE and not muted:
                current = None
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        unseen = _unseen(attrs)
        if tag in MUTE or tag in INLINE and (unseen or muted):
            if not attrs.endswith("/"):
                stack.append((tag, "", "", 0))
                muted += 1
            continue
        if tag in INLINE:
            continue
        if not muted:
            current = None
        if tag in CLOSES_P and stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        for i in range(len(stack) - 1, -1, -1):
            if tag in SIBLINGS.get(stack[i][0], ()):
                close(i)
                break
            if stack[i][0] in SCOPES:
                break
        names = _names(attrs)
        made += 1
        stack.append((tag, ".".join([tag, *sorted({x for w in names for x in w})]), "hidden" if unseen else _kind(tag, names, tuple(x[1] for x in stack)), made))
    return out


def _replies(found: list[tuple[_Block, str]], content: set[tuple[str, ...]]) -> set[int]:
    """Numbers of the elements that are readers' replies by their structure, whatever they are called."""
    first = next((i for i, (b, _) in enumerate(found) if b.path in content), len(found))
    opened: dict[int, int] = {}  # element to its first block
    inside: dict[int, int] = {}  # element to the element it is in
    step: dict[int, str] = {}
    size: dict[int, int] = defaultdict(int)
    for i, (b, _) in enumerate(found):
        for up, own, name in zip((0, *b.ids), b.ids, b.path, strict=False):
            opened.setdefault(own, i)
            inside[own], step[own] = up, name
            size[own] += 1
    families: dict[tuple[int, str], list[int]] = defaultdict(list)
    for own, name in step.items():
        if opened[own] > first and size[own] > 1:
            families[inside[own], name].append(own)
    out: set[int] = set()
    for (up, name), members in families.items():
        nested = step.get(up) == name or step.get(inside.get(up, 0)) == name
        talk = not TALK.isdisjoint(step.get(up, "").split("."))
        lines = [found[opened[x]] for x in members]
        signed = sum(len(t) <= BYLINE and (talk or any(c.isdigit() for c in t)) and not re.search(r"[.!?。！？](\s|$)", t) and b.path[-1].split(".")[0] not in HEADINGS | {"td", "th", "dt", "li", "figcaption"} for b, t in lines)
        if 2 * signed > len(members) and (len(members) >= LEAST_REPLIES or nested or talk):
            out.update(members)
    return out


def _clean(parts: list[str]) -> str:
    return SPACE.sub(" ", html.unescape("".join(parts))).strip()


def _smooth(values: list[float]) -> list[float]:
    """Gaussian window of two nodes to each side."""
    w = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(3)]
    n = len(values)
    out = []
    for i in range(n):
        top = bottom = 0.0
        for d in range(-2, 3):
            if 0 <= i + d < n:
                top += w[abs(d)] * values[i + d]
                bottom += w[abs(d)]
        out.append(top / bottom)
    return out


Node = tuple[tuple[str, ...], str, float]  # path, text, factor of its evidence


def fused_ratios(nodes: list[Node]) -> dict[tuple[str, ...], float]:
    """path to its fused ratio: smoothed text length and punctuation per node, and the factor of its evidence.

    Nodes are smoothed with their like, so that long text lifts no furniture beside it.
    """
    chars: dict[tuple[str, ...], int] = defaultdict(int)
    marks: dict[tuple[str, ...], int] = defaultdict(int)
    count: dict[tuple[str, ...], int] = defaultdict(int)
    for path, text, _ in nodes:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    top: dict[tuple[str, ...], list[float]] = defaultdict(list)
    for plain in (True, False):
        own = [(p, f) for p, _, f in nodes if (f == 1.0) == plain]
        by_length = _smooth([chars[p] / count[p] for p, _ in own])
        by_marks = _smooth([(marks[p] + 0.5) / count[p] for p, _ in own])
        for (path, factor), a, b in zip(own, by_length, by_marks, strict=True):
            top[path].append(math.sqrt(a * b) * factor)
    return {p: sum(v) / len(v) for p, v in top.items()}


def _content(nodes: list[Node]) -> set[tuple[str, ...]]:
    """The content paths: those whose ratio reaches the threshold.

    Smoothing also lifts short paths beside long ones, and on even pages the cut is low. So a path without punctuation
    counts only if it is a heading of what follows, or if its own ratio is over SHARE of the mean too.
    """
    ratios = fused_ratios(nodes)
    values = [ratios[p] for p, _, f in nodes if f == 1.0]
    if not values:
        return set()
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    cut = max(min(SHARE * spread, max(values)), LEAST * mean)
    over = {p for p in ratios if ratios[p] >= cut}
    chars: dict[tuple[str, ...], int] = defaultdict(int)
    marks: dict[tuple[str, ...], int] = defaultdict(int)
    count: dict[tuple[str, ...], int] = defaultdict(int)
    for path, text, _ in nodes:
        chars[path] += len(text)
        marks[path] += len(PUNCTUATION.findall(text))
        count[path] += 1
    out = {p for p in over if marks[p] or math.sqrt(chars[p] * 0.5) / count[p] >= max(cut, SHARE * mean)}
    for (path, _, _), (after, _, _) in zip(nodes[-2::-1], nodes[::-1], strict=False):
        if after in out and path in over and path and path[-1].split(".")[0] in HEADINGS:
            out.add(path)
    return out or over


def _regions(nodes: list[Node], content: set[tuple[str, ...]]) -> list[tuple[str, ...]]:
    """The paths of the elements that hold the content; all of content is in them."""
    weight: dict[tuple[str, ...], float] = defaultdict(float)
    total = 0.0
    for path, text, _ in nodes:
        if path in content:
            total += len(text)
            for d in range(len(path) + 1):
                weight[path[:d]] += len(text)
    for name in ("article", "main"):
        own = [p for p in weight if p and p[-1].split(".")[0] == name and weight[p] >= total]
        if own:
            return [min(own, key=len)]
    deepest: tuple[str, ...] = ()
    for p, w in weight.items():
        if w >= REGION * total and len(p) > len(deepest) and (not p or p[-1].split(".")[0] not in LEAVES):
            deepest = p
    out = {deepest, *(p for p in weight if p and p[-1].split(".")[0] == "article")}
    for p in content:
        d = next((d for d, (a, b) in enumerate(zip(p, deepest, strict=False)) if a != b), min(len(p), len(deepest)))
        if d < min(len(p), len(deepest)):
            out.add(p[: d + 1])
    return list(out)


def _nodes(found: list[tuple[_Block, str]]) -> list[Node]:
    """Nodes with the factor of their evidence. Names do not count for an element that holds most of the content."""
    content = _content([(b.path, t, 1.0) for b, t in found if "tag" not in b.kinds])
    signed = _replies(found, content)
    if signed:
        for b, _ in found:
            b.kinds = tuple("signed" if i in signed else k for i, k in zip(b.ids, b.kinds, strict=True))
    if not any(any(b.kinds) for b, _ in found):
        return [(b.path, t, 1.0) for b, t in found]
    held: dict[tuple[str, ...], int] = defaultdict(int)
    proper: dict[tuple[str, ...], int] = defaultdict(int)  # without replies
    marked: list[tuple[str, ...]] = []  # content of an article or main element that is in nothing named
    for b, t in found:
        if b.path not in content or "tag" in b.kinds:
            continue
        replies = "replies" in b.kinds or "signed" in b.kinds
        for d in range(len(b.path) + 1):
            held[b.path[:d]] += len(t)
            proper[b.path[:d]] += 0 if replies else len(t)
        if not any(b.kinds) and any(p.split(".")[0] in ("article", "main") for p in b.path):
            marked.append(b.path)

    def spared(path: tuple[str, ...], kind: str) -> bool:
        if kind in ("tag", "signed"):
            return False
        if kind == "replies":
            return held[path] >= MOST_REPLIES * held[()]
        if proper[path] <= MOST * proper[()]:
            return False
        return kind == "hint" or not marked or any(p.split(".")[0] in ("article", "main") for p in path)

    known: dict[tuple[tuple[str, ...], str], float] = {}
    out = []
    for b, t in found:
        factor = 1.0
        for d, kind in enumerate(b.kinds):
            if kind:
                p = b.path[: d + 1]
                if (p, kind) not in known:
                    known[p, kind] = 1.0 if spared(p, kind) else EVIDENCE[kind]
                factor = min(factor, known[p, kind])
        out.append((b.path, t, factor))
    return out


def _leads(found: list[tuple[_Block, str]], nodes: list[Node], content: set[tuple[str, ...]], taken: list[bool]) -> None:
    """Takes plain blocks right before what is taken whose path differs from a content path in one step's class or id."""
    first = taken.index(True)
    alike = {(p[:d], p[d].split(".")[0], p[d + 1 :]) for p in content for d in range(len(p) - 1)}  # the other step is of the same tag
    for i in range(first - 1, -1, -1):
        (block, text), (path, _, factor) = found[i], nodes[i]
        if factor != 1.0 or text.count(" ") + 1 < LEAD_WORDS or 2 * block.linked >= len(text) or not any((path[:d], path[d].split(".")[0], path[d + 1 :]) in alike for d in range(len(path) - 1)):
            return
        taken[i] = True


def main_text(page: str | None) -> str:
    """The main text of a page, blocks joined by a line feed."""
    if not page:
        return ""
    found = [(b, t) for b in blocks(page) if not b.hidden and (t := _clean(b.parts))]
    nodes = _nodes(found)
    content = _content(nodes)
    if not content:
        return ""
    regions = _regions([n for n in nodes if n[2] == 1.0], content)
    taken = [p in content or f == 1.0 and any(p[: len(r)] == r for r in regions) for p, _, f in nodes]
    if True in taken:
        _leads(found, nodes, content, taken)
    return "\n".join(t for (_, t, _), own in zip(nodes, taken, strict=True) if own)


def main_text_column(page: str = "html") -> Column:
    def extract(page: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in page.to_pylist()], pa.string())

    return F.arrow_udf(extract, "string")(F.col(page).cast("string"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text_column().alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
