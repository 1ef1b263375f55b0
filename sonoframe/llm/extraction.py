"""Main text of web pages by minimum-cut labelling of their blocks.

A page falls into text blocks. Each block is a node of a graph: what speaks for content is the capacity from the source,
what speaks for boilerplate the capacity to the sink; edges between neighbouring blocks and between blocks of one parent
hold alike blocks together. The minimum cut, found by maximum flow, is the cheapest labelling; the blocks left on the
source's side are the main text.

Costs are a fixed linear rule over tag, class and role names on the block's path, length, punctuation and link density
(no labels of blocks exist to train on). What a container's name adds fades as its share of the page's text grows: a
wrapper of nearly the whole page says nothing about its blocks. A hyphenated class is one name with a part in it, and fades
sooner; one that begins like "has-" or "no-" says what stands beside it and adds nothing. Scripts, styles, comments, markup and
form fields give no blocks; they end at their own end tag, whatever stands inside.

Defined cases: a null or empty page, or one without content, gives an empty text of 0 characters; unclosed and stray tags
are closed as browsers do; repeated pages are worked out alike; an empty table gives no rows; other columns are left out.
Pages of any length are taken whole.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonoframe.llm.common import slices, table

#: One step of the scanner, as browsers read pages: a quote counts only behind an equals sign, `--!>` ends a comment as well. Nothing is read twice.
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*>|</?[a-zA-Z](?>[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+>|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+|\d+")

_RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "select", "audio", "video", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul", "button", "label", "option",
}
#: What an opening tag closes first, up to the boundary in the second set.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_BOILER_TAGS = {"nav", "aside", "footer", "form", "menu", "button", "dialog", "fieldset", "label", "option", "legend"}
_BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "contentinfo", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "outbrain", "overlay", "pager",
    "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe",
    "taboola", "tags", "toc", "toolbar", "topbar", "widget", "widgets", "complementary", "alert", "alertdialog",
}
_CONTENT_NAMES = {"article", "articlebody", "body", "content", "entry", "main", "post", "story", "text"}
_BOILER_START = re.compile(r"^(?:©|\(c\)|copyright\b|all rights reserved|cookie|subscribe|sign (?:in|up)|log ?in|share (?:this|on)|related|read more|advertisement|sponsored)", re.I)

#: Capacities of the edges between neighbours in page order, and between blocks one after the other under one parent.
NEAR, SIBLING = 0.6, 0.8


#: What a boilerplate name adds, and the shares of the page's text between which that fades to nothing, by kind of name:
#: reader comments may well be longer than the article.
MARK = 9.0
FADES = {"comments": (0.9, 0.98), "name": (0.6, 0.9), "part": (0.4, 0.7)}
_COMMENTS = {"comment", "comments", "disqus", "replies", "reply"}
_BESIDE = {"has", "no", "with", "without", "is", "not", "hide", "show"}


@dataclass
class Block:
    text: str
    linked: int
    parent: int
    content: float
    boiler: float
    marks: tuple = ()


@dataclass
class _Element:
    tag: str
    key: int
    article: bool
    marks: tuple  # (element, or the name where it is a part of a longer one, and kind) of the boilerplate names on the path
    content: float
    hidden: bool
    parts: list = field(default_factory=list)


def _named(value: str) -> tuple[str | None, str, bool]:
    """The kind of boilerplate name in a class, id or role, the whole name, and whether one names content."""
    kind, whole, content = None, "", False
    for token in value.split():
        words = _WORD.findall(token)
        if not words or words[0] in _BESIDE and len(words) > 1:
            continue
        found = _BOILER_NAMES.intersection(words)
        if found:
            this = "comments" if found & _COMMENTS else "name" if len(words) == 1 else "part"
            if kind is None or list(FADES).index(this) < list(FADES).index(kind):
                kind, whole = this, token
        elif _CONTENT_NAMES.intersection(words):
            content = True
    return kind, whole, content


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order, with their terminal costs."""
    out: list[Block] = []
    root = _Element("", 0, False, (), 0.0, False)
    stack = [root]
    text: list[str] = []
    linked = [0]
    links = 0
    key = 0
    endless: set[str] = set()

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(_costs(joined, min(linked[0], len(joined)), stack))
            text.clear()
        linked[0] = 0

    def open_element(tag: str, token: str) -> None:
        nonlocal key
        top = stack[-1]
        key += 1
        marks, content, hidden, article = top.marks, top.content, top.hidden, top.article
        kind, whole = None, ""
        if tag in ("article", "main"):
            article, content = True, max(content, 3.0)
        if tag in _BOILER_TAGS or tag == "header" and not article:
            kind = "name"
        if " " in token:
            for name, a, b, c in _ATTRIBUTE.findall(token):
                name, value = name.lower(), (a or b or c).lower()
                if name in ("hidden",) or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif name in ("class", "id", "role", "itemprop") and tag not in ("html", "body"):
                    this, name_, told = _named(value)
                    if this and not (article and tag in ("header", "h1", "h2") and not (set(_WORD.findall(value)) & _BOILER_NAMES) - {"header"}):
                        if kind is None or list(FADES).index(this) < list(FADES).index(kind):
                            kind, whole = this, name_
                    elif told:
                        content = max(content, 2.0)
        stack.append(_Element(tag, key, article, (*marks, (whole if kind == "part" else key, kind)) if kind else marks, content, hidden))

    def close(tags: set, bounds: set) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in bounds:
                return
            if stack[k].tag in tags:
                del stack[k:]
                return

    at, closed = 0, page.rfind(">")
    while at < len(page):
        if at > closed and page.startswith("<", at) and not page.startswith("<!--", at):  # no tag ends here any more
            token, at = "<", at + 1
        else:
            m = _TOKEN.match(page, at)
            token, at = m.group(), m.end()
        if token[0] != "<" or len(token) == 1:
            text.append(html.unescape(token) if "&" in token else token)
            if links:
                linked[0] += len(token)
            continue
        if token[1] in "!?":
            continue
        tag = _NAME.match(token)[1].lower()
        if token[1] == "/":
            if tag == "a":
                links = max(0, links - 1)
            elif tag in _BLOCK:
                flush()
                if tag == "p":
                    close({"p"}, {"article", "div", "section", "td", "body"})
                elif any(x.tag == tag for x in stack):
                    close({tag}, set())
            elif tag == "br":
                text.append(" ")
            continue
        if tag in _RAW:
            if not (token.endswith("/>") or tag in endless):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:  # an element that never ends is taken as empty
                    endless.add(tag)
            if tag not in ("svg", "math"):
                text.append(" ")
        elif tag == "br" or tag == "img" or tag == "wbr":
            text.append(" " if tag != "wbr" else "")
        elif tag == "a":
            links += 1
        elif tag in _BLOCK:
            flush()
            close({"p"}, {"table", "td", "div", "section", "article", "body"})
            if tag in _CLOSES:
                close(*_CLOSES[tag])
            if tag not in _VOID:
                open_element(tag, token)
    flush()
    return _weighed(out)


def _weighed(found: list[Block]) -> list[Block]:
    """Adds what names on the path make of boilerplate, by the share of the page's text below them.

    A longer name with a boilerplate word in it (as page builders give to all their boxes) is weighed by the text below all boxes of that name.
    """
    below: dict[int | str, int] = {}
    for block in found:
        for key in {key for key, _ in block.marks}:
            below[key] = below.get(key, 0) + len(block.text)
    total = sum(len(block.text) for block in found)
    for block in found:
        cost = 0.0
        for key, kind in block.marks:
            low, high = FADES[kind]
            cost = max(cost, MARK * min(1.0, max(0.0, (high - below[key] / total) / (high - low))))
        block.boiler += cost
    return found


def _costs(text: str, linked: int, stack: list[_Element]) -> Block:
    top = stack[-1]
    words = text.count(" ") + 1
    content = top.content + min(3.0, words / 12)
    boiler = 4.0 * linked / len(text) + (20.0 if top.hidden else 0.0) + 0.5
    if top.tag == "p" or top.tag in ("blockquote", "pre"):
        content += 1.0
    elif top.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        content += 0.8
    if text[-1] in ".!?…。\"”":
        content += 0.5
    if _BOILER_START.match(text) and words < 40:
        boiler += 2.5
    parent = stack[-2].key if top.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "td", "th", "dt", "dd") and len(stack) > 1 else top.key
    return Block(text, linked, parent, content, boiler, top.marks)


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut, by blocking flows over levels (Dinic).

    Flow from source straight through a node to the sink is taken off first; what is left joins nodes of unlike labels.
    Levels are distances to the nodes that still need flow; each round sends all the flow that shortest paths carry, and
    skips what it has found blocked. A node from which no needing node can be reached counts as the source's only if some
    excess reaches it; all others are the sink's.
    """
    n = len(source)
    excess = [max(0.0, a - b) for a, b in zip(source, sink)]
    need = [max(0.0, b - a) for a, b in zip(source, sink)]
    links: dict[tuple[int, int], float] = {}
    for a, b, c in edges:
        if a != b and c > 0:
            pair = (a, b) if a < b else (b, a)
            links[pair] = links.get(pair, 0.0) + c
    to, left, around = [], [], [[] for _ in range(n)]
    for (a, b), c in links.items():  # arc k and its reverse, k ^ 1
        around[a].append(len(to))
        around[b].append(len(to) + 1)
        to += [b, a]
        left += [c, c]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = [k for k in range(n) if need[k] > tiny]
        for k in queue:
            level[k] = 0
        for k in queue:
            for arc in around[k]:
                j = to[arc]
                if level[j] < 0 and left[arc ^ 1] > tiny:
                    level[j] = level[k] + 1
                    queue.append(j)
        starts = [k for k in range(n) if excess[k] > tiny and level[k] >= 0]
        if not starts:
            break
        following = [0] * n
        for start in starts:
            path: list[int] = []
            k = start
            while excess[start] > tiny:
                if need[k] > tiny:
                    flow = min([excess[start], need[k], *[left[arc] for arc in path]])
                    excess[start] -= flow
                    need[k] -= flow
                    for arc in path:
                        left[arc] -= flow
                        left[arc ^ 1] += flow
                    path, k = [], start
                    continue
                arcs = around[k]
                while following[k] < len(arcs):
                    arc = arcs[following[k]]
                    if left[arc] > tiny and level[to[arc]] == level[k] - 1:
                        break
                    following[k] += 1
                if following[k] < len(arcs):
                    path.append(arc)
                    k = to[arc]
                elif path:
                    k = to[path.pop() ^ 1]
                    following[k] += 1
                else:
                    break
    kept = [x > tiny for x in excess]
    queue = [k for k in range(n) if kept[k]]
    for k in queue:
        for arc in around[k]:
            if left[arc] > tiny and not kept[to[arc]]:
                kept[to[arc]] = True
                queue.append(to[arc])
    return kept


def main_text(page: str | None, near: float = NEAR, sibling: float = SIBLING) -> str:
    """The content blocks of a page, two line feeds between them."""
    found = blocks(page) if page else []
    if not found:
        return ""
    edges = [(k, k + 1, near) for k in range(len(found) - 1)]
    last: dict[int, int] = {}
    for k, b in enumerate(found):
        if b.parent in last:
            edges.append((last[b.parent], k, sibling))
        last[b.parent] = k
    kept = minimum_cut([b.content for b in found], [b.boiler for b in found], edges)
    return "\n\n".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """Rows (page_id, url, text, n_chars) for (page_id, url, html)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [main_text(p) for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    wanted = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return wanted.mapInArrow(kernel, "page_id long, url string, text string, n_chars long")


def op3_minimum_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
