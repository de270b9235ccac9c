"""Main text of web pages by a minimum cut over the blocks of each page.

A page is cut into blocks at its block-level tags. A classifier gives each block log-odds of being
content, from its ancestors' tags, their class and id words, its links and its words; they are its
capacity to the content side or to the boilerplate side. Blocks that follow each other are joined
by an edge, the stronger the nearer they are in the tree, and every container is a node without
costs that is joined to its children. The minimum cut, found by maximum flow, separates content
from boilerplate at the least sum of costs and cut edges.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.batches import pieces

# Tags and name words with a meaning in web pages.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas select option button textarea audio video datalist".split())
RAW = frozenset("script style textarea title".split())
#: Tags whose start ends an open paragraph.
ENDS_P = frozenset("p div article section main aside nav header footer form ul ol dl table pre blockquote h1 h2 h3 h4 h5 h6 hr figure address fieldset details".split())
OWN_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BAD_WORDS = frozenset("ad ads alert announcement advert adverts advertisement advertising banner breadcrumb breadcrumbs byline-ad comment comments commentlist consent cookie cookies copyright discuss disqus "
                      "footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion recommended "
                      "related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split())
GOOD_WORDS = frozenset("article articlebody body content entry main maincontent post story text".split())
#: First words of names that say how an element is laid out or filed, not what it is.
STATE_WORDS = frozenset("category disable disabled format has hide is js lang no not show status tag tagged with without".split())
#: Tags that are content whatever else their names say.
CONTENT_TAGS = frozenset(["article", "main"])
#: Log-odds of content for each kind of ancestor.
TAG_ODDS = {"p": 1.0, "article": 5.0, "main": 4.0, "nav": -12.0, "aside": -12.0, "footer": -12.0, "form": -12.0, "menu": -12.0, "dialog": -12.0, "fieldset": -12.0}
HEADER, HEADER_IN_ARTICLE, BAD_NAME, GOOD_NAME, HEADING = -12.0, -1.0, -12.0, 2.0, 1.0
#: Capacity between neighbours in the page (divided by their distance in the tree), and to the container.
NEXT, CONTAINER = 2.0, 0.5

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Differences of capacities that are rounding.
_LEAST = 1e-9


@dataclass
class Element:
    """An open or closed element: its place in the tree and the log-odds its tag and names give to what it holds."""

    tag: str
    parent: Element | None
    depth: int
    odds: float
    in_article: bool
    number: int = -1


@dataclass
class Block:
    parent: Element
    parts: list[str] = field(default_factory=list)
    link_chars: int = 0
    text: str = ""


def _opened(tag: str, attributes: str, parent: Element | None) -> Element:
    inside = parent is not None and parent.in_article
    odds = (HEADER_IN_ARTICLE if inside else HEADER) if tag == "header" else TAG_ODDS.get(tag, 0.0)
    if attributes and tag not in ("html", "body"):
        odds += _named(tag, attributes)
    if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        odds += HEADING
    return Element(tag, parent, parent.depth + 1 if parent else 0, odds + (parent.odds if parent else 0.0), inside or tag == "article")


def _named(tag: str, attributes: str) -> float:
    """What the names of an element speak for: a bad one only where neither its tag nor another name says content.

    A name is bad if any of its words is (`comment-list`), unless the first tells a state
    (`no-comments`, `with-sidebar`); it is good if it is a good word, or all its words are.
    """
    names = [[w.lower() for w in _PART.findall(name)] for value in _NAMES.findall(attributes) for name in unescape(value).strip("\"'").split()]
    names = [words for words in names if words and words[0] not in STATE_WORDS]
    if any(GOOD_WORDS.issuperset(words) for words in names):
        return GOOD_NAME
    if tag not in CONTENT_TAGS and any(not BAD_WORDS.isdisjoint(words) for words in names):
        return BAD_NAME
    return GOOD_NAME if any(not GOOD_WORDS.isdisjoint(words) and BAD_WORDS.isdisjoint(words) for words in names) else 0.0


def blocks(html: str) -> list[Block]:
    """The blocks with text of a page, in order; a tag that the page's end cuts off is markup."""
    root = Element("", None, 0, 0.0, False)
    at, unseen, links, position = root, 0, 0, 0
    out: list[Block] = []
    block = Block(root)

    def close() -> None:
        nonlocal block
        block.text = " ".join(unescape("".join(block.parts)).split())
        if block.text:
            out.append(block)
        block = Block(at)

    def text(piece: str) -> None:
        if piece and not unseen:
            block.parts.append(piece)
            if links:
                block.link_chars += len(piece)

    while match := _TOKEN.search(html, position):
        text(html[position:match.start()])
        position = match.end()
        closing, name, attributes = match.group(1, 2, 3) if match.group(2) else match.group(4, 5, 6)
        if not name:
            continue
        tag = name.lower()
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}\\b[^>]*(?:>|\\Z)", re.I).search(html, position)
            position = end.end() if end else len(html)
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else links + 1
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                close()
            continue
        if closing:
            up = at
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                unseen -= _hidden(at, up.parent)
                at = up.parent
        else:
            stop = OWN_KIND.get(tag, ())
            if at.tag in stop or at.tag == "p" and tag in ENDS_P:
                at = at.parent
            at = _opened(tag, attributes, at)
            unseen += tag in UNSEEN
        close()
        links = 0 if tag != "a" else links
    text(html[position:])
    close()
    return out


def _hidden(low: Element, high: Element) -> int:
    """How many elements that show no text lie from `low` up to below `high`."""
    n = 0
    while low is not high:
        n += low.tag in UNSEEN
        low = low.parent
    return n


def log_odds(block: Block) -> float:
    """How much a block by itself speaks for content."""
    words = block.text.count(" ") + 1
    odds = block.parent.odds + (1.5 if words >= 20 else 0.5 if words >= 5 else -0.5)
    if block.link_chars > 0.5 * len(block.text):
        odds -= 3.0
    if block.text[-1] in ".!?":
        odds += 0.5
    return odds


def _steps(a: Element, b: Element) -> int:
    """Edges between two elements of the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def _graph(found: list[Block]) -> tuple[list[float], list[dict[int, float]]]:
    """(capacity to content minus that to boilerplate, neighbours with capacities) of blocks, then of their containers."""
    odds = [log_odds(b) for b in found]
    near: list[dict[int, float]] = [{} for _ in found]

    def join(i: int, j: int, capacity: float) -> None:
        near[i][j] = near[i].get(j, 0.0) + capacity
        near[j][i] = near[j].get(i, 0.0) + capacity

    for i in range(1, len(found)):
        join(i - 1, i, NEXT / (1 + _steps(found[i - 1].parent, found[i].parent)))
    for i, block in enumerate(found):
        below, at = i, block.parent
        while at is not None:
            fresh = at.number < 0
            if fresh:
                at.number = len(near)
                near.append({})
                odds.append(0.0)
            join(below, at.number, CONTAINER)
            if not fresh:
                break
            below, at = at.number, at.parent
    return odds, near


def minimum_cut(odds: list[float], near: list[dict[int, float]]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut (of several, the one with least content).

    A node whose own capacity outweighs all its edges is on its side in every minimum cut: it is
    settled, and its edges become capacities of its neighbours. Maximum flow settles the rest.
    """
    odds, near = list(odds), [dict(x) for x in near]
    side: list[bool | None] = [None] * len(odds)
    waiting = deque(range(len(odds)))
    while waiting:
        i = waiting.popleft()
        if side[i] is None and abs(odds[i]) > sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, capacity in near[i].items():
                odds[j] += capacity if side[i] else -capacity
                del near[j][i]
                waiting.append(j)
    rest = [i for i, s in enumerate(side) if s is None]
    if rest:
        content = _flow_side(rest, odds, near)
        for i in rest:
            side[i] = i in content
    return side


def _flow_side(rest: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """The nodes that residual capacity reaches from the source (-1) after a maximum flow to the sink (-2).

    Flow is sent in phases: levels by distance from the source first, then along edges that go one
    level on until none does, each edge being given up once it leads nowhere. A phase looks at
    every edge a few times, and a phase's paths are longer than those of the one before.
    """
    left: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {-1: {}, -2: {}}
    for i in rest:
        if odds[i] > 0:
            left[-1][i], left[i][-1] = odds[i], 0.0
        elif odds[i] < 0:
            left[i][-2], left[-2][i] = -odds[i], 0.0
    while True:
        level, edge = {-1: 0}, [-1]
        while edge and -2 not in level:
            further = []
            for i in edge:
                for j, capacity in left[i].items():
                    if capacity > _LEAST and j not in level:
                        level[j] = level[i] + 1
                        further.append(j)
            edge = further
        if -2 not in level:
            return set(level) - {-1}
        ways, at = {i: list(left[i]) for i in level}, dict.fromkeys(level, 0)
        path = [-1]
        while path:
            i = path[-1]
            if i == -2:
                steps = list(zip(path, path[1:], strict=False))
                flow = min(left[a][b] for a, b in steps)
                for a, b in steps:
                    left[a][b] -= flow
                    left[b][a] = left[b].get(a, 0.0) + flow
                # on from before the first edge that is full
                del path[next(n for n, (a, b) in enumerate(steps) if left[a][b] <= _LEAST) + 1:]
                continue
            mine, k = ways[i], at[i]
            while k < len(mine) and not (left[i][mine[k]] > _LEAST and level.get(mine[k]) == level[i] + 1):
                k += 1
            at[i] = k
            if k < len(mine):
                path.append(mine[k])
            else:
                path.pop()
                if path:
                    at[path[-1]] += 1


def labelled(html: str) -> list[tuple[str, bool]]:
    """(text, whether it is content) of each block of a page."""
    found = blocks(html)
    if not found:
        return []
    return [(b.text, c) for b, c in zip(found, minimum_cut(*_graph(found)), strict=False)]


def main_text(html: str) -> str:
    return " ".join(text for text, content in labelled(html) if content)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every row of `pages` (page_id, url, html).

    A null html is empty, a page without content has an empty text, and an empty table gives no rows. Repeated rows and nulls in
    other columns give a row each; further columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            found = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(found, pa.string()), "n_chars": pa.array(map(len, found), pa.int64())})
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
