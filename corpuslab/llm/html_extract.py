"""Main text of web pages: flat text blocks, classified by a decision tree trained on a small labelled table.

A page is cut into blocks at block-level tags. A block's features are its words and link density, those of the blocks before
and after it, and what it stands in: an article, a part that holds menus, headers, footers, sidebars, forms or the
like by its tag, or one that says so in its class or id. An article within a part so named starts anew, unless the part lists other
articles; headings are not judged by their own names. The tree, fitted from TABLE, keeps or drops each block. No flag decides alone: menus
without a name fall by their link density inside an article too, running text within a form that wraps a page stays by its own and its
neighbours' words, and where no article is marked, words and links decide.

Edge cases: null or empty html gives an empty text; unclosed tags are closed as browsers close them; an unclosed comment, script or
style runs to the end; a tag without its end is text; once a quote in a tag is left open, quotes in later tags of the page hide nothing; repeated
pages are treated alike; an empty table gives an empty result; other columns are ignored. Work grows in proportion to a page's length,
however deep its elements and whatever is left open: where open elements stand is kept by tag.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's block-level elements, elements whose text is not shown, and elements without content.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SKIP = frozenset("script style noscript template iframe textarea title object svg math canvas audio video select datalist head".split())
RAW = frozenset("script style textarea title iframe noscript".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER = frozenset("nav header footer aside form menu button dialog fieldset label legend".split())
ARTICLE = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("button label legend option select summary caption td th tr tbody thead tfoot body html".split())
#: Words in a class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads adbox advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disqus "
    "footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notification outbrain pager pagination popup promo promoted "
    "promotion recommended related replies reply rail respond search share sharing shoutbox sidebar signup social sponsor sponsored subscribe subscription taboola "
    "teaser toolbar topbar tracking widget".split()
)

#: Parts that may stand beside a mark in one name, as in related-posts; a name with any other part, as in has-sidebar, marks nothing.
BESIDE = frozenset(
    "site page main top bottom left right primary secondary global social media box bar area list lists links link block section sections container wrapper wrap inner outer content "
    "post posts article articles item items btn button icon icons form text panel slot unit google col column group holder title body".split()
)
#: Marks of parts whose articles are not the page's own.
LISTS = frozenset("comment comments disqus related recommended replies reply respond teaser widget promo promoted promotion sponsored taboola outbrain".split())
#: The least share of the running words that articles hold on a page which is judged by them.
ARTICLE_SHARE = 0.2

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boiler", "marked", "heading", "page_has_article")
#: The labelled table: features in that order, and 1 for main text. Rows without an article are pages that mark none.
TABLE = (
    # paragraphs of an article, long and short, between others or at its ends
    ((60, 0.0, 80, 0.0, 40, 0.0, 1, 0, 0, 0, 1), 1), ((1, 0.0, 60, 0.0, 30, 0.0, 1, 0, 0, 0, 1), 1), ((2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0, 0, 1), 1),
    ((9, 0.0, 6, 1.0, 50, 0.0, 1, 0, 0, 1, 1), 1), ((5, 0.0, 1, 1.0, 3, 0.0, 1, 0, 0, 1, 1), 1), ((30, 0.3, 20, 0.0, 8, 0.2, 1, 0, 0, 0, 1), 1),
    ((6, 1.0, 40, 0.0, 40, 0.0, 1, 0, 0, 0, 1), 1), ((12, 0.0, 200, 0.0, 9, 0.1, 1, 0, 0, 0, 1), 1), ((400, 0.02, 0, 0.0, 10, 0.0, 1, 0, 0, 0, 1), 1),
    ((8, 0.5, 5, 0.0, 7, 0.4, 1, 0, 0, 0, 1), 1), ((3, 0.0, 300, 0.0, 12, 0.0, 1, 0, 0, 0, 1), 1), ((20, 0.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0, 1), 1),
    # in an article, but in a part of another kind
    ((8, 0.0, 60, 0.0, 60, 0.0, 1, 0, 1, 0, 1), 0), ((40, 0.0, 60, 0.0, 60, 0.0, 1, 0, 1, 0, 1), 0), ((5, 1.0, 60, 0.0, 60, 0.0, 1, 1, 0, 0, 1), 0),
    ((25, 0.0, 60, 0.0, 5, 0.0, 1, 1, 0, 0, 1), 0), ((90, 0.1, 60, 0.0, 60, 0.0, 1, 0, 1, 0, 1), 0), ((90, 0.0, 10, 0.0, 9, 0.0, 1, 1, 0, 0, 1), 0),
    ((4, 0.0, 30, 0.0, 30, 0.0, 1, 1, 0, 1, 1), 0), ((4, 0.0, 30, 0.0, 30, 0.0, 1, 0, 1, 1, 1), 0), ((2, 0.0, 8, 0.0, 3, 0.0, 1, 1, 1, 0, 1), 0),
    # menus without a name in an article, and a link among its paragraphs
    ((2, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0, 0, 1), 0), ((3, 1.0, 1, 1.0, 2, 1.0, 1, 0, 0, 0, 1), 0), ((1, 1.0, 2, 1.0, 1, 1.0, 1, 0, 0, 0, 1), 0), ((4, 0.9, 3, 1.0, 5, 0.9, 1, 0, 0, 0, 1), 0),
    ((8, 1.0, 30, 0.0, 25, 0.1, 1, 0, 0, 0, 1), 1), ((3, 1.0, 12, 0.0, 60, 0.0, 1, 0, 0, 0, 1), 1), ((5, 1.0, 2, 0.0, 40, 0.0, 1, 0, 0, 0, 1), 1), ((4, 0.8, 70, 0.0, 9, 0.0, 1, 0, 0, 0, 1), 1),
    # outside the article of a page that marks one
    ((1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0, 1), 0), ((8, 0.0, 1, 1.0, 9, 0.0, 0, 0, 1, 0, 1), 0), ((12, 0.1, 90, 0.0, 0, 0.0, 0, 1, 0, 0, 1), 0),
    ((60, 0.0, 10, 0.0, 80, 0.0, 0, 0, 0, 0, 1), 0), ((5, 0.0, 4, 0.5, 60, 0.0, 0, 0, 0, 1, 1), 0), ((30, 0.2, 0, 0.0, 30, 0.0, 0, 0, 0, 0, 1), 0),
    ((200, 0.0, 10, 0.0, 80, 0.0, 0, 1, 0, 0, 1), 0), ((45, 0.0, 3, 0.0, 20, 0.0, 0, 0, 1, 0, 1), 0), ((15, 0.0, 200, 0.0, 15, 0.0, 0, 0, 0, 0, 1), 0),
    # a page without an article: running text, and short text next to it
    ((60, 0.0, 80, 0.0, 40, 0.0, 0, 0, 0, 0, 0), 1), ((25, 0.1, 10, 0.0, 40, 0.0, 0, 0, 0, 0, 0), 1), ((120, 0.2, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0), 1),
    ((4, 0.0, 60, 0.0, 45, 0.0, 0, 0, 0, 0, 0), 1), ((7, 0.0, 3, 1.0, 60, 0.0, 0, 0, 0, 1, 0), 1), ((16, 0.0, 30, 0.0, 20, 0.1, 0, 0, 0, 0, 0), 1),
    ((9, 0.0, 40, 0.0, 25, 0.0, 0, 0, 0, 1, 0), 1), ((5, 0.0, 25, 0.0, 30, 0.0, 0, 0, 0, 0, 0), 1), ((300, 0.05, 4, 0.9, 5, 0.8, 0, 0, 0, 0, 0), 1),
    ((45, 0.0, 5, 0.0, 2, 0.0, 0, 0, 0, 0, 0), 1), ((80, 0.1, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((35, 0.0, 4, 0.2, 3, 0.3, 0, 0, 0, 0, 0), 1),
    ((70, 0.2, 2, 0.0, 1, 0.0, 0, 0, 0, 0, 0), 1), ((28, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((50, 0.3, 6, 0.5, 4, 0.6, 0, 0, 0, 0, 0), 1),
    ((2, 0.0, 35, 0.0, 30, 0.0, 0, 0, 0, 0, 0), 1), ((5, 0.0, 0, 0.0, 70, 0.0, 0, 0, 0, 1, 0), 1), ((8, 0.1, 50, 0.0, 28, 0.0, 0, 0, 0, 0, 0), 1),
    # a page without an article: short text among short and long text
    ((5, 0.0, 40, 0.0, 15, 0.0, 0, 0, 0, 0, 0), 1), ((7, 0.0, 30, 0.0, 12, 0.0, 0, 0, 0, 0, 0), 1), ((4, 0.0, 18, 0.0, 16, 0.0, 0, 0, 0, 0, 0), 1),
    ((3, 0.0, 25, 0.0, 18, 0.0, 0, 0, 0, 1, 0), 1), ((6, 0.0, 14, 0.0, 20, 0.0, 0, 0, 0, 0, 0), 1), ((5, 0.0, 60, 0.0, 10, 0.0, 0, 0, 0, 1, 0), 1),
    # a page without an article that is wrapped in a form: running text among running text
    ((120, 0.0, 100, 0.0, 90, 0.0, 0, 1, 0, 0, 0), 1), ((90, 0.0, 120, 0.1, 110, 0.0, 0, 1, 0, 0, 0), 1), ((150, 0.1, 95, 0.0, 130, 0.0, 0, 1, 0, 0, 0), 1), ((100, 0.0, 140, 0.0, 85, 0.0, 0, 1, 0, 0, 0), 1),
    # footers, sidebars and notices beside running text, by their tag
    ((8, 0.0, 124, 0.0, 0, 0.0, 0, 1, 0, 0, 1), 0), ((14, 0.0, 188, 0.0, 0, 0.0, 0, 1, 0, 0, 1), 0), ((15, 0.0, 652, 0.0, 0, 0.0, 0, 1, 0, 0, 1), 0), ((40, 0.0, 300, 0.0, 90, 0.0, 0, 1, 0, 0, 1), 0),
    ((110, 0.0, 140, 0.0, 120, 0.0, 0, 1, 0, 0, 1), 0), ((95, 0.0, 150, 0.0, 130, 0.0, 1, 1, 0, 0, 1), 0), ((10, 0.0, 130, 0.0, 0, 0.0, 0, 1, 0, 0, 0), 0), ((30, 0.0, 150, 0.0, 0, 0.0, 0, 1, 0, 0, 0), 0),
    ((45, 0.0, 400, 0.0, 30, 0.0, 0, 1, 0, 0, 0), 0), ((60, 0.0, 200, 0.0, 100, 0.0, 0, 1, 0, 0, 0), 0), ((20, 0.1, 110, 0.0, 95, 0.0, 0, 1, 0, 0, 0), 0), ((12, 0.3, 500, 0.0, 4, 1.0, 0, 1, 0, 0, 0), 0),
    ((120, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0, 0), 0), ((100, 0.0, 10, 0.0, 8, 0.0, 0, 1, 0, 0, 0), 0), ((200, 0.1, 90, 0.0, 3, 1.0, 0, 1, 0, 0, 0), 0), ((90, 0.0, 30, 0.0, 20, 0.0, 0, 1, 0, 0, 0), 0),
    # a page of little text altogether
    ((2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((6, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 1), ((4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1, 0), 1),
    ((3, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0), ((6, 0.9, 0, 0.0, 2, 1.0, 0, 0, 0, 0, 0), 0), ((5, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 0), 0), ((7, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 0, 0), 0),
    # a page without an article: lists of links, lone short text, and parts of another kind
    ((2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0, 0), 0), ((10, 0.9, 3, 1.0, 60, 0.0, 0, 0, 0, 0, 0), 0), ((4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0, 0), 0),
    ((30, 0.8, 40, 0.0, 5, 0.7, 0, 0, 0, 0, 0), 0), ((6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0), ((8, 0.6, 20, 0.0, 20, 0.0, 0, 0, 0, 0, 0), 0),
    ((60, 0.0, 60, 0.0, 60, 0.0, 0, 1, 0, 0, 0), 0), ((60, 0.0, 60, 0.0, 60, 0.0, 0, 0, 1, 0, 0), 0), ((9, 0.0, 1, 1.0, 60, 0.0, 0, 0, 1, 0, 0), 0),
    ((5, 0.0, 3, 0.2, 4, 0.0, 0, 0, 0, 0, 0), 0), ((7, 0.0, 2, 0.0, 6, 0.3, 0, 0, 0, 0, 0), 0), ((3, 0.2, 6, 0.0, 0, 0.0, 0, 0, 0, 0, 0), 0),
    ((40, 0.9, 50, 0.0, 40, 0.0, 0, 0, 0, 0, 0), 0), ((20, 0.7, 5, 0.0, 60, 0.0, 0, 0, 0, 0, 0), 0), ((4, 0.0, 8, 0.1, 5, 0.0, 0, 0, 0, 1, 0), 0),
    ((3, 0.0, 5, 0.0, 2, 0.0, 0, 1, 0, 1, 0), 0), ((3, 0.0, 2, 1.0, 4, 0.9, 0, 0, 0, 1, 0), 0), ((12, 0.5, 3, 0.9, 4, 1.0, 0, 1, 0, 0, 0), 0),
)


@dataclass
class Node:
    """A node of a fitted tree; a leaf has no feature."""

    keep: bool
    feature: int = -1
    limit: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None


def fit_tree(table=TABLE, depth: int = 8, least: int = 1) -> Node:
    """A tree by Gini impurity; ties go to the first feature and the lowest limit."""

    def grow(x: np.ndarray, y: np.ndarray, left: int) -> Node:
        node = Node(keep=bool(2 * y.sum() > len(y)))
        if left == 0 or len(set(y.tolist())) < 2:
            return node
        best = None
        for j in (6, 7, 8, 10, 9, 0, 1, 2, 3, 4, 5):
            values = np.unique(x[:, j])
            for lo, hi in zip(values[:-1], values[1:]):
                cut = (lo + hi) / 2
                side = x[:, j] <= cut
                if min(side.sum(), (~side).sum()) < least:
                    continue
                impurity = sum(2 * m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (side, ~side))
                if best is None or impurity < best[0] - 1e-9:
                    best = (impurity, j, cut)
        if best is None or best[0] >= 2 * len(y) * y.mean() * (1 - y.mean()) - 1e-9:
            return node
        side = x[:, best[1]] <= best[2]
        node.feature, node.limit = best[1], float(best[2])
        node.low, node.high = grow(x[side], y[side], left - 1), grow(x[~side], y[~side], left - 1)
        return node

    return grow(np.array([r[0] for r in table], dtype=np.float64), np.array([r[1] for r in table], dtype=np.float64), depth)


def keeps(node: Node, row) -> bool:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.limit else node.high
    return node.keep


_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    article: bool
    boiler: bool
    marked: bool
    heading: bool
    parts: list[str] = field(default_factory=list)
    linked: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    links: float = 0.0


@dataclass
class Open:
    """An open element: its tag, and whether what stands in it is in an article, a part of another kind, a marked part (as mark() says), a
    heading, or hidden; the innermost two of its articles and parts of other kinds, and the number of the latter."""

    tag: str = ""
    article: bool = False
    boiler: bool = False
    marked: int = 0
    heading: bool = False
    hidden: bool = False
    inner: tuple[str, str] = ("", "")
    parts: int = 0


class Stack:
    """Open elements, and for each tag where those of it stand: closing one looks at no other."""

    def __init__(self):
        self.items, self.at = [Open()], {}

    def push(self, item: Open) -> None:
        self.at.setdefault(item.tag, []).append(len(self.items))
        self.items.append(item)

    def last(self, tag: str) -> int:
        where = self.at.get(tag)
        return where[-1] if where else 0

    def close(self, tag: str, stop: tuple = ()) -> None:
        """Closes the innermost element of a tag and all within it, unless it stands beyond one of the tags to stop at."""
        where = self.last(tag)
        if where and all(self.last(x) < where for x in stop):
            for item in self.items[where:]:
                self.at[item.tag].pop()
            del self.items[where:]


class Tags:
    """Where tags of a page end."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = page.rfind(">")

    def end(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends here; -1 without one."""
        if at > self.last:
            return -1
        where = at
        while self.quotes:
            found = _STOP.search(self.page, where)
            if found is None or found[0] == ">":
                where = found.start() if found else -1
                break
            where = self.page.find(found[0], found.end()) + 1
            if not where:
                break
        if self.quotes and where > 0:
            return where
        # A quote that is left open: each such search runs to the end of the page, so there is only one.
        self.quotes = False
        return self.page.find(">", at)


CELLS = ("td", "th", "button")


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; those without text are left out."""
    found: list[Block] = []
    stack, tags = Stack(), Tags(page)
    current: Block | None = None
    anchors = 0
    at, n = 0, len(page)

    def text(value: str) -> None:
        nonlocal current
        top = stack.items[-1]
        if top.hidden or not value:
            return
        if current is None:
            if value.isspace():
                return
            current = Block(top.article, top.boiler, top.marked > 0, top.heading)
        current.parts.append(value)
        if anchors:
            current.linked.append(value)

    def end_block() -> None:
        nonlocal current
        if current is not None:
            current.text = " ".join(html.unescape("".join(current.parts)).split())
            if current.text:
                current.words = len(current.text.split())
                linked = sum(len(html.unescape(x).split()) for x in current.linked)
                current.links = min(1.0, linked / current.words)
                found.append(current)
        current = None

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        if lt > at:
            text(page[at:lt])
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, lt)
        end = tags.end(m.end()) if m else -1
        if end < 0:
            text("<")
            at = lt + 1
            continue
        rest, at = page[m.end() : end], end + 1
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                end_block()
            if tag == "a":
                anchors = max(0, anchors - 1)
            stack.close(tag)
            continue
        if tag in BLOCK:
            end_block()
            anchors = 0
            if tag in CLOSES_P:
                stack.close("p", CELLS if tag == "p" else (*CELLS, "li"))
            if tag == "li":
                stack.close("li", ("ul", "ol", "menu"))
            elif tag in ("dd", "dt"):
                stack.close("dd", ("dl",))
                stack.close("dt", ("dl",))
            elif tag in ("td", "th"):
                stack.close("td", ("tr", "table"))
                stack.close("th", ("tr", "table"))
            elif tag == "tr":
                stack.close("tr", ("table",))
        if tag == "a":
            anchors += 1
        if tag == "body":
            stack.close("head")
        if tag == "br":
            text(" ")
        if tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = page.find(">", last.end()) if last else -1
            at = n if stop < 0 else stop + 1
            continue
        if tag in VOID or rest.rstrip().endswith("/") and tag not in BLOCK:
            continue
        stack.push(opened(tag, rest, stack))
    end_block()
    return found


def opened(tag: str, rest: str, stack: Stack) -> Open:
    """The element that a start tag opens. rest: its attributes."""
    top = stack.items[-1]
    named: dict[str, str] = {}
    for a in _ATTRIBUTE.finditer(rest):
        named.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
    unnamed = tag in ("html", "body") or tag in HEADING
    own = 0 if unnamed else max(map(mark, (x for k in ("class", "id", "role") for x in named.get(k, "").split())), default=0)
    root = tag in ARTICLE or named.get("role") == "main"
    # The innermost part of another kind is a header within an article: its headings belong to the article.
    titled = tag in HEADING and top.parts == 1 and top.inner[1] == "header" and top.inner[0] in ARTICLE
    marked = top.marked
    if titled:
        marked = stack.items[stack.last("header") - 1].marked
    elif root and (tag == "main" or marked < 2):
        marked, own = 0, own if own == 2 else 0
    other = tag in BOILER
    inner = (top.inner[1], tag) if other or tag in ARTICLE else top.inner
    return Open(tag, top.article or root, (top.boiler or other) and not titled, max(marked, own), top.heading or tag in HEADING, top.hidden or tag in SKIP, inner, top.parts + other)


def mark(name: str) -> int:
    """Of one class, id or role: 0, or 1 if it marks what is not the article, or 2 if it marks a list of other articles."""
    parts = {p.lower() for p in _PART.findall(name)}
    if not parts & MARKS or parts - MARKS - BESIDE:
        return 0
    return 2 if parts & LISTS else 1


def rows_of(found: list[Block]) -> list[tuple]:
    """The features of each block. A page whose articles hold little of its running text is one without."""
    running = [b for b in found if not b.boiler and not b.marked and b.links < 0.5]
    has = any(b.article for b in found) and sum(b.words for b in running if b.article) >= ARTICLE_SHARE * sum(b.words for b in running)
    out = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else None, found[i + 1] if i + 1 < len(found) else None
        out.append((
            b.words, b.links, before.words if before else 0, before.links if before else 0.0, after.words if after else 0, after.links if after else 0.0,
            b.article and has, b.boiler, b.marked, b.heading, has,
        ))
    return out


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, row in zip(found, rows_of(found)) if keeps(tree, row))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text, n_chars: for each row of pages (page_id, url, html)."""
    fitted = tree or fit_tree()

    def scan(batches):
        for batch in batches:
            out = [main_text(x, fitted) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(scan, "page_id long, url string, text string, n_chars long")
