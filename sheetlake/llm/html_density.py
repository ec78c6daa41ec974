"""Main text of web pages by composite text density over the DOM.

For every element the density is its characters per tag, adjusted for links:
text that is mostly link text counts for little.  The density sum of an element
adds up the densities of its children.  The element with the largest sum holds
the main text; the lowest density on the path from it to the body is the
threshold that what stands beside the path must reach to be part of the
article.  Inside the element, inside an article element and in unlinked
paragraphs and headings, short text is text; only parts that are mostly links
must reach the threshold.  An article element on the path bounds the text, the
innermost if there are more.  Elements that by name or class are not the
article (menus, forms, adverts, comments, scripts and so on) are left out
before, but not the wrapper of the article, whatever its class says, and no
inline element.  A class in which a marked word is only one of several
(``share-price``) is a hint: density decides.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import ready

# fixed values: HTML element names by role
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button input".split())
#: Elements whose name marks them; those beside the text never count as its wrapper for the text alone.
BESIDE = frozenset("nav footer aside dialog menu".split())
NAMED = BESIDE | {"form"}
#: Words of a class, id or role that mark what is not the article.
MARKED = frozenset("ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner "
                   "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toolbar "
                   "sidebar sidebars aside rail widget widgets related recommended complementary "
                   "footer footers contentinfo colophon masthead topbar "
                   "comment comments commentlist disqus replies respond "
                   "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall "
                   "share sharing social search login hidden".split())
HEADER_MARKS = frozenset("header siteheader pageheader".split())
#: Words that say what kind of box an element is, and nothing about its text: with marked words only, a name is a mark.
BOXES = frozenset("area bar block body bottom box button buttons card col column container content element field fixed footer form "
                  "global group head header heading holder icon icons inner input item items label large left link links list "
                  "main module outer page panel post posts row right section site slot small sticky text title top unit view "
                  "wrap wrapper zone article articles".split())
#: Running text: a short one without links is text all the same.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hr br".split())
#: An element of these names ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
                   "hr main menu nav ol p pre section table ul".split())
#: Names that close an open element of the same kind, and what bounds the search for it.
HEAD_ONLY = frozenset("title meta link style script base noscript template".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_TOKENS = re.compile(r"[a-z0-9]+")
#: A tag that the page's end cuts off.
_OPEN_TAG = re.compile(r"<[/!?a-zA-Z][^<>]*\Z")


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "marked", "hint", "plain", "runs", "holds", "chars", "tags", "link_chars", "link_tags", "density")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, marked: str = "") -> None:
        self.tag, self.parent, self.drop, self.marked, self.hint = tag, parent, drop, marked == "name", marked == "hint"
        self.plain, self.runs, self.holds = 0, 0, False
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def _hidden(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """Never text of the page."""
    return tag in DROPPED or any(
        name == "hidden" or name == "aria-hidden" and value == "true"
        or name == "style" and re.search(r"display\s*:\s*none", value or "") is not None for name, value in attrs)


def _marked(tag: str, attrs: list[tuple[str, str | None]], inside_article: bool) -> str:
    """Whether an element is not the article: ``name`` by its own, class, id or role, ``hint`` if that has a marked word, else empty.

    Inline elements are part of the text that they stand in, whatever their class.
    """
    if tag in NAMED or tag == "header" and not inside_article:
        return "name"
    hint = ""
    for name, value in attrs:
        if name in ("class", "id", "role") and value and tag not in INLINE and tag not in ("html", "body", "main", "article"):
            for one in value.lower().split():
                words = [w for w in _TOKENS.findall(one) if not w.isdigit()]
                marks = [w for w in words if w in MARKED or not inside_article and w in HEADER_MARKS]
                if marks and all(w in marks or w in BOXES for w in words):
                    return "name"
                if marks:
                    hint = "hint"
    return hint


class Tree(HTMLParser):
    """Builds the elements of a page; missing end tags are closed as far as the text flow needs."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.at, self.body, self.articles = self.root, None, 0
        self.open: dict[str, int] = {}  # open elements by name

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if tag not in HEAD_ONLY and tag != "head":
            self._close({"head"}, set())
        if tag in ENDS_P:
            self._close({"p"}, {"button", "td", "th", "table", "object"})
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        if tag == "body":
            if self.body is None:
                self._up_to_root()
                self.body = Node("body", self.root)
                self.root.children.append(self.body)
                self.at = self.body
            return
        node = Node(tag, self.at, _hidden(tag, attrs), _marked(tag, attrs, self.articles > 0))
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1
            self.articles += tag in ("article", "main")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "iframe", "object"):
            self._up(self.at)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._close({tag}, {"table"} if tag in ("p", "li", "div", "span", "b") else set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)

    def unknown_decl(self, data: str) -> None:
        pass

    def _up(self, node: Node) -> None:
        """The element and all open ones inside it end."""
        at = self.at
        while at is not node.parent:
            self.open[at.tag] -= 1
            self.articles -= at.tag in ("article", "main")
            at = at.parent
        self.at = at

    def _up_to_root(self) -> None:
        if self.at is not self.root:
            at = self.at
            while at.parent is not self.root:
                at = at.parent
            self._up(at)

    def _close(self, names: set[str], bounds: set[str]) -> None:
        if not any(self.open.get(n) for n in names):
            return
        at = self.at
        while at is not self.root and at is not self.body and at.tag not in bounds:
            if at.tag in names:
                self._up(at)
                return
            at = at.parent


def _ordered(top: Node) -> list[Node]:
    """The elements that count below and with ``top``, parents first."""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in node.children if isinstance(c, Node) and not c.drop)
    return out


def settle_marks(body: Node) -> None:
    """Leaves marked elements out, except those that wrap the article.

    A mark does not count on an element that holds article or main elements
    while there is none outside marked elements, nor on one with most of the
    body's unlinked text (where an article lies outside: in several blocks).
    """
    for node in reversed(_ordered(body)):
        inside = [c for c in node.children if isinstance(c, Node) and not c.drop]
        own = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        node.plain = 0 if node.tag == "a" else own + sum(c.plain for c in inside)
        node.runs = sum(c.runs for c in inside) + (own > 0 and node.tag not in INLINE)
        node.holds = any(c.holds or c.tag in ("article", "main") and c.plain for c in inside)
    free, todo = False, [body]
    while todo and not free:
        barred: list[Node] = []
        while todo:
            node = todo.pop()
            free = free or node.tag in ("article", "main") and node.plain > 0
            for c in node.children:
                if isinstance(c, Node) and not c.drop:
                    if not c.marked:
                        todo.append(c)
                    elif c.holds:
                        barred.append(c)
        if not free:
            for node in barred:
                node.marked = False
            todo = barred
    beside = [(body, False)]
    while beside:
        node, within = beside.pop()
        within = within or node.tag in ("article", "main")
        for c in node.children:
            if isinstance(c, Node) and not c.drop:
                wraps = c.tag not in BESIDE and 2 * c.plain > body.plain and (not free or c.runs > 1)
                # where there is an article, a hint is enough for what stands beside it
                c.drop = c.marked and not wraps or c.hint and free and not within and not c.holds
                if not c.drop:
                    beside.append((c, within))


def measure(top: Node) -> list[Node]:
    """Sets characters, tags, link characters, link tags and the composite density of every element; parents first."""
    nodes = _ordered(top)
    for node in reversed(nodes):
        inside = [c for c in node.children if isinstance(c, Node) and not c.drop]
        node.chars = sum(len("".join(c.split())) for c in node.children if isinstance(c, str)) + sum(c.chars for c in inside)
        node.tags = len(inside) + sum(c.tags for c in inside)
        node.link_chars = node.chars if node.tag == "a" else sum(c.link_chars for c in inside)
        node.link_tags = node.tags + 1 if node.tag == "a" else sum(c.link_tags for c in inside)
    share = top.link_chars / max(top.chars, 1)
    for node in nodes:
        c, t = node.chars, max(node.tags, 1)
        node.density = c / t
        if c and share:  # a page without links has plain characters per tag
            lc, lt = max(node.link_chars, 1), max(node.link_tags, 1)
            base = math.log(c / max(c - node.link_chars, 1) * node.link_chars + share * c + math.e)
            node.density *= math.log(max(c / lc * (t / lt), 1.0)) / math.log(base)
    return nodes


def main_node(page: Tree) -> Node | None:
    """The element that holds the article."""
    body = page.body or page.root
    settle_marks(body)
    blocks = [n for n in measure(body) if n.tag not in INLINE]
    if not body.chars:
        return None
    total = {id(n): sum(c.density for c in n.children if isinstance(c, Node) and not c.drop) for n in blocks}
    best = max(blocks, key=lambda n: total[id(n)])  # parents first: of equal sums the outermost
    if not total[id(best)]:
        return body
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    # the innermost article element bounds the text, else a main element
    bound = next((n for n in path if n.tag == "article"), None) or next((n for n in path if n.tag == "main"), body)
    path = path[: path.index(bound) + 1]
    threshold = min(n.density for n in path)
    inside = {id(n) for n in path}
    for node in _ordered(bound if bound.tag == "article" else best)[1:]:
        if id(node) not in inside:
            node.drop = _mostly_links(node) and (node.density < threshold or node.hint) and not _in_running_text(node)
    if bound.tag != "article":
        for node in path[1:]:
            for c in node.children:
                if isinstance(c, Node) and not c.drop and id(c) not in inside:
                    short = c.link_chars == 0 and (c.tag in RUNNING or c.tag in INLINE)
                    c.drop = c.chars > 0 and not short and c.density < threshold
    return bound


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def _in_running_text(node: Node) -> bool:
    """A link in a sentence, not one of a list: an inline element, or a heading or paragraph that stands among others."""
    return node.tag in INLINE or node.tag in RUNNING


def text_of(top: Node) -> str:
    """Blocks in page order, white space inside one turned into one space, joined by one space."""
    out: list[str] = []
    todo: list[Node | str] = [top]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif not item.drop:
            if item.tag not in INLINE:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(item.children))
    return " ".join("".join(out).split())


def article(html: str | None) -> str:
    """The main text of one page; empty for null, empty or text-free pages.  Text without markup is its own main text."""
    if not html:
        return ""
    page = Tree()
    page.feed(_OPEN_TAG.sub("", html))
    page.close()
    top = main_node(page)
    return "" if top is None else text_of(top)


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null or empty html gives an empty text; null ids and urls stay null;
    repeated rows come out as often; an empty table gives no rows; other
    columns are ignored.  Each page is read whole in one pass; no shuffle.
    """
    ready(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [article(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
