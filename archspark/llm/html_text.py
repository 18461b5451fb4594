"""Main text of web pages by composite text density.

Every DOM node gets its characters per tag, adjusted by the share of its characters and tags that belong to links. Its tags are
those under it and its own, so that a wrapper is less dense than what it wraps; marks within a line (b, i, br and their like, but
not links) are no tags, and their text is that of the block around them. A node's density sum adds up its children's densities and that of the text between them, so a leaf's sum is its own density. The node of
the largest sum is content, and so is, outside of it, the largest sum in each subtree whose density reaches the threshold: the
least density on the way from the first node up to the body.
Elements that are by element name, role, class or id no part of an article (menus, forms, adverts, comments) are left out
beforehand. A class or id says so if it is one of NAMES as a whole, or is made of them and of words for layout. An element that
holds an article or main stays, and so does a form that holds most of the page's text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from archspark.llm.common import row_batches

# Element names of HTML, and words by which pages name what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
LEFT_OUT = frozenset("nav aside form script style noscript template button select option textarea input iframe object svg canvas audio video dialog menu head title".split())
OUTSIDE = frozenset("header footer".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets footer header masthead comment comments disqus respond reply replies share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar skip".split())
LAYOUT = frozenset("area bar block bottom box col column container content controls element fixed form global group holder inner item items js left link links list main nav page panel post posts right row section side site slot sticky top unit wrap wrapper zone".split())
CLOSES = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BLOCKS_END_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPES = frozenset("body html table td th ul ol dl div section article main aside nav header footer form button".split())
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "parent", "content", "out", "within", "block", "chars", "tags", "link_chars", "link_tags", "own", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool = False):
        self.tag, self.parent, self.out = tag, parent, out
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        #: the nearest element around it that is no mark within a line
        self.block = parent if parent is None or not _mark(parent) else parent.block
        self.content: list[Node | str] = []


def _names_other(value: str) -> bool:
    """Whether a class or id says that the element is no part of an article."""
    parts = _NAME.findall(value)
    return any(p in NAMES for p in parts) and all(p in NAMES or p in LAYOUT or p.isdigit() for p in parts)


def left_out(tag: str, attrs: list[tuple[str, str | None]], within: bool) -> bool:
    """within: inside of an article or main, whose headers are its own."""
    if tag in LEFT_OUT or tag == "footer" or tag in OUTSIDE and not within:
        return True
    if tag in ("body", "html", "main"):
        return False
    for name, value in attrs:
        value = (value or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name in ("class", "id") and tag not in INLINE and any(map(_names_other, value.split())) and not (within and tag in OUTSIDE):
            return True
    return False


class _Builder(HTMLParser):
    """Builds the tree. The open elements are a stack with a count by name, so that an end tag without a start costs nothing, however deep the page is."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.stack, self.open, self.body = [self.root], Counter(), False

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "body" and self.body:
            return
        self.body |= tag == "body"
        if tag in BLOCKS_END_P:
            self._close({"p"}, SCOPES)
        if tag in CLOSES:
            self._close(CLOSES[tag], SCOPES)
        at = self.stack[-1]
        node = Node(tag, at, left_out(tag, attrs, at.within or at.tag in ("article", "main")))
        at.content.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._close({tag}, frozenset() if tag in SCOPES else frozenset({"body"}) if tag == "p" else SCOPES - {"div"})

    def handle_data(self, data):
        self.stack[-1].content.append(data)

    def _close(self, tags, scopes) -> None:
        if not any(self.open[t] for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                self.open.subtract(n.tag for n in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i].tag in scopes:
                return


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    _reconsider(builder.root)
    return builder.root


def _reconsider(root: Node) -> None:
    """Take back the leaving out of elements that hold an article or main, and of forms that hold most of the page's text."""
    nodes, at = [root], 0
    while at < len(nodes):
        nodes += [x for x in nodes[at].content if isinstance(x, Node)]
        at += 1
    holds: set[Node] = set()
    chars: dict[Node, int] = {}
    for n in reversed(nodes):
        if n.tag in ("script", "style", "template", "noscript"):
            continue
        chars[n] = sum(len(x.strip()) if isinstance(x, str) else chars.get(x, 0) for x in n.content)
        if n.tag == "main" or n.tag == "article" and not n.out or any(x in holds for x in n.content):
            holds.add(n)
    for n in nodes:
        if n.out and (n in holds and n.tag not in ("template", "noscript") or n.tag == "form" and 2 * chars[n] > chars[root]):
            n.out = False


def _nodes(root: Node) -> list[Node]:
    """Nodes that count, parents before children."""
    out, at = [root], 0
    while at < len(out):
        out += [x for x in out[at].content if isinstance(x, Node) and not x.out]
        at += 1
    return out


def weigh(root: Node) -> list[Node]:
    """Set density and density sum of every node that counts; root is the body."""
    nodes = _nodes(root)
    for n in nodes:
        n.chars, n.tags, n.link_chars, n.link_tags = sum(len(s.strip()) for s in n.content if isinstance(s, str)), int(not _mark(n)), 0, 0
        n.own = n.chars
    for n in reversed(nodes):
        if n.tag == "a":
            n.link_chars, n.link_tags = n.chars, 1
        if n is not root:
            p = n.parent
            p.chars, p.tags, p.link_chars, p.link_tags = p.chars + n.chars, p.tags + n.tags, p.link_chars + n.link_chars, p.link_tags + n.link_tags
            p.own += n.own if _mark(n) else 0
    ratio = root.link_chars / max(1, root.chars)
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = math.log(c / max(1, c - n.link_chars) * lc + ratio * c + math.e)
        n.density = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / base) if n.link_chars else c / t
        n.total = 0.0 if n.tag == "a" or _mark(n) else float(n.own)
    for n in nodes:
        if n is not root and not _mark(n) and n.block is not None:
            n.block.total += n.density
    return nodes


def _mark(n: Node) -> bool:
    return n.tag in INLINE and n.tag != "a" or n.tag == "br"


def content(root: Node) -> list[Node | str]:
    """The nodes whose subtrees are the main text, and dense texts between them, in page order."""
    body = next((n for n in _nodes(root) if n.tag == "body"), root)
    nodes = weigh(body)
    first = max(nodes, key=lambda n: n.total)  # of equal sums the outermost
    if not first.total:
        return [body] if body.chars else []
    threshold, above, n = first.density, {first}, first
    while n is not body:
        n = n.parent
        above.add(n)
        if n is not body:
            threshold = min(threshold, n.density)
    chosen: list[Node | str] = []
    stack: list[Node | str] = [body]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            if len(top.strip()) >= threshold:
                chosen.append(top)
        elif top is first:
            chosen.append(top)
        elif top in above:
            stack += reversed([x for x in top.content if isinstance(x, str) or not x.out])
        elif top.density >= threshold and top.chars:
            chosen.append(max(_nodes(top), key=lambda n: n.total))
    return chosen


def blocks(node: Node | str) -> list[str]:
    """Text of the blocks under a node, white space made single."""
    out: list[list[str]] = [[]]

    def walk(n: Node | str) -> None:
        stack: list[tuple[str, object]] = [("in", n)]
        while stack:
            what, x = stack.pop()
            if what == "end":
                out.append([])
            elif isinstance(x, str):
                out[-1].append(x)
            elif not x.out:
                block = x.tag not in INLINE and x.tag != "br"
                if x.tag == "br":
                    out[-1].append(" ")
                if block:
                    out.append([])
                    stack.append(("end", None))
                stack += [("in", y) for y in reversed(x.content)]

    walk(node)
    return [t for t in (" ".join("".join(b).split()) for b in out) if t]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    return " ".join(b for node in content(tree(html)) for b in blocks(node))


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points of text).

    A null or empty page, and one without text, gives an empty text. Repeated rows come back each; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                text = main_text(html)
                yield page, url, text, len(text)

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(lambda b: row_batches(rows(b), _OUT, 500), "page_id long, url string, text string, n_chars long")
