"""Main text of web pages by tree scoring.

Each block of text that reads like a paragraph gives points, for its length and its commas, to the elements around it: all to
the parent, less to each of REACH above it, and all to every article and main element that holds it, discounted by the share
of its text that is links. The best element is the article; siblings that score well, and headings beside it, are
kept with it. Headers, footers, sidebars, notices, adverts, forms and the like, told by element or role, give no text.

A name of a class or id decides nothing by itself: text below a name that such parts bear (comments, sidebar, share, ...) gives
few points. Once the article is chosen, parts of it and beside it that are named so are cut, unless they hold the article or nearly all
of its text. Lists of links are left out but where the article goes on after them. A page takes time in proportion to its length,
however deep it is nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import fenced, named, slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?!svg\b[^>]*/>)(script|style|noscript|template|textarea|svg|iframe|title|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+)))?")
#: Elements that neither begin nor end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output progress q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr "
    "math mi mn mo mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mtable mtr mtd semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text isn't the article's.
OUTSIDE = frozenset("head nav footer aside form button menu dialog object audio video canvas map fieldset datalist frameset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup signin login register sidebar sidebars sidenav menu menus nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar "
    "comment comments commentlist disqus respond reply replies discussion feedback share sharing social related recommended recommendations widget pagination pager search form skip".split()
)
GOOD_WORDS = frozenset("article body content entry main page post text blog story hentry".split())
#: Words after which a word of the same name says what the element has, not what it is.
HAVING = frozenset("has have with without no not hide show toggle open".split())
#: Share of its points that text below a badly named element gives, and the share of such an element's points that must be left without it.
NAMED_SHARE, LEFT_SHARE = 0.2, 0.1
#: Elements above a paragraph's parent that get a share of its points.
REACH = 5
ARTICLES = frozenset(("article", "main"))
TAG_SCORE = {"article": 60, "main": 60, "section": 5, "div": 5, "pre": 3, "td": 3, "blockquote": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "address": -3, "th": -5}
#: What an opening element ends when it stands open: the element, and what that search stops at.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


class Node:
    __slots__ = ("tag", "up", "bad", "named", "menu", "cut", "score", "full", "own", "chars", "linked", "links", "good", "inside")

    def __init__(self, tag: str, up: Node | None, bad: bool = False, named: bool = False, score: float = 0.0):
        self.tag, self.up, self.bad, self.named, self.score, self.full = tag, up, bad, named, score, 0.0
        self.menu = self.cut = False
        self.own = 0.0
        self.chars = self.linked = self.links = 0
        #: The nearest article or main element, itself included.
        self.good = self if tag in ARTICLES else up.good if up is not None else None
        self.inside = False


def name_words(names: str) -> set[str]:
    """The words of class names or an id that say what the element is."""
    out: set[str] = set()
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()) if w]
        having = next((k for k, w in enumerate(words) if w in HAVING), len(words))
        out.update(words[:having])
    return out


def opened(tag: str, attributes: str, up: Node) -> Node:
    """A new element: bad by its element, role or style, or named badly by a class or id."""
    bad, named, score = tag in OUTSIDE or (tag == "header" and up.good is None), False, float(TAG_SCORE.get(tag, 0))
    if attributes and not bad:
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in ("class", "id"):
                words = name_words(m[2] or m[3] or m[4] or "")
                if words & BAD_WORDS and tag not in ("body", "html", *ARTICLES):
                    named = True
                score += 25 * bool(words & GOOD_WORDS)
            elif name == "hidden" or (name == "role" and value in ROLES) or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                bad = True
    return Node(tag, up, bad, named, score - 25 * named)


def parse(html: str) -> tuple[list[tuple[Node, str, int, int]], list[Node]]:
    """Blocks of text in page order as (element, text, characters in links, links), and all block elements."""
    root = Node("", None)
    nodes, blocks = [root], []
    stack, parts, linked, links, in_link, at = [root], [], 0, 0, 0, 0
    standing: Counter[str] = Counter()

    def flush() -> None:
        nonlocal parts, linked, links
        text = " ".join(unescape("".join(parts)).split())
        if text:
            blocks.append((stack[-1], text, min(linked, len(text)), links))
        parts, linked, links = [], 0, 0

    def drop(depth: int) -> None:
        standing.subtract(n.tag for n in stack[depth:])
        del stack[depth:]

    def last(tags: frozenset[str] | set[str]) -> int:
        """Where in the stack the innermost of the tags stands; 0 if none does."""
        return next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in tags), 0) if any(standing[t] for t in tags) else 0

    for m in TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if in_link:
                linked += len(piece.strip())
        at = m.end()
        if m[1] or not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag == "a":
                in_link = max(0, in_link - 1)
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            flush()
            if depth := last({tag}):
                drop(depth)
            continue
        if tag == "a":
            in_link, links = 1, links + 1
        if tag in INLINE or tag == "svg":  # one that ends in itself; others are passed over whole
            continue
        if tag in VOID:
            if tag in ("hr",):
                flush()
            else:
                parts.append(" " if tag == "br" else "")
            continue
        flush()
        in_link = 0
        if stack[-1].tag == "p":
            drop(len(stack) - 1)
        if tag in ENDS:
            closing, barrier = ENDS[tag]
            depth = last(closing)
            if depth > last(barrier):
                drop(depth)
        if tag == "body" and (depth := last({"head"})):
            drop(depth)
        node = opened(tag, m[4] or "", stack[-1])
        nodes.append(node)
        stack.append(node)
        standing[tag] += 1
    if at < len(html):
        parts.append(html[at:])
        if in_link:
            linked += len(html[at:].strip())
    flush()
    return blocks, nodes


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def points(text: str, linked: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))


def main_text(html: str | None) -> str:
    """The article's blocks, in page order, joined by newlines; empty if there is none."""
    if not html:
        return ""
    blocks, nodes = parse(html)
    for node, text, linked, links in blocks:
        node.chars, node.linked, node.links = node.chars + len(text), node.linked + linked, node.links + links
    for node in reversed(nodes[1:]):  # children come after their parents
        node.up.chars, node.up.linked, node.up.links = node.up.chars + node.chars, node.up.linked + node.linked, node.up.links + node.links
    below = set()  # elements that are, or lie below, badly named ones
    for node in nodes[1:]:
        node.bad = node.bad or node.up.bad
        node.menu = node.up.menu or (node.links >= 3 and node.linked > 0.67 * node.chars and node.tag not in ("body", "html", *ARTICLES))
        if node.named or id(node.up) in below:
            below.add(id(node))
    listed = [b for b in blocks if not b[0].bad]
    blocks = [b for b in listed if not b[0].menu]
    if not blocks:
        return ""
    for node, text, linked, _ in blocks:
        own = points(text, linked) * (NAMED_SHARE if id(node) in below else 1.0)
        up, share = (node.up if node.tag in ("p", "pre", "li", "td") or node.tag in HEADINGS else node), 1.0
        for _ in range(REACH + 1):
            if up is None:
                break
            if up.tag not in ARTICLES:
                up.score += own * share
            up, share = up.up, share / 2 if share == 1 else share * 2 / 3
        if node.good is not None:
            node.good.full += own
        node.inside = True
    holding = {id(nodes[0])}
    for node in reversed(nodes[1:]):
        if node.inside:
            holding.add(id(node))
            node.up.inside = True
        if node.good is node:
            node.score += node.full
            if node.up.good is not None:
                node.up.good.full += node.full
    pool = [n for n in nodes if id(n) in holding and n.up is not None and n.tag not in ("p", "html", *HEADINGS)] or [nodes[0]]
    best = max(pool, key=lambda n: n.score * (1 - density(n)))
    for node in nodes:
        node.inside = node is best or (node.up is not None and node.up.inside)
        if node.up is best.up and id(node) in holding and not node.inside:
            worth = node.score * (1 - density(node)) >= max(10, 0.2 * best.score) or (node.tag == "p" and node.chars > 80 and density(node) < 0.25)
            node.inside = worth or (node.tag in HEADINGS and density(node) < 0.25)
    above, up = set(), best
    while up is not None:
        above.add(id(up))
        up = up.up
    for node, text, linked, _ in blocks:
        if node.inside:
            node.own += points(text, linked)
    clean = sum(n.own for n in nodes if id(n) not in below)
    for node in reversed(nodes[1:]):
        node.up.own += node.own
    for node in nodes[1:]:
        small = LEFT_SHARE * node.own <= clean
        node.cut = node.up.cut or (node.named and id(node) not in above and small)
    kept = [(k, b) for k, b in enumerate(listed) if b[0].inside and not b[0].cut]
    prose = [k for k, b in kept if not b[0].menu]
    return "\n".join(b[1] for k, b in kept if not b[0].menu or (prose and prose[0] < k < prose[-1]))


def extract_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages, without the html column, with main_text and n_chars (its code points).

    Null and empty pages, and pages without text, have an empty main_text; cut-off pages are read as far as they go. Of elements with
    equal scores the outermost, then the first is the article; repeated rows are read alike; an empty table gives an empty
    one. A page of any length is read whole, in a worker's memory. Columns of pages named as the new ones are replaced, others of any name stay.
    """
    inner, back = fenced(pages, ["main_text", "n_chars", html], _html=named(html))
    fields = inner.schema.fields[:-1]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_html"):
            texts = [main_text(x.as_py()) for x in batch.column("_html")]
            columns = [*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "main_text", "n_chars"])

    schema = T.StructType([*fields, T.StructField("main_text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return back(inner.mapInArrow(extract, schema), "main_text", "n_chars")
