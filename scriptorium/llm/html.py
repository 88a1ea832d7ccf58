"""Main text of web pages by a site style tree.

All pages of a host are merged by style: a node is the chain of tags and classes above it. A node's importance is the entropy of
what its pages show there, relative to the logarithm of their number: of the texts (content) and of the sequences of child
tags (presentation). One page more that shows something new is counted in, so few pages say little, whatever their number. A branch whose
content and presentation are the same on page after page is a template, and is removed from each page. Copies of a page count
once, so that a page is no template of its copies.

Menus, adverts and the like also differ from page to page, which entropy cannot see; so a role that a page's markup states itself (a
tag such as nav and footer, a class or id such as ad and sidebar) takes a node's importance to ROLE of itself, which is below LEAST. A name states
a role if all its words are roles or containers (comment-list, top-banner), so side-effects and has-sidebar state none. Roles do not
hold for html, body, article and main, nor for classes of what an article or main lies in, nor for a form that holds paragraphs or
headings. Text outside an article or main is kept unless the tree finds it to be a template. In an article, only nodes with a class,
an id or a role are judged: its plain paragraphs and headings are text, however often one is repeated.

Blocks are the text between block tags, white space in them one space, joined by \\n in page order. Null and empty html give an
empty text. A null or strange url counts as a host of its own. Repeated rows each give their row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import by_batch, written

#: Nodes whose importance is below LEAST are removed; a stated role leaves ROLE of it.
LEAST, ROLE = 0.15, 0.1

#: Elements that have no end tag; elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noframes xmp annotation annotation-xml desc metadata defs".split())
#: Elements all of whose content stands in the line.
DRAWN = frozenset("math svg".split())
#: Elements that do not break a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()) | DRAWN
#: Elements that are never main text.
ASIDE = frozenset("head nav footer aside form button select dialog menu header input object embed canvas audio video map".split()) | RAW
#: Words of a class or id that mark what is never main text.
ROLES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side footer header masthead topbar cookie cookies consent notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies widget toolbar pagination pager".split())
#: Words that say how what has a role is laid out.
CONTAINERS = frozenset("area bar block body bottom box button buttons col column container content feed form global group holder icon icons inner item items left line link links list main module outer page panel pane post posts primary right row secondary section site slot space strip tab tabs text thread top unit wrap wrapper zone".split())
#: Elements that no class gives a role.
ALWAYS = frozenset("html body article main".split())
#: What shows that a form wraps text.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: An end tag is implied when one of these starts inside one of those.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}


def _words(name: str) -> Iterator[str]:
    """Words of a class name; one that is made of a role and a container counts as both (commentlist)."""
    for word in _SPLIT.split(name):
        if word and not word[0].isdigit():
            cut = next((i for i in range(2, len(word) - 1) if word[:i] in ROLES and word[i:] in CONTAINERS), None) if word not in ROLES else None
            yield from (word[:cut], word[cut:]) if cut else (word,)


@functools.lru_cache(1 << 14)
def _role(name: str) -> bool:
    words = list(_words(name))
    return any(w in ROLES for w in words) and all(w in ROLES or w in CONTAINERS for w in words)


def _names(attributes: str) -> str:
    """The classes and ids of a tag, sorted."""
    found = {w for name, value in _ATTRIBUTE.findall(attributes) if name.lower() in ("class", "id") for w in value.strip("\"'").lower().split()}
    return " ".join(sorted(found))


class Node:
    __slots__ = ("children", "classes", "drawn", "path", "stated", "tag", "up", "wraps")

    def __init__(self, tag: str, classes: str, up: Node | None):
        self.tag, self.classes, self.up = tag, classes, up
        self.path = (up.path + "/" if up else "") + tag + ("." + classes if classes else "")
        self.drawn = tag in DRAWN or up is not None and up.drawn
        self.stated = tag not in ALWAYS and (tag in ASIDE or any(map(_role, classes.split())))
        self.wraps = False
        self.children: list[str] = []
        if tag in ("article", "main") or tag in _PROSE:
            while up:
                up.wraps = up.wraps or tag not in _PROSE or up.tag == "form" and not any(map(_role, up.classes.split()))
                up = up.up

    @property
    def aside(self) -> bool:
        """Known when the page is read: what a class calls aside is not, nor is a form, if it wraps an article."""
        node: Node | None = self
        while node:
            if node.stated and not (node.wraps and (node.tag == "form" or node.tag not in ASIDE)):
                return True
            node = node.up
        return False


def parse(page: str | None) -> Iterator[tuple[Node, str | None]]:
    """Text pieces with their node, and (node, None) where a block ends."""
    page = page or ""
    stack = [Node("", "", None)]
    at = 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            yield stack[-1], html.unescape(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if any(n.tag == tag for n in stack[1:]):
                while (top := stack.pop()).tag != tag:
                    yield top, None
                if tag not in INLINE and not top.drawn:
                    yield top, None
            continue
        classes = _names(m[3]) if m[3] else ""
        if tag not in INLINE and not stack[-1].drawn:
            yield stack[-1], None
            if stack[-1].tag == "p" or any(n.tag == "p" for n in stack) and tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "div", "ul", "ol", "table", "section", "article", "footer", "blockquote", "pre"):
                while any(n.tag == "p" for n in stack):
                    stack.pop()
            while stack[-1].tag in CLOSES.get(tag, ()):
                stack.pop()
        stack[-1].children.append(tag + ("." + classes if classes else ""))
        if tag in VOID or m[3].endswith("/") and tag in RAW:
            if tag == "br":
                yield stack[-1], " "
            continue
        node = Node(tag, classes, stack[-1])
        if tag in RAW:
            end = _ENDS[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append(node)
    if at < len(page):
        yield stack[-1], html.unescape(page[at:])
    yield stack[-1], None


def _pieces(page: str | None) -> Iterator[tuple[Node, bool, str]]:
    """(node, whether a role holds for it, text) of the blocks; what has a role in a line of text is a piece of its own."""
    held: dict[bool, list] = {False: [], True: []}
    for node, text in list(parse(page)):
        if text is None:
            for aside, parts in held.items():
                if parts and (said := " ".join("".join(t for _, t in parts).split())):
                    yield parts[0][0], aside, said
                parts.clear()
        else:
            held[node.aside].append((node, text))


def blocks(page: str | None) -> tuple[list[tuple[str, str]], dict[str, str]]:
    """(path, text) of the blocks that may be main text, and the child tags of each path that they lie in."""
    found = [(n, said) for n, aside, said in _pieces(page) if not aside]
    return [(n.path, said) for n, said in found], {n.path: " ".join(n.children) for n, _ in found}


def judged(path: str) -> bool:
    """Whether entropy decides on a node: outside an article, or with a class or id of its own below it."""
    steps = path.split("/")
    inside = next((i for i, s in enumerate(steps) if s.split(".")[0] in ("article", "main")), None)
    return inside is None or any("." in s for s in steps[inside + 1 :])


_HOST = T.StructType([T.StructField("host", T.StringType()), T.StructField("page", T.LongType()), T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("shown", T.LongType()), T.StructField("style", T.LongType()), T.StructField("stated", T.BooleanType())])))])


def _styled(columns: dict) -> dict:
    pages, nodes = [], []
    hashed = lambda s: xxhash.xxh64_intdigest(s) - (1 << 63)
    for page in columns.pop("html"):
        said: dict[str, list] = {}
        for node, aside, text in _pieces(page):
            said.setdefault(node.path, [aside, " ".join(node.children)]).append(text)
        nodes.append([{"path": p, "shown": hashed("\n".join(t)), "style": hashed(style), "stated": aside} for p, (aside, style, *t) in said.items() if aside or judged(p)])
        pages.append(hashed("\n".join("\n".join((p, *t)) for p, (aside, _, *t) in said.items() if not aside)))
    return columns | {"page": pages, "nodes": nodes}


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, n_pages, stated (a role holds on every page), importance of every judged node. Counts by (host, path, value) are summed before they are shuffled."""
    seen = by_batch(_hosted(pages).select("host", "html"), _HOST, _styled).select("host", "page", F.explode("nodes").alias("node")).select("host", "page", "node.*").distinct()
    nodes = None
    for feature in ("shown", "style"):
        each = seen.groupBy("host", "path", feature).agg(F.count("*").alias("n"), F.min("stated").alias("stated"))
        by = each.groupBy("host", "path").agg(F.sum("n").alias("n_pages"), F.min("stated").alias("stated"), F.sum(F.col("n") * F.log2("n")).alias("s"))
        entropy = F.when(F.col("n_pages") > 1, 1 - F.col("s") / (F.col("n_pages") * F.log2("n_pages"))).otherwise(1.0)
        by = by.select("host", "path", "n_pages", "stated", entropy.alias(feature))
        nodes = by if nodes is None else nodes.join(by.drop("n_pages", "stated"), ["host", "path"])
    # one page more that is like no other
    importance = (1 + F.col("n_pages") * F.greatest("shown", "style")) / (1 + F.col("n_pages"))
    return nodes.select("host", "path", "n_pages", "stated", (importance * F.when(F.col("stated"), ROLE).otherwise(1.0)).alias("importance"))


def _hosted(pages: DataFrame) -> DataFrame:
    return pages.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)))


_TEXT = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])


def _text(columns: dict) -> dict:
    out = []
    for page, drop in zip(columns.pop("html"), columns.pop("drop"), strict=True):
        gone = set(drop or ())
        steps = lambda path: [path[: m.start()] for m in re.finditer("/", path)] + [path]
        out.append("\n".join(said for path, said in blocks(page)[0] if not gone or not any(s in gone for s in steps(path))))
    return columns | {"text": out}


def extracted(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """page_id, url, text. What has a role goes where it is read, as no entropy lifts it over ROLE. Templates of a host (few paths: its pages share them) join its pages; a hot host's pages are split by
    the join, which is a broadcast where the templates of all hosts are small."""
    low = written(style_tree(pages).where((F.col("importance") < least) & ~F.col("stated")).groupBy("host").agg(F.sort_array(F.collect_set("path")).alias("drop")), "templates")
    known = _hosted(pages).select("page_id", "url", "html", "host").join(low, "host", "left")
    return by_batch(known.select("page_id", "url", "html", "drop"), _TEXT, _text)


def page_texts(pages: DataFrame) -> DataFrame:
    return extracted(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
