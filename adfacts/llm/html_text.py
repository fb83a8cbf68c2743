"""Main text of web pages by composite text density.

For every node of a page the density of text per tag is adjusted by its links: text outside of
links over link text, weighted against the ratio of the whole body. A node's sum of densities is
that of its children. The threshold is the lowest density on the path from the densest-sum node
up to the body; of the nodes that reach it and hold the most, the one with the largest sum is
the article, widened to the container of all blocks that reach the threshold and of all
paragraphs with as much text per tag as the path has. Parts of it that are no article by their element or by a word in their class, id or
role (menus, notices, adverts, comments and so on) are left out, before densities are taken.
Within an article a name that a heading or a remark may have as well leaves a block out only if it
holds a form, mostly links, or short text without a heading; ids of headings and paragraphs are
not read. A list of links there goes only from the edges of an article, as menus and further
stories have them: one with paragraphs before and behind it stays, and so do lists of references.
Blocks outside of an article element, from which the text is widened, have no more links among
their text than the article has, or a fifth: else they are teasers.

A page is a row of its own: one task reads it, nothing is shuffled. Defined results: a null or
empty page, or one without text, gives an empty text; null ids and urls are kept; repeated rows
are read each; markup cut off or never closed ends with the page.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from adfacts.llm.common import table

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(class|id|role|aria-hidden|hidden|style|itemprop)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# Content is not markup: it ends at the closing tag of the same name.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
    # Formulas.
    "math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mpadded", "mphantom",
    "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts",
    "mtable", "mtr", "mtd", "merror", "menclose", "mfenced", "annotation", "annotation-xml",
}
# Never part of an article.
DROPPED = RAW | {
    "nav", "footer", "aside", "form", "button", "select", "input", "option", "menu", "dialog", "head",
    "svg", "canvas", "object", "audio", "video", "map", "applet", "fieldset", "datalist",
    "annotation", "annotation-xml",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# A name of a class, an id or a role that marks what is no article; parts of names are set apart
# by "-", "_" or a capital.
MARKED = re.compile(
    r"(?:^|[_-])(?:ads?|adbox|adslot|adsense|adsbygoogle|advert\w*|sponsor\w*|promo\w*|banner\w*|popup\w*|"
    r"modal|overlay|cookie\w*|consent\w*|gdpr|privacy|notices?|notification\w*|alerts?|alertdialog|newsletter\w*|"
    r"subscri\w*|signup|signin|login|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|aside|toolbar\w*|"
    r"comment\w*|disqus\w*|discussion|responses|replies|respond|reactions|foot|footer\w*|masthead|topbar|"
    r"related\w*|recommend\w*|shar(?:e|ing)\w*|social\w*|widget\w*|pagination|pager|skip|search\w*|tags|"
    r"complementary|contentinfo)(?:$|[_-])",
    re.I,
)
# Within an article a name marks by itself only if all its parts are such words or say no more than
# where and how, and one of them is no word that headings and remarks have as well.
SURE = re.compile(
    r"ads?|adbox|adslot|adsense|adsbygoogle|advert|adverts|advertisement|sponsor|sponsored|promo|promos|banner|"
    r"banners|popup|modal|cookie|cookies|consent|gdpr|newsletter|subscribe|signup|signin|login|nav|navbar|menu|menus|"
    r"breadcrumb|breadcrumbs|sidebar|aside|toolbar|comment|comments|disqus|replies|footer|masthead|topbar|related|"
    r"recommended|recommendations|share|sharing|social|widget|widgets|pagination|pager|complementary|contentinfo", re.I,
)
FILLER = re.compile(
    r"notices?|alerts?|notification|privacy|search|skip|tags|foot|box|bar|list|block|container|wrapper|wrap|area|"
    r"slot|unit|links?|buttons?|icons?|inner|outer|top|bottom|left|right|posts?|articles?|stories|media|\d+", re.I,
)
# Visible characters below which a marked block without a heading is a notice.
SHORT = 100
REFERENCES = re.compile(
    r"\b(?:references|bibliography|literature|sources|works cited|citations|footnotes|notes|further reading)\b", re.I
)
COMMENT = re.compile(r"(?:^|[_-])(?:comments?|repl(?:y|ies))(?:$|[_-])", re.I)
# Names of what holds the article, and of a state that says nothing of the element itself.
HOLDS = re.compile(r"^(?:(?:\w+-)?(?:content|main|body)|article|post|entry|story)$", re.I)
STATE = re.compile(r"^(?:has|with|no|is|hide|show)[_-]", re.I)
CAPITAL = re.compile(r"(?<=[a-z])(?=[A-Z])")
PAGE_HEAD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.I)
# A tag that begins closes an open one of these, up to the nearest container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = {"ul", "ol", "dl", "table", "div", "section", "article", "main", "body", "td", "th"}
PARAGRAPH_ENDS = {
    "address", "article", "aside", "blockquote", "center", "details", "dir", "div", "dl", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main",
    "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
PARAGRAPHS = {"p", "td", "li", "dd", "blockquote", "pre"}
SPACE = re.compile(r"\s+")
# Share of link text from which a block of several links is a menu.
MENU_SHARE = 0.8
# Share of link text up to which a block beside an article may belong to it.
LINKED_SHARE = 0.2


class Node:
    """An element: its own texts and children in order, and what the densities need."""

    __slots__ = (
        "tag", "parent", "parts", "dropped", "doubtful", "within", "chars", "tags", "link_chars", "links",
        "density", "total",
    )

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False):
        self.tag, self.parent, self.parts, self.dropped = tag, parent, [], dropped
        self.doubtful = False
        self.within = tag in ("article", "main") or (parent is not None and parent.within)
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def _is_sure(name: str) -> bool:
    parts = [p for p in re.split("[_-]+", name) if p]
    sure = [SURE.fullmatch(p) for p in parts]
    return any(sure) and all(m or FILLER.fullmatch(p) for m, p in zip(sure, parts))


def _is_marked(attributes: str, tag: str, within: bool = False) -> bool | None:
    """Whether an element is no article; None if that is left to what it holds."""
    if not attributes or attributes.isspace():
        return False
    marked: bool | None = False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true" and tag != "math"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and tag not in ("html", "body", "main"):
            if tag == "p" or tag in HEADINGS:
                # An id is an anchor there, mostly made of a heading.
                if name == "id" or within and name == "class":
                    continue
            names = [n for n in CAPITAL.sub("-", value).split() if not STATE.match(n)]
            if any(HOLDS.match(n) for n in names):
                return False
            found = [n for n in names if (COMMENT if tag == "article" else MARKED).search(n)]
            if not found:
                continue
            if name != "role" and (within or (tag == "section" and name == "id")):
                if not any(map(_is_sure, found)):
                    marked = None
                    continue
            return True
    return marked


def parsed(page: str) -> Node:
    """The tree of a page. Open elements close where HTML lets them; the rest at the end."""
    root = Node("html", None)
    top, at, n = root, 0, len(page)
    while at < n:
        match = TOKEN.search(page, at)
        if match is None:
            top.parts.append(page[at:])
            break
        if match.start() > at:
            top.parts.append(page[at:match.start()])
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            node = top
            while node is not None and node.tag != tag:
                # A closing inline tag does not reach out of its block.
                node = None if tag in INLINE and node.tag not in INLINE else node.parent
            if node is not None and node.parent is not None:
                top = node.parent
            continue
        attributes = match[3] or match[6] or ""
        if tag in ("html", "body"):
            if tag == "body":
                while top.parent is not None:
                    top = top.parent
            continue
        if tag in PARAGRAPH_ENDS:
            node = top
            while node.parent is not None and (node.tag in INLINE or node.tag == "p"):
                if node.tag == "p":
                    top = node.parent
                    break
                node = node.parent
            if tag[0] == "h" and top.tag == tag:
                top = top.parent or top
        for _ in range(2):
            if tag in CLOSES:
                node = top
                while node.parent is not None and node.tag not in SCOPES - CLOSES[tag]:
                    if node.tag in CLOSES[tag]:
                        top = node.parent
                        break
                    node = node.parent
        marked = _is_marked(attributes, tag, top.within)
        dropped = top.dropped or tag in DROPPED or marked is True
        if not dropped and (tag == "header" or PAGE_HEAD.search(attributes)):
            dropped = tag not in ("html", "body", "main", "article") and not top.within
        node = Node(tag, top, dropped)
        node.doubtful = marked is None
        top.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            top = node
    return root


def _visible(text: str) -> int:
    return len(SPACE.sub("", html.unescape(text)))


def densities(root: Node) -> list[Node]:
    """All kept nodes, children before parents, with composite density and density sum."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.dropped)
    order.reverse()
    for node in order:
        node.chars = node.tags = node.link_chars = node.links = 0
        node.density = node.total = 0.0
        for part in node.parts:
            if isinstance(part, str):
                node.chars += _visible(part)
            elif not part.dropped:
                node.chars += part.chars
                node.tags += part.tags + 1
                node.link_chars += part.link_chars
                node.links += part.links
        if node.tag == "a":
            node.link_chars, node.links = node.chars, node.links + 1
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for node in order:
        if node.chars:
            tags, links, linked = max(node.tags, 1), max(node.links, 1), max(node.link_chars, 1)
            plain = max(node.chars - node.link_chars, 1)
            base = math.log(node.chars * node.link_chars / plain + ratio * node.chars + math.e)
            inner = max(node.chars / linked * tags / links, 1.0)
            node.density = node.chars / tags * math.log(inner) / base if node.link_chars else (
                node.chars / tags * math.log(max(node.chars * tags, math.e)) / base
            )
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.dropped)
        if node.tag == "p" or not node.total:
            node.total = max(node.total, node.density)
    return order


def _text_per_tag(node: Node) -> float:
    return (node.chars - node.link_chars) / max(node.tags, 1)


def article(root: Node) -> Node:
    """The node of the main text: an article element that holds most, or the densest sum."""
    order = densities(root)
    best = max(order, key=lambda n: n.total)
    # The densest path: threshold is the least density between the best node and the body.
    path, node = [], best
    while node is not None:
        path.append(node.density)
        node = node.parent
    threshold = min(path)
    reached = [n for n in order if n.density >= threshold and n.chars]
    top = max(reached, key=lambda n: n.total, default=best)
    # Headings and short paragraphs beside the densest block belong to the same container.
    node = top
    while node.parent is not None and node.tag not in ("article", "main", "html"):
        node = node.parent
    if node.tag in ("article", "main"):
        return node
    # Other blocks that reach the threshold are parts of the same text. Density grows with the
    # size of a block, so paragraphs are held against the path by their text per tag.
    above, node = {}, top
    while node is not None:
        above[node] = len(above)
        node = node.parent
    least, widest = min(_text_per_tag(n) for n in above), 0
    share = max(top.link_chars / top.chars if top.chars else 0.0, LINKED_SHARE)
    for node in order:
        reaches = node.density >= threshold and node.tag not in INLINE or (
            node.tag in PARAGRAPHS and _text_per_tag(node) >= least
        )
        if reaches and node.chars and node not in above:
            branch = node
            while branch.parent not in above:
                branch = branch.parent
            if branch.link_chars <= share * branch.chars:
                widest = max(widest, above[branch.parent])
    top = list(above)[widest]
    while top.tag in INLINE | PARAGRAPH_ENDS - {"div", "section", "article", "main"} and top.parent:
        top = top.parent
    return top


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below a node in page order, with single spaces."""
    found: list[list[str]] = [[]]
    stack: list[tuple[Node | str, bool]] = [(node, False)]
    while stack:
        part, ends = stack.pop()
        if isinstance(part, str):
            found[-1].append(part)
            continue
        block = part.tag not in INLINE and part.tag != "br"
        if ends:
            found.append([])
            continue
        if part.dropped:
            if part.tag not in INLINE:
                found.append([])
            continue
        if part.tag == "br":
            found[-1].append(" ")
            continue
        if block:
            found.append([])
            stack.append((part, True))
        stack.extend((p, False) for p in reversed(part.parts))
    texts = (SPACE.sub(" ", html.unescape("".join(parts))).strip() for parts in found)
    return [t for t in texts if t]


def _holds(node: Node, tags: set[str]) -> bool:
    stack = [node]
    while stack:
        node = stack.pop()
        if node.tag in tags:
            return True
        stack.extend(p for p in node.parts if isinstance(p, Node))
    return False


def _references(root: Node) -> set[Node]:
    """Lists below a heading of references within an article, with all that holds them."""
    found: set[Node] = set()
    below, stack = False, [root]
    while stack:
        node = stack.pop()
        if node.tag in HEADINGS:
            below = bool(REFERENCES.search(" ".join(blocks(node))))
        if node.within and (node.tag == "ol" or below and node.tag in ("ul", "table")):
            inner = [node]
            while inner:
                found.add(part := inner.pop())
                inner.extend(p for p in part.parts if isinstance(p, Node) and not p.dropped)
            while node is not None:
                found.add(node)
                node = node.parent
            continue
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped)
    return found


def _inner(root: Node) -> set[Node]:
    """Blocks of an article element with paragraphs of it both before and behind them."""
    found: set[Node] = set()
    # Blocks that began after a paragraph, and those that ended then, by article.
    stack: list[tuple[Node, bool, list | None]] = [(root, False, None)]
    while stack:
        node, ends, own = stack.pop()
        if ends:
            if own is not None and own[0]:
                own[1].append(node)
            continue
        if node.tag in ("article", "main"):
            own = [False, []]
        elif own is not None and node.tag == "p" and node.chars and node.link_chars <= node.chars / 2:
            own[0] = True
            found.update(own[1])
            own[1].clear()
        if own is not None and own[0]:
            stack.append((node, True, own))
        stack.extend((p, False, own) for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped)
    return found


def _drop_menus(root: Node) -> None:
    """Leave out blocks of several links and hardly any other text, and doubtful ones like that."""
    order = densities(root)
    kept = _references(root) | _inner(root)
    for node in order:
        if node.tag in ("ul", "ol", "div", "section", "table") and node.links > 1 and node not in kept:
            node.dropped = node.link_chars > MENU_SHARE * node.chars
        if node.doubtful and node.tag not in INLINE:
            node.dropped = node.dropped or (
                _holds(node, {"form", "input", "button", "select"})
                or (node.link_chars > node.chars / 2 and node not in kept)
                or (node.chars < SHORT and not _holds(node, HEADINGS))
            )


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parsed(page)
    _drop_menus(root)
    return "\n".join(blocks(article(root)))


def with_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of pages (page_id, url, html)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long"
    )


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_text(table(spark, sf_dir, "pages"))


QUERIES = {"op10_main_text": op10_main_text}
CHECKS: dict[str, str] = {}
