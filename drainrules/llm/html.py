"""Main text of web pages by tree scoring.

1. **Tree.**  A tolerant reader builds the element tree: comments, scripts, styles and the like are skipped
   whole, unclosed paragraphs, list items and table cells end where the next block begins, and stray end tags
   are passed over.
2. **Boilerplate** goes first: elements that are never article text (``DROPPED``), hidden ones, and those whose class,
   id or role speak of menus, adverts, notices, comments and the like; a name that a layout can have too (a sidebar's)
   beside one of the article's own spares an element with most of the page's characters.
3. **Scores.**  Each paragraph (or other block with text of its own) earns a point, one per comma and one per
   100 characters up to three; its parent gets these in full, its grandparent half, the ancestor beyond a
   third, and so on to ``ANCESTORS``.  A container's points are raised or lowered for its tag and names, and multiplied by
   one minus its link density.
4. **Result.**  The best container is kept.  Where it lies inside an ``article`` or ``main``, the nearest of these is the article: all
   that stands beside the container, at each level up to it, is kept too.  Elsewhere what stands beside it is kept, and
   beside its ancestors below the body what has their tag and class (the rows of one layout).  Only parts with half or more of
   their characters in links go, headings aside; no score and no length decides.  The blocks, white space joined to
   single spaces, are given in page order, one per line.

Nulls and odd input: a null page is empty and gives the empty text; a page without markup gives its text; where nothing earns
points, all text that is not boilerplate is kept; nesting of any depth is walked without recursion;
repeated pages each get their row; an empty table gives no rows; other columns are left behind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drainrules.llm.common import map_arrow

ANCESTORS = 5
LINK_SHARE = 0.5  # of a part's characters, from which on it is a list of links

# Names of HTML elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript template svg math select".split())
_TO_END = RAW - {"noscript", "svg", "math", "select", "template"}  # their text is no markup, up to their end tag
DROPPED = set("head nav footer aside form button fieldset menu dialog object canvas audio video".split()) | RAW
BLOCKS = set(
    "address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html"
    " legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS | DROPPED - RAW - {"button", "object", "canvas", "audio", "video"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of the first kind ends where one of the second begins, unless an element of the third stands between.
IMPLIED = (
    ({"li"}, {"li"}, {"ul", "ol", "menu"}),
    ({"dt", "dd"}, {"dt", "dd"}, {"dl"}),
    ({"td", "th"}, {"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tr"}, {"tr", "tbody", "thead", "tfoot"}, {"table"}),
    ({"tbody", "thead", "tfoot", "caption"}, {"tbody", "thead", "tfoot"}, {"table"}),
    ({"head"}, {"body", *BLOCKS}, set()),
)

#: Names of parts that are never the article, whatever else the name says, but where it only says that something is (not) there.
_NEVER = re.compile(
    r"(?<![a-z])(banner|breadcrumbs?|comments?|commentlist|consent|cookies?|copyright|disqus|footer|gdpr|legal|login|masthead|menu\w*|modal|nav\w*|newsletter"
    r"|notices?|notifications?|outbrain|pager|pagination|popup|replies|respond|search|signup|skip|subscribe|subscription|taboola|toolbar|topbar)(?![a-z])"
)
#: Names that a container of the whole layout can have too.
_UNLIKELY = re.compile(
    r"(?<![a-z])(ads?|advert\w*|promo\w*|recommend\w*|related|share|sharing|sidebars?|social|sponsor\w*|tags?|widgets?)(?![a-z])"
)
_LIKELY = re.compile(r"(?<![a-z])(article\w*|body|content|entry|main|page|post|story|text|blog)(?![a-z])")
_HEADER = re.compile(r"(?<![a-z])header(?![a-z])")
_ARTICLE_PART = re.compile(r"(?<![a-z])(article\w*|content|entry|post|story)(?![a-z])")
_MODIFIER = re.compile(r"(?<![a-z])(has|no|with|without|show|hide|is)[-_]\w+(?:[-_]\w+)*")
MOST = 0.5  # of a page's characters: what holds more of them is its layout
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "alert", "alertdialog", "dialog"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"
    r"((?:[^>=]++|=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|=(?!\s*[\"']))*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)


class Node:
    __slots__ = ("tag", "attributes", "parent", "children", "points", "chars", "link_chars")

    def __init__(self, tag: str, attributes: str = "", parent: Node | None = None):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.link_chars = 0


def parse(html: str) -> Node:
    """The element tree of a page; texts are children of their element, with references decoded."""
    root = Node("#root")
    at = 0
    node = root
    open_tags: dict[str, int] = {}
    raw_end = None

    def close(to: Node) -> None:
        """End all elements below and including ``to``."""
        nonlocal node
        while True:
            open_tags[node.tag] -= 1
            done, node = node, node.parent
            if done is to:
                return

    def add_text(text: str) -> None:
        if text:
            node.children.append(unescape(text) if "&" in text else text)

    pos = 0
    while True:
        m = _MARKUP.search(html, pos)
        if m is None:
            add_text(html[at:])
            return root
        add_text(html[at : m.start()])
        at = pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags.get(tag):
                up = node
                while up.tag != tag:
                    up = up.parent
                close(up)
            elif tag in ("p", "br"):
                node.children.append(Node("br", "", node))
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            up = node
            while up.tag != "p" and up.tag not in ("td", "th", "button", "object"):
                up = up.parent
            if up.tag == "p":
                close(up)
        for ending, starting, between in IMPLIED:
            if tag in starting and any(open_tags.get(t) for t in ending):
                up = node
                while up is not root and up.tag not in ending and up.tag not in between:
                    up = up.parent
                if up.tag in ending:
                    close(up)
        child = Node(tag, m[3] or "", node)
        node.children.append(child)
        if tag in VOID or (m[3] and m[3].endswith("/") and tag not in BLOCKS and tag not in _TO_END):
            continue
        if tag in _TO_END:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = pos = end.end() if end else len(html)
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        node = child


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _names(node: Node) -> tuple[str, dict[str, str]]:
    if not node.attributes.strip():
        return "", {}
    a = _attributes(node.attributes)
    names = re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{a.get('class', '')} {a.get('id', '')}")
    return names.lower(), a


def _is_boilerplate(node: Node, in_article: bool, most: float) -> bool:
    """Whether an element is no part of an article; ``most`` characters make it the page's layout."""
    if node.tag in DROPPED:
        return True
    names, a = _names(node)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in _ROLES:
        return True
    if node.tag in ("html", "body", "article", "main", "#root"):
        return node.tag == "article" and bool(re.search(r"(?<![a-z])comments?(?![a-z])", names))
    if node.tag == "header":
        return not in_article
    if node.tag in ("a", "b", "i", "em", "strong", "span", *HEADINGS) and not re.search(r"(?<![a-z])(ads?|advert\w*|share|social)(?![a-z])", names):
        return False
    names = _MODIFIER.sub(" ", names)
    if _NEVER.search(names):
        return True
    if _HEADER.search(names) and not in_article and not _ARTICLE_PART.search(names):
        return node.chars <= most
    return bool(_UNLIKELY.search(names)) and not (_LIKELY.search(names) and node.chars > most)


def _prune(root: Node) -> None:
    order = _walk(root)
    for node in reversed(order):  # characters of each element, those of scripts and the like aside
        if node.tag not in RAW:
            node.chars = sum(len(_collapse(c)) if isinstance(c, str) else c.chars for c in node.children)
    most = MOST * root.chars
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        kept = []
        for c in node.children:
            if isinstance(c, Node):
                if _is_boilerplate(c, inside, most):
                    if c.tag in BLOCKS or c.tag in DROPPED - RAW:
                        kept.append(Node("hr", "", node))  # its place still parts the blocks around it
                    continue
                stack.append((c, inside))
            kept.append(c)
        node.children = kept
    for node in order:
        node.chars = 0


def _walk(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return out


def _collapse(text: str) -> str:
    return " ".join(text.split())


def _blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks of some elements, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _collapse("".join(held))
        held.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            held.append(item)
        elif item.tag == "br":
            held.append(" ")
        else:
            block = item.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return out


def _base(node: Node) -> float:
    points = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 5.0, "blockquote": 3.0, "td": 3.0, "pre": 3.0}.get(node.tag, 0.0)
    if node.tag in ("ul", "ol", "dl", "li", "dt", "dd", "address", *HEADINGS, "th"):
        points -= 4.0
    names, _ = _names(node)
    if names:
        points += 15.0 * bool(_LIKELY.search(names)) - 15.0 * bool(_UNLIKELY.search(names) or _NEVER.search(names))
    return points


def _parts(node: Node) -> list[list[Node | str]]:
    """The children of an element: each block alone, texts and inline elements between blocks together."""
    out: list[list[Node | str]] = []
    running = False
    for c in node.children:
        inline = isinstance(c, str) or c.tag not in BLOCKS
        if inline and running:
            out[-1].append(c)
        else:
            out.append([c])
        running = inline
    return out


def _few_links(part: list[Node | str]) -> bool:
    if any(isinstance(c, Node) and c.tag in HEADINGS for c in part):
        return True
    chars = sum(len(_collapse(c)) if isinstance(c, str) else c.chars for c in part)
    return not chars or sum(c.link_chars for c in part if isinstance(c, Node)) < LINK_SHARE * chars


def _kind(node: Node) -> tuple[str, str]:
    return node.tag, _attributes(node.attributes).get("class", "")


def _with_siblings(best: Node) -> list[Node | str]:
    """The best container and what belongs to its article beside it, in page order."""
    top = best
    while top is not None and top.tag not in ("article", "main"):
        top = top.parent
    kept: list[Node | str] = [best]
    node = best
    while node is not top and node.tag not in ("body", "html") and node.parent is not None:
        alike = top is not None or node is best
        beside: list[Node | str] = []
        for part in _parts(node.parent):
            if node in part:
                at = part.index(node)
                beside += [*part[:at], *kept, *part[at + 1 :]] if alike else kept
            elif _few_links(part) and (alike or isinstance(part[0], Node) and _kind(part[0]) == _kind(node)):
                beside += part
            else:
                beside.append(Node("hr"))  # its place still parts the texts around it
        kept, node = beside, node.parent
    return kept


def main_text(html: str) -> str:
    """The article of a page: its blocks, one per line."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    nodes = _walk(root)
    own: dict[int, int] = {}  # characters and commas of a block without those of blocks inside it
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        linked = node.tag == "a"
        for c in node.children:
            if isinstance(c, str):
                n = len(_collapse(c))
                node.chars += n
                if n:
                    up = node
                    while up.tag not in BLOCKS and up.parent is not None:
                        up = up.parent
                    own[id(up)] = own.get(id(up), 0) + n
                    commas[id(up)] = commas.get(id(up), 0) + c.count(",") + c.count("，") + c.count("、")
            else:
                node.chars += c.chars
                node.link_chars += c.link_chars
        if linked:
            node.link_chars = node.chars
    scored: list[Node] = []
    seen: set[int] = set()
    for node in nodes:
        n = own.get(id(node), 0)
        if not n or node.tag in HEADINGS:
            continue
        earned = 1 + commas[id(node)] + min(n / 100, 3)
        up, level = node.parent if node.tag in ("p", "pre", "li", "blockquote", "td", "dd") and node.parent else node, 0
        while up is not None and level < ANCESTORS:
            if id(up) not in seen:
                seen.add(id(up))
                scored.append(up)
                up.points += _base(up)
            up.points += earned / (level + 1)
            up, level = up.parent, level + 1

    def final(node: Node) -> float:
        return node.points * (1 - node.link_chars / node.chars) if node.chars else 0.0

    best = max(scored, key=final, default=None)
    if best is None or final(best) <= 0:
        return "\n".join(_blocks([root]))
    return "\n".join(_blocks(_with_siblings(best)))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return map_arrow(source, extract, "page_id long, url string, text string, n_chars long")
