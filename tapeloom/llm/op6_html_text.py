"""Main text of HTML pages by composite text density.

Every element gets a link-adjusted density: its characters per tag, times a logarithm that falls
with the share of link characters and link tags (Sun, Song and Liao, 2011). Menus, headers,
footers, sidebars, notices, adverts, forms, comments and the like are emptied first, by element,
role or class name, unless they hold the page's article. The block whose children's densities
have the largest sum is the core. The least density on the path from the core to the body is the
threshold: the selection climbs to a parent as long as another of its branches reaches a quarter
of it, and takes in the whole ``article`` or ``main`` around the core.

Text: character references are decoded, a block's white space becomes single spaces, blocks are
joined in page order by a space. Nothing else is dropped. Null or empty HTML, or a page without
text, gives the empty text; null ids and urls are kept; every row gives a row.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import add_columns, read

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
EMPTIED = frozenset(
    "aside audio button canvas datalist dialog footer head iframe input label math menu nav noembed noframes "
    "noscript object script select style svg template textarea title video xmp".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
#: Names that a class or id of page furniture is, begins or ends with.
FURNITURE = (
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs sidebar widget widgets footer header masthead topbar comment comments disqus discussion "
    "replies respond cookie cookies consent gdpr notice notices notification popup modal overlay share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar "
    "copyright legal disclaimer skip-link"
)
_FURNITURE = re.compile(rf"(?:[\w-]*[_-])?(?:{'|'.join(FURNITURE.split())})(?:[_-][\w-]*)?")
#: Whole names of reader comments.
_COMMENTS = re.compile(r"(?:comments?|comment[_-]?(?:body|list|section|thread)|comments[_-](?:area|list|section|wrap|wrapper))")
#: Parts of the names of wrappers, and the share of a page's text beyond which one, or a form, is the page itself.
_WRAPPER = re.compile(r"(?:^|[_-])(?:wrap|wrapper|container|content|main|page|layout|site)(?:$|[_-])")
MOSTLY = 0.6
_BESIDE = re.compile(r"(?:has|no|with|without|is|not|hide)[_-]")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: What a start tag closes, and what it looks no further than.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    **dict.fromkeys(("dt", "dd"), ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(("td", "th"), ({"td", "th"}, {"tr", "table"})),
    "tr": ({"tr"}, {"table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot"}, {"table"})),
    "body": ({"head"}, {"html"}),
}
CLIMB = 0.25


class Node:
    __slots__ = ("tag", "parent", "parts", "empty", "inside", "chars", "tags", "link_chars", "link_tags", "density", "wraps")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.parts, self.empty, self.wraps = tag, parent, [], 0, tag == "form"
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))
        if parent is not None:
            parent.parts.append(self)

    def above(self):
        node = self
        while node is not None:
            yield node
            node = node.parent


def _furniture(tag: str, attributes: str, node: Node) -> int:
    """0: content; 1: furniture, unless it holds the article; 2: never content."""
    if tag in EMPTIED:
        return 2
    if tag == "form" or tag == "header" and not node.inside:
        return 1
    if not attributes or tag in ("html", "body", "main"):
        return 0
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return 2
    if found.get("role") in ROLES:
        return 1
    names = [*found.get("class", "").split(), *found.get("id", "").split()]
    named = [n for n in names if _FURNITURE.fullmatch(n) and not _BESIDE.match(n)]
    if tag == "article" or node.inside and tag in ("header", "h1", "h2", "h3", "h4", "h5", "h6"):
        named = [n for n in named if _COMMENTS.fullmatch(n)]
    node.wraps = any(_WRAPPER.search(n) for n in named)
    return 2 if any(_COMMENTS.fullmatch(n) for n in named) else int(bool(named))


def tree(html: str) -> Node:
    """The elements of a page, with the end tags that authors leave out."""
    root = here = Node("html", None)
    open_ = Counter()

    def leave(node):
        """Close ``node`` and what is open inside it."""
        last = here
        while last is not node.parent:
            open_[last.tag] -= 1
            last = last.parent
        return last

    at = text = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            here.parts.append(unescape(html[text:]))
            return root
        m = _TAG.match(html, lt)
        if not m:
            if html.startswith("<!--", lt):
                end, skip = html.find("-->", lt + 4), 3
            elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
                end, skip = html.find(">", lt), 1
            else:
                at = lt + 1  # a bare sign
                continue
            here.parts.append(unescape(html[text:lt]))
            at = text = len(html) if end < 0 else end + skip
            continue
        here.parts.append(unescape(html[text:lt]))
        at = text = m.end()
        tag = m[2].lower()
        if m[1]:
            for node in here.above() if open_[tag] else ():
                if node.tag == tag and node.parent is not None:
                    here = leave(node)
                    break
                if node.tag in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag == "html":
            continue
        if tag in BLOCKS:
            for node in here.above():
                if node.tag == "p":
                    here = leave(node)
                if node.tag in BLOCKS:
                    break
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            for node in here.above() if any(open_[t] for t in ends) else ():
                if node.tag in ends:
                    here = leave(node)
                    break
                if node.tag in stop:
                    break
        node = Node(tag, here)
        node.empty = _furniture(tag, m[3], node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
            at = text = end.start() if end else len(html)
        if tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
            here = node
            open_[tag] += 1


def _walk(root: Node) -> list[Node]:
    """All elements, parents first, without recursion."""
    found = [root]
    for node in found:
        found += [p for p in node.parts if isinstance(p, Node)]
    return found


def _text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        elif not part.empty:
            edge = [" "] if part.tag in BLOCKS or part.tag == "br" else []
            todo += [*edge, *reversed(part.parts), *edge]
    return " ".join("".join(out).split())


def measure(nodes: list[Node], body: Node) -> None:
    """Characters, tags and composite text density of every element; emptied ones have none."""
    linked = set()
    for node in nodes:
        if node.tag == "a" or node.parent is not None and id(node.parent) in linked:
            linked.add(id(node))
        if node.parent is not None and node.parent.empty:
            node.empty = 2
    for node in reversed(nodes):
        node.chars = node.link_chars = node.tags = node.link_tags = 0
        if node.empty:
            continue
        for part in node.parts:
            if isinstance(part, str):
                size = sum(map(len, part.split()))
                node.chars += size
                node.link_chars += size if id(node) in linked else 0
            else:
                node.chars += part.chars
                node.tags += part.tags
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
        node.tags += 1
        node.link_tags += node.tag == "a"
    share = body.link_chars / max(1, body.chars)
    for node in nodes:
        c, lc = node.chars, max(1, node.link_chars)
        if not c:
            node.density = 0.0
            continue
        base = log(c / max(1, c - node.link_chars) * lc + share * c + e)
        node.density = max(0.0, c / node.tags * log(max(1.0, c / lc * node.tags / max(1, node.link_tags))) / log(base))


def main_text(html: str | None) -> str:
    root = tree(html or "")
    nodes = _walk(root)
    for node in reversed(nodes):  # furniture that holds an article is none
        holds = node.tag in ("article", "main") and not node.empty
        node.inside = holds or any(isinstance(p, Node) and p.inside for p in node.parts)
        if node.inside and node.empty == 1:
            node.empty = 0
    body = next((n for n in nodes if n.tag == "body"), root)
    for node in reversed(nodes):
        inner = (sum(map(len, p.split())) if isinstance(p, str) else p.chars for p in node.parts)
        node.chars = 0 if node.empty == 2 else sum(inner)
    for node in nodes:  # nor is one around nearly the whole page
        if node.empty == 1 and node.wraps and node.chars > MOSTLY * body.chars:
            node.empty = 0
    measure(nodes, body)
    core, most = body, -1.0
    for node in nodes:
        if node.tag not in BLOCKS or not node.chars:
            continue
        own = sum(sum(map(len, p.split())) for p in node.parts if isinstance(p, str))
        inner = [p for p in node.parts if isinstance(p, Node)]
        own += sum(p.chars for p in inner if p.tag not in BLOCKS)
        total = sum(p.density for p in inner if p.tag in BLOCKS) + (own * log(max(own, 1)) if own else 0.0)
        if total > most:
            core, most = node, total
    path = list(core.above())
    threshold = min(n.density for n in (path[: path.index(body) + 1] if body in path else path))
    for child, parent in zip(path, path[1:]):
        others = [p for p in parent.parts if isinstance(p, Node) and p is not child and p.tag in BLOCKS]
        if any(p.density >= CLIMB * threshold > 0 for p in others):
            core = parent
    whole = [n for n in core.above() if n.tag in ("article", "main")]
    return _text(whole[0] if whole else core)


def with_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    def compute(pages: pa.Array) -> list[pa.Array]:
        return [pa.array([main_text(p) for p in pages.to_pylist()], pa.string())]

    return add_columns(df, html, [T.StructField(out, T.StringType())], compute)


def extracted(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``."""
    rows = with_main_text(pages.select("page_id", "url", "html")).drop("html")
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return extracted(read(spark, folder, "pages", "page_id", "url", "html"))
