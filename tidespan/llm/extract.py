"""Main text of HTML pages by tree scoring.

A page is parsed into a tree of elements. Every paragraph passes points, one and more for its length and its commas, to its parent
and half of them to its grandparent; a container's points are discounted by the share of its text that lies in links. The best container
is the article; what stands beside it in the same parent, bare text among it, belongs to it unless most of it lies in links. Elements that never hold an article (menus, headers and
footers of the page, sidebars, forms, scripts, styles, and what classes, ids or roles name as notices, adverts or reader
comments) are cut out first.

Within the article text is gathered block by block: character references are decoded, white space inside a block (line
breaks of br among it) becomes one space, and blocks are joined in page order by a line break. A page without any container that scores gives all the text that was not cut.

Null or empty HTML gives an empty text. Broken markup, stray or missing end tags and very deep nesting are read as browsers mostly do;
nothing is dropped for length, and the time is in proportion to it at any depth. Rows are judged one by one, so repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidespan.llm.scratch import slices

#: Element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CUT = frozenset("script style noscript template nav aside footer form button select option textarea iframe object svg math canvas audio video dialog menu head title label fieldset".split())
RAW = frozenset("script style textarea title noscript iframe xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
PARAGRAPHS = frozenset("p pre td blockquote dd li".split())
#: An open element of these names ends when one of its partners begins.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TABLES = ("table", "td", "th")
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
#: Words of classes, ids and roles that name what is no article.
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|cookies?|consent|gdpr|notice|popup|modal|overlay|subscribe|newsletter|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|sidebar|side-?bar|widget|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|masthead|footer|foot|header|toolbar|comments?|commentlist|comment-?list|disqus|respond|replies|complementary|contentinfo|search|tags?|skip|hidden|alert|alertdialog)(?:$|[\s_-])",
    re.I,
)
LIKELY = re.compile(r"(?:^|[\s_-])(?:article|articles?-?body|entry|entry-?content|post|post-?content|post-?body|content|main|story|text|body)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<(?:!--(?:.*?)(?:-->|$)|!\[CDATA\[(?:.*?)(?:\]\]>|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>\x00]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|$))", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.S)
_SPACE = re.compile(r"\s+")
#: The share of an element's text in links from which it is no part of an article.
LINKED = 0.5


class Node:
    __slots__ = ("name", "attrs", "parent", "children", "score", "chars", "linked", "cut", "inside")

    def __init__(self, name: str, attrs: str, parent: Node | None):
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list = []
        self.score, self.chars, self.linked, self.cut = 0.0, 0, 0, False
        self.inside = parent is not None and (parent.inside or parent.name in ("article", "main", "section"))

    def named(self) -> str:
        """Class, id and role."""
        if not self.attrs or self.attrs.isspace():
            return ""
        found = {}
        for m in _ATTR.finditer(self.attrs):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
            return "hidden"
        return " ".join(found[k] for k in ("class", "id", "role") if k in found)


class _Open:
    """The open elements, and the places of those of each name among them."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def last(self, names: Iterable[str]) -> int:
        """The place of the innermost of these, 0 if none is open."""
        return max((p[-1] for x in names if (p := self.places.get(x))), default=0)

    def close(self, place: int) -> None:
        """Ends the element at this place and all inside it."""
        while len(self.nodes) > place:
            self.places[self.nodes.pop().name].pop()


def parse(text: str) -> Node:
    root = Node("html", "", None)
    stack, at, n = _Open(root), 0, len(text)
    while at < n:
        m = _TAG.search(text, at)
        here, start = stack.nodes[-1], m.start() if m else n
        if start > at:
            here.children.append(text[at:start])
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                here.children.append(m[0][9:-3])
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                here.children.append(Node("br", "", here))
                continue
            place = stack.last((name,))
            if place and (name in BLOCK or place > stack.last(TABLES)):
                stack.close(place)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P:
            place = stack.last(("p",))
            if place > stack.last((*TABLES, "button", "object")):
                stack.close(place)
        if name in SIBLINGS:
            place = stack.last(SIBLINGS[name])
            if place > stack.last(FENCE[name]):
                stack.close(place)
        here = stack.nodes[-1]
        node = Node(name, m[3], here)
        here.children.append(node)
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            node.children.append(text[at : end.start() if end else n])
            at = end.end() if end else n
        elif name not in VOID and not m[3].endswith("/"):
            stack.push(node)
    return root


def _walk(root: Node) -> list[Node]:
    """Elements in page order, without recursion; marks what is cut."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node is not root:
            named = node.named()
            page_header = node.name == "header" and not node.inside
            node.cut = node.name in CUT or page_header or bool(named and node.name not in ("article", "main", "body") and UNLIKELY.search(named) and not (LIKELY.search(named) and not re.search("comment|sidebar|widget|footer", named, re.I)))
            if node.cut:
                continue
        out.append(node)
        todo.extend(x for x in reversed(node.children) if type(x) is Node)
    return out


def _measure(nodes: list[Node]) -> None:
    """Characters of text, and of those the ones in links, of each element."""
    for node in reversed(nodes):
        own = sum(len(_SPACE.sub(" ", x)) for x in node.children if type(x) is str)
        node.chars = own + sum(x.chars for x in node.children if type(x) is Node and not x.cut)
        node.linked = node.chars if node.name == "a" else sum(x.linked for x in node.children if type(x) is Node and not x.cut)


def _plain(node: Node) -> str:
    """Text of an inline element; what blocks hold inside it is counted where they stand."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if type(x) is str:
            out.append(x)
        elif x is node or not (x.cut or x.name in BLOCK):
            todo.extend(reversed(x.children))
    return "".join(out)


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.name not in PARAGRAPHS or node.parent is None:
            continue
        text = _SPACE.sub(" ", "".join(x if type(x) is str else " " if x.name in BLOCK else _plain(x) for x in node.children)).strip()
        if len(text) < 2:
            continue
        points = 1 + text.count(",") + min(len(text) // 100, 3)
        node.parent.score += points
        if node.parent.parent is not None:
            node.parent.parent.score += points / 2


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _weight(node: Node) -> float:
    base = node.score * (1 - _density(node))
    return base * 1.5 if node.name in ("article", "main") or LIKELY.search(node.named()) else base


def blocks(roots: list) -> list[str]:
    """Texts of the blocks below, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif type(x) is str:
            held.append(x)
        elif x.name == "br":
            held.append(" ")
        elif not x.cut:
            if x.name in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.children))
    flush()
    return out


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    nodes = _walk(root)
    _measure(nodes)
    _score(nodes)
    best = max((x for x in nodes if x.score > 0), key=_weight, default=None)
    if best is None:
        return "\n".join(blocks([root]))
    chosen: list = [best]
    # an article element around the best container is the article
    up = best.parent
    while up is not None and up is not root:
        if up.name in ("article", "main"):
            chosen = [best := up]
        up = up.parent
    if best.parent is not None and best.name not in ("article", "main"):
        chosen = [x for x in best.parent.children if type(x) is str or x is best or not (x.cut or _density(x) > LINKED)]
    return "\n".join(blocks(chosen))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and n_chars (code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
