"""Main-text extraction by scores on the element tree.

Paragraphs give points for their length and commas to the elements around them, less with each
level; an element's points are discounted by the share of its text that is link text. The best
element is the article; what stands beside it stays, unless it is furniture or mostly links. Only
elements that hold no text of a page by their tag (scripts, menus, footers, hidden parts) are left
out before. Furniture by role, whole class name or id (sidebars, notices, adverts, comments), and
forms, asides and page headers count a fifth of their points. They are left out of the chosen
article, but not if they hold most of its running text; an article, main or section only if it is
named as reader comments.

Defined results: null or empty html, and pages without running text, give an empty text. Broken
markup is read the way browsers repair it: a new block ends an open paragraph, list item or cell,
unclosed elements end with their parent, and a tag or comment that never ends takes the rest along.
Very long, deep or broken pages are read whole, in time linear in their length. Each row gives one row. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*(=)\s*)?)?")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Names of HTML: what they are is fixed by the standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCK = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead
tr ul caption br""".split())
SELF_ENDING = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
               "option": {"select"}}
#: Elements and names that are not part of an article; the second set may still wrap one.
FURNITURE_TAGS = frozenset("""nav footer script style noscript template iframe button select option textarea input
svg canvas object embed head title dialog menu""".split())
WEAK_TAGS = frozenset("aside form label fieldset".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
FURNITURE = frozenset("""ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored sponsors promo promos
promoted promotion nav navbar navigation menu menus header masthead topbar footer sidebar aside rail cookie cookies consent gdpr notice notices
notification alert popup modal overlay subscribe subscription newsletter signup login signin register share sharing
social related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget widgets copyright legal
disclaimer search form hidden skip discussion feedback reviews""".split())
COMMENTS = frozenset("comment comments disqus reply replies respond".split())
#: Words that say where or how a part is shown; a name of them alone is no furniture.
PLACES = frozenset("""site page main global top bottom left right primary secondary first second upper lower block box bar area list
item items links link wrapper wrap container inner outer section thread form widget col column banner post posts text icons buttons""".split())
DISCOUNT = 0.2
SOLID = frozenset("html body main article section".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: What an open element of the name cannot be closed through by a new one.
SCOPES = {"p": frozenset({"td", "th", "button", "object", "caption"}), **{k: frozenset(v) for k, v in SELF_ENDING.items()}}
SAME = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}


class Node:
    __slots__ = ("tag", "attrs", "parent", "items", "score", "weak", "near")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.items, self.score, self.weak = tag, attrs, parent, [], 0.0, False
        # Open elements that a new one may close, by name; shared with the parent while nothing changes.
        near = parent.near if parent is not None else {}
        if any(tag in SCOPES[name] for name in near):
            near = {name: node for name, node in near.items() if tag not in SCOPES[name]}
        self.near = {**near, tag: self} if tag in SCOPES else near


def _attributes(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from ``at`` on, whether the tag ends itself, and the place behind it; -1 if it never ends."""
    found: dict[str, str] = {}
    while True:
        m = _ATTRIBUTE.match(html, at)
        at = m.end()
        if m[1]:
            return found, html[at - 2] == "/", at
        if m[2] is None:
            return found, False, -1
        value = ""
        if m[3]:
            quote = html[at:at + 1]
            if quote in ('"', "'") and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return found, False, -1
                value, at = html[at + 1:end], end + 1
            else:
                bare = _BARE.match(html, at)
                value, at = bare[0], bare.end()
        found[m[2].lower()] = unescape(value)


def parse(html: str) -> Node:
    """Elements and texts of a page as a tree, in time linear in the page. A tag that never ends takes the rest along."""
    root = node = Node("#root", {}, None)
    open_: dict[str, list[Node]] = {}
    at, end = 0, len(html)

    def leave(target: Node) -> None:
        nonlocal node
        while node is not target:
            open_[node.tag].pop()
            node = node.parent

    while at < end:
        start = html.find("<", at)
        if start < 0:
            node.items.append(html[at:])
            break
        if start > at:
            node.items.append(html[at:start])
        if html.startswith("<!--", start):
            at = html.find("-->", start + 4) + 3
            if at < 3:
                break
            continue
        closing = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + closing)
        if name is None:
            if html[start + 1:start + 2] in ("!", "?") or closing and start + 2 < end:
                at = html.find(">", start) + 1
                if not at:
                    break
            else:
                node.items.append("<")
                at = start + 1
            continue
        tag = name[0].lower()
        attrs, ended, at = _attributes(html, name.end())
        if at < 0:
            break
        if closing:
            if open_.get(tag):
                leave(open_[tag][-1].parent)
            continue
        if tag in BLOCK and tag != "br" and "p" in node.near:
            leave(node.near["p"].parent)
        for same in SAME.get(tag, (tag,)) if tag in SELF_ENDING else ():
            if same in node.near:
                leave(node.near[same].parent)
        child = Node(tag, attrs, node)
        node.items.append(child)
        if tag in RAW:
            stop = re.compile(f"</{re.escape(tag)}[\\s/>]", re.IGNORECASE).search(html, at)
            at = html.find(">", stop.start()) + 1 or end if stop else end
        elif tag not in VOID and not ended:
            open_.setdefault(tag, []).append(child)
            node = child
    return root


def _named(node: Node, kind: frozenset) -> bool:
    """Is a whole class name or the id made of words of the kind, and of places at most?"""
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        words = set(_WORD.findall(_CAMEL.sub(" ", name).lower()))
        if words & kind and words <= kind | PLACES | FURNITURE:
            return True
    return False


def _furniture(node: Node) -> bool:
    attrs = node.attrs
    return node.tag in FURNITURE_TAGS or bool(attrs) and (
        "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""))


def _comments(node: Node) -> bool:
    return bool(node.attrs) and node.tag not in ("html", "body") and _named(node, COMMENTS)


def _weak(node: Node, heads: set[int], inside: bool) -> bool:
    """Counts less, and is left out where it is not most of the text. ``inside``: of an article or main."""
    if _comments(node):
        return True
    if node.tag in SOLID or id(node) in heads:
        return False
    if node.tag == "header":
        return not inside
    return node.tag in WEAK_TAGS or bool(node.attrs) and (
        node.attrs.get("role", "").lower() in FURNITURE_ROLES or _named(node, FURNITURE))


def _prune(root: Node) -> list[Node]:
    """Take furniture out and mark weak elements; the elements left, parents before children."""
    every, stack = [], [root]
    while stack:
        node = stack.pop()
        every.append(node)
        stack += [x for x in reversed(node.items) if isinstance(x, Node)]
    heads = set()  # a wrapper around the article is never furniture, whatever its name
    for node in every:
        if node.tag in ("article", "main") and not _comments(node):
            up = node.parent
            while up is not None and id(up) not in heads:
                heads.add(id(up))
                up = up.parent
    left, inner, stack = [], set(), [root]
    while stack:
        node = stack.pop()
        node.items = [x for x in node.items if not isinstance(x, Node) or not _furniture(x)]
        node.weak = _weak(node, heads, id(node) in inner)
        left.append(node)
        own = [x for x in reversed(node.items) if isinstance(x, Node)]
        if id(node) in inner or node.tag in ("article", "main"):
            inner.update(map(id, own))
        stack += own
    return left


def _lengths(nodes: list[Node]) -> dict[int, tuple[int, int, int]]:
    """Characters, characters inside links, and commas, of each element with all in it."""
    found: dict[int, list[int]] = {}
    for node in reversed(nodes):  # children first
        n = links = commas = 0
        for x in node.items:
            if isinstance(x, Node):
                a, b, c = found[id(x)]
                n, links, commas = n + a, links + b, commas + c
            else:
                text = x.strip()
                n, commas = n + len(text), commas + text.count(",")
        found[id(node)] = (n, n if node.tag == "a" else links, commas)
    return found


def _score(nodes: list[Node], sizes: dict[int, tuple[int, int, int]]) -> list[Node]:
    scored, faint = {}, set()
    for node in nodes:
        if node.weak or node.parent is not None and id(node.parent) in faint:
            faint.add(id(node))
        own = sum(len(x.strip()) for x in node.items if not isinstance(x, Node))
        if node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article", "body", "main") and own >= 25):
            continue
        n, links, commas = sizes[id(node)]
        if node.tag not in PARAGRAPHS:
            n, links = own, 0
        if not n:
            continue
        points = (1 + commas + min(n / 100, 3)) * (1 - links / n)
        if id(node) in faint:
            points *= DISCOUNT
        up, level = node.parent if node.tag in PARAGRAPHS else node, 0
        while up is not None and level < 5:
            up.score += points / (1, 2, 6, 9, 12)[level]
            scored[id(up)] = up
            up, level = up.parent, level + 1
    for node in scored.values():
        n, links, _ = sizes[id(node)]
        node.score *= 1 - links / n if n else 0
    return list(scored.values())


def _text(nodes: list, sizes: dict[int, tuple[int, int, int]]) -> str:
    """The text of the elements (and bare texts) without weak parts, or with them if there is nothing else."""
    running = sum(sizes[id(x)][0] - sizes[id(x)][1] if isinstance(x, Node) else len(x.strip()) for x in nodes)

    def left(x: Node) -> bool:
        n, links, _ = sizes[id(x)]
        return x.weak and (2 * (n - links) <= running or _comments(x))

    return _blocks(nodes, left) or _blocks(nodes, lambda x: False)


def _blocks(nodes: list, left: Callable[[Node], bool]) -> str:
    """Blocks in page order, white space inside a block made one space, blocks joined by one."""
    blocks, part = [], []

    def end():
        words = unescape("".join(part)).split()
        if words:
            blocks.append(" ".join(words))
        part.clear()

    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            part.append(x)
        else:
            if x.tag in BLOCK:
                end()
                stack.append(None)
            stack += [y for y in reversed(x.items) if not isinstance(y, Node) or not left(y)]
    end()
    return " ".join(blocks)


def main_text(html: str | None) -> str:
    """The article's text; empty if there is none."""
    if not html:
        return ""
    nodes = _prune(parse(html))
    sizes = _lengths(nodes)
    scored = _score(nodes, sizes)
    if not scored:
        tops = [n for n in nodes if n.tag in ("article", "main", "body")] or nodes[:1]
        return _text(tops[:1], sizes)
    best = max(scored, key=lambda n: n.score)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    if best.parent is None or best.tag in ("body", "html"):
        return _text([best], sizes)
    kept, heads = [], []
    for x in best.parent.items:
        if isinstance(x, Node):
            n, links, _ = sizes[id(x)]
            if x is best or not x.weak and n and 2 * links < n and x.tag not in HEADINGS:
                kept += [*heads, x]
                heads = []
            elif x.tag == "h1" and n:
                kept.append(x)
            elif x.tag in HEADINGS and not x.weak:  # stays with what it stands above
                heads.append(x)
            elif n:
                heads = []
        elif x.strip():
            kept += [*heads, x]
            heads = []
    return _text(kept, sizes)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").alias("html"))
    return rows.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
