"""Main text of web pages by tree scoring.

A page is read into a tree of blocks. Every text block (what lies between block tags) earns points for its
length and its commas; its container gets them whole, the containers above in halves and smaller parts.
Each container's points are lowered by its link density. The container with most points is the article, or
the widest box around it that adds no list of links, as articles may lie in several sections;
its siblings that score well enough by the same measure are kept with it, and so are headings and other
text beside it with few links. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out before scoring, by tag or by the words of their class, id and role; a form that holds most of
the page's text and prose is its frame and stays. Embedded elements (``ASIDE``) are left out if their own end tag closes them.

Defined cases: a null or empty page, and one without a text block, give an empty text; broken nesting is
closed at the next end tag that fits, and what is open at the end of a page ends there, so a page cut
short keeps its text, also after an embedded element that is never closed; a page without any container gives its body's blocks; repeated rows get the same
result; an empty table gives an empty result. Only ``html`` is read, other columns are passed on.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML's elements by their role here
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
ASIDE = frozenset("noscript iframe template noembed noframes svg object canvas audio video".split())
LEFT_OUT = RAW | frozenset("head nav footer aside button select option menu dialog label fieldset input".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th "
                  "thead tr ul".split())
#: Elements that are never left out for their names: those hold the whole page or its main part.
WHOLE = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3".split())
CONTAINER = frozenset("article body div form main section td blockquote center".split())
#: Elements of running text. Inside an article only the words of adverts, notices and the like leave them out.
TEXT = frozenset("blockquote h1 h2 h3 h4 h5 h6 p pre".split())
#: Words of a class, id or role that leave an element out.
UNWANTED = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie "
                     "cookies disclaimer footer gdpr header masthead menu nav navbar navigation newsletter notice notification "
                     "pagination pager popup promo promoted related reply share sharing sidebar signup "
                     "social sponsor sponsored subscribe toolbar widget alert complementary contentinfo search".split())
PAID = frozenset("ad ads advert adverts advertisement advertising consent cookie cookies gdpr newsletter notice promo promoted related share "
                 "sharing signup social sponsor sponsored subscribe".split())
#: Words that name the top of an article when they are inside it.
TOP = frozenset("header masthead".split())
#: Names with these words are about something else than the element (``has-sidebar``).
ABOUT = frozenset("has with no without".split())
READERS = frozenset("comment comments commentlist disqus respond replies".split())
#: Words that keep an element in although another word of the same name is unwanted (not for readers' comments).
WANTED = frozenset("article body content entry main post story text".split())

BLOCK_POINTS, CHARS_PER_POINT, MOST_LENGTH_POINTS = 1.0, 100, 30.0
#: Share of a block's points for its container, the one above it, and so on.
SHARES = (1.0, 0.5, 0.33, 0.25)
SIBLING_SHARE = 0.2
PROSE_CHARS, PROSE_LINKS = 80, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")


class _Node:
    __slots__ = ("tag", "parent", "out", "aside", "points", "chars", "links", "own", "article")

    def __init__(self, tag: str, parent: _Node | None, out: bool):
        self.tag, self.parent, self.out, self.aside = tag, parent, out, False
        self.points = 0.0
        self.chars = self.links = 0
        self.own: list[tuple[int, str, int]] = []
        self.article = tag == "article" or parent is not None and parent.article


def _unwanted(attributes: str, unwanted: frozenset = UNWANTED) -> bool:
    for m in _ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            words = set(_WORDS.findall(name))
            if not words & ABOUT and (words & READERS or words & unwanted and not words & WANTED):
                return True
    return False


def blocks_of(page: str) -> tuple[list[_Node], list[tuple[_Node, str, int]]]:
    """Nodes in page order, and the text blocks as (innermost block element, text, characters inside links)."""
    root = _Node("html", None, False)
    nodes, found, here = [root], [], root
    pieces: list[str] = []
    linked, depth_a, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text and not here.out:
                found.append((here, text, min(linked, len(text))))
            pieces.clear()
        linked = 0

    def data(raw: str) -> None:
        nonlocal linked
        if raw and not here.out:
            pieces.append(raw)
            if depth_a:
                linked += len(raw.strip())

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            data(page[at:])
            break
        data(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name == "a":
                depth_a = max(0, depth_a - 1)
            elif name in BLOCK or name in LEFT_OUT or name in ASIDE:
                flush()
                node = here
                while node is not None and node.tag != name:
                    node = node.parent
                if node is not None and node.parent is not None:
                    node.aside = name in ASIDE
                    here = node.parent
                    depth_a = 0
            continue
        if name == "a":
            depth_a += 1
            continue
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if name in RAW:
            flush()
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in ASIDE and m[3].endswith("/"):
            continue
        if name in BLOCK or name in LEFT_OUT or name in ASIDE:
            flush()
            if name == "p" and here.tag == "p" or name == "li" and here.tag == "li":
                here = here.parent
            elif name in ("html", "body") and here.parent is None and here.tag == name:
                continue
            depth_a = 0
            here = _Node(name, here, here.out or name in LEFT_OUT or name == "header" and not here.article
                         or name not in WHOLE and _unwanted(m[3], UNWANTED if not here.article else PAID if name in TEXT else UNWANTED - TOP))
            nodes.append(here)
    flush()
    for node in nodes[1:]:
        node.out = node.out or node.aside or node.parent.out
    found = [x for x in found if not x[0].out]
    _leave_forms(nodes, found)
    return nodes, [x for x in found if not x[0].out]


def _leave_forms(nodes: list[_Node], found: list[tuple[_Node, str, int]]) -> None:
    """Forms are left out, but for one around the page: it holds most of the text, and prose."""
    inside: dict[_Node, list[int]] = {}
    for node, text, _ in found:
        while node is not None:
            if node.tag == "form":
                inside.setdefault(node, []).append(len(text))
            node = node.parent
    total = sum(len(text) for _, text, _ in found)
    for node in nodes[1:]:
        own = inside.get(node, [0])
        small = node.tag == "form" and (2 * sum(own) <= total or max(own) < PROSE_CHARS)
        node.out = node.out or small or node.parent.out


def _container(node: _Node) -> _Node:
    while node.tag not in CONTAINER and node.parent is not None:
        node = node.parent
    return node


def _whole(best: _Node, nodes: list[_Node]) -> _Node:
    """The widest box around ``best``, short of the body, that adds no list of links to it."""
    children: dict[_Node, list[_Node]] = {}
    for x in nodes[1:]:
        if x.chars:
            children.setdefault(x.parent, []).append(x)
    while best.tag != "article" and best.parent is not None and best.parent.tag in CONTAINER - WHOLE | {"main"}:
        if any(x.links >= PROSE_LINKS * x.chars for x in children[best.parent] if x is not best):
            break
        best = best.parent
    return best


def main_text(page: str | None) -> str:
    """The article's blocks, joined by newlines."""
    nodes, found = blocks_of(page or "")
    if not found:
        return ""
    for node, text, linked in found:
        box = _container(node)
        points = BLOCK_POINTS + text.count(",") + min(len(text) / CHARS_PER_POINT, MOST_LENGTH_POINTS)
        up = box
        for share in SHARES:
            if up is None:
                break
            up.points += share * points
            up = _container(up.parent) if up.parent is not None else None
        up = node
        while up is not None:
            up.chars += len(text)
            up.links += linked
            up = up.parent
    score = lambda x: x.points * (1 - x.links / x.chars) if x.chars else 0.0
    boxes = [x for x in nodes if x.points > 0]
    best = max(boxes, key=score)
    while best.tag != "article" and best.parent is not None and best.parent.article:
        best = best.parent
    best = _whole(best, nodes)
    floor = SIBLING_SHARE * score(best)
    kept = []
    for node, text, linked in found:
        up, top = node, None
        while up is not None and up is not best:
            if up.parent is best.parent:
                top = up
            up = up.parent
        if up is best:
            kept.append(text)
        elif top is not None and best.parent is not None:
            if top.tag in HEADINGS or top.tag in CONTAINER and score(top) >= floor:
                kept.append(text)
            elif top.tag not in CONTAINER and linked < PROSE_LINKS * len(text):
                kept.append(text)
    return "\n".join(kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars``."""
    keep = [c for c in pages.columns if c != html]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*keep, F.col(html)).mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
