"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into blocks at every tag that is not inline. Each block has its number of words, its link density (the share of
its words inside links), the same of the blocks before and after it, and where it stands: inside an article, inside a tag of page
furniture, inside something that boxes other content off, inside something whose class, id or role names furniture, inside readers'
comments, or none of these. The place is a feature beside the others: one tree, grown from a small labelled table of such blocks, keeps or
drops each one. So lists of links inside an article go, and long texts with few links stay whatever tag or name is around them, but
for readers' comments. A word after or before "has", "no", "free" and the like names nothing. An article inside a box is an article.
Kept blocks are joined in page order.

Scripts, styles, comments, the head and form controls are no text. Character references are decoded, white space within a block
becomes one space. Null and empty pages give an empty text. An unclosed comment, script, tag or quoted value takes the rest of the page,
as in browsers, and quotes count as such only in values. The time is linear in the page.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import texts as T
from .decisions import Node, decide, grow

# Tags that do not end a block, tags whose contents are no text, tags and names of page furniture.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SILENT = frozenset("script style noscript template svg math head title select option button textarea iframe object audio video canvas".split())
FURNITURE = frozenset("nav footer menu dialog".split())
BOXES = frozenset("header aside form fieldset".split())
NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer "
    "header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended "
    "related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
LASTING = frozenset("comment comments disqus replies reply respond".split())
MODIFIERS = frozenset("has have no not non with without hide hides show shows open closed free off".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PLACES = {"article": 0, "none": 1, "named": 2, "boxed": 3, "furniture": 4, "comments": 5}
DEPTH = 12

#: Labelled blocks: words, link density, the same of the block before and after, place, and whether the block is main text.
TABLE = (
    # Articles: headings, paragraphs, short and long, with some links.
    (8, 0.0, 0, 0.0, 40, 0.0, "article", 1), (1, 0.0, 9, 0.0, 60, 0.0, "article", 1), (45, 0.0, 8, 0.0, 30, 0.1, "article", 1),
    (120, 0.05, 45, 0.0, 80, 0.0, "article", 1), (3, 0.0, 120, 0.0, 0, 0.0, "article", 1), (12, 0.4, 60, 0.0, 70, 0.0, "article", 1),
    (2, 0.5, 60, 0.0, 9, 1.0, "article", 1), (30, 0.0, 6, 1.0, 12, 0.0, "article", 1), (6, 0.0, 9, 0.0, 5, 0.0, "article", 1),
    (400, 0.01, 10, 0.0, 7, 1.0, "article", 1), (5, 1.0, 80, 0.0, 60, 0.0, "article", 1), (1, 0.0, 0, 0.0, 0, 0.0, "article", 1),
    (4, 1.0, 10, 0.0, 50, 0.0, "article", 1), (2000, 0.0, 90, 0.0, 100, 0.0, "article", 1), (20, 0.3, 1, 1.0, 25, 0.0, "article", 1),
    (35, 0.0, 2, 0.0, 2, 0.0, "article", 1), (28, 0.0, 12, 0.0, 3, 0.0, "article", 1), (44, 0.0, 16, 0.0, 4, 0.0, "article", 1),
    (60, 0.0, 1, 0.0, 1, 0.0, "article", 1), (18, 0.0, 0, 0.0, 0, 0.0, "article", 1), (24, 0.0, 3, 0.0, 2, 1.0, "article", 1),
    (2, 0.0, 1, 1.0, 5, 0.0, "article", 1), (6, 0.0, 2, 1.0, 9, 0.0, "article", 1), (1, 0.0, 1, 1.0, 30, 0.0, "article", 1), (9, 0.0, 2, 1.0, 1, 1.0, "article", 1),
    # Lists of links inside articles.
    (2, 1.0, 70, 0.0, 2, 1.0, "article", 0), (3, 1.0, 40, 0.0, 3, 1.0, "article", 0), (2, 1.0, 2, 1.0, 40, 0.0, "article", 0), (1, 1.0, 1, 1.0, 90, 0.0, "article", 0),
    (2, 1.0, 2, 1.0, 2, 1.0, "article", 0), (4, 1.0, 6, 1.0, 3, 1.0, "article", 0), (1, 1.0, 50, 0.0, 2, 1.0, "article", 0),
    (3, 1.0, 5, 1.0, 30, 0.0, "article", 0), (25, 0.9, 30, 0.9, 20, 0.9, "article", 0), (7, 0.9, 3, 1.0, 0, 0.0, "article", 0),
    # Under names of furniture: notices, teasers, bylines and links are none; long link-poor blocks are text, and short ones between them.
    (45, 0.0, 50, 0.0, 60, 0.0, "named", 1), (120, 0.0, 10, 0.0, 60, 0.0, "named", 1), (300, 0.02, 0, 0.0, 0, 0.0, "named", 1),
    (60, 0.1, 2, 1.0, 3, 1.0, "named", 1), (80, 0.0, 0, 0.0, 5, 0.0, "named", 1), (50, 0.0, 1, 1.0, 40, 0.0, "named", 1),
    (70, 0.0, 2, 0.0, 2, 0.0, "named", 1), (55, 0.0, 2, 0.0, 1, 1.0, "named", 1), (48, 0.0, 0, 0.0, 2, 0.0, "named", 1),
    (8, 0.0, 60, 0.0, 55, 0.0, "named", 1), (3, 0.0, 80, 0.0, 90, 0.0, "named", 1), (20, 0.0, 50, 0.0, 45, 0.0, "named", 1),
    (1, 1.0, 1, 1.0, 1, 1.0, "named", 0), (9, 0.0, 1, 1.0, 12, 0.0, "named", 0), (12, 0.0, 60, 0.0, 0, 0.0, "named", 0),
    (25, 0.2, 3, 0.0, 25, 0.2, "named", 0), (30, 0.0, 2, 0.0, 3, 0.0, "named", 0), (15, 0.0, 0, 0.0, 80, 0.0, "named", 0),
    (60, 0.7, 3, 1.0, 5, 1.0, "named", 0), (4, 0.5, 90, 0.0, 1, 1.0, "named", 0), (2, 0.0, 12, 0.0, 3, 0.0, "named", 0),
    (25, 0.0, 90, 0.0, 4, 1.0, "named", 0), (7, 1.0, 60, 0.0, 50, 0.0, "named", 0), (10, 0.0, 1, 1.0, 24, 0.0, "named", 0),
    (3, 0.0, 0, 0.0, 70, 0.0, "named", 0), (10, 0.0, 1, 1.0, 90, 0.0, "named", 0), (4, 0.0, 2, 1.0, 300, 0.0, "named", 0),
    (13, 0.0, 2, 1.0, 5, 0.0, "named", 0), (8, 0.0, 0, 0.0, 20, 0.0, "named", 0), (13, 0.0, 1, 1.0, 1, 0.0, "named", 0),
    # Headers, sidebars and forms: as under names of furniture, but only longer blocks among long ones are text.
    (1, 1.0, 1, 1.0, 1, 1.0, "boxed", 0), (9, 0.0, 1, 1.0, 12, 0.0, "boxed", 0), (12, 0.0, 60, 0.0, 0, 0.0, "boxed", 0),
    (50, 0.0, 3, 0.0, 3, 0.0, "boxed", 0), (4, 0.5, 90, 0.0, 1, 1.0, "boxed", 0), (2, 0.0, 12, 0.0, 3, 0.0, "boxed", 0),
    (25, 0.2, 3, 0.0, 25, 0.2, "boxed", 0), (7, 1.0, 7, 1.0, 7, 1.0, "boxed", 0), (15, 0.0, 0, 0.0, 80, 0.0, "boxed", 0),
    (30, 0.0, 20, 0.0, 15, 0.0, "boxed", 0), (40, 0.8, 60, 0.0, 50, 0.0, "boxed", 0), (20, 0.0, 80, 0.0, 2, 1.0, "boxed", 0),
    (90, 0.0, 70, 0.0, 80, 0.0, "boxed", 1), (300, 0.02, 0, 0.0, 90, 0.0, "boxed", 1), (120, 0.0, 60, 0.0, 2, 0.0, "boxed", 1),
    (8, 0.0, 90, 0.0, 85, 0.0, "boxed", 1), (150, 0.1, 1, 1.0, 60, 0.0, "boxed", 1),
    # Menus and footers: only very long blocks with few links, between such blocks, are text.
    (1, 1.0, 1, 1.0, 1, 1.0, "furniture", 0), (1, 1.0, 0, 0.0, 1, 1.0, "furniture", 0), (9, 0.0, 1, 1.0, 12, 0.0, "furniture", 0),
    (12, 0.0, 60, 0.0, 0, 0.0, "furniture", 0), (50, 0.0, 40, 0.0, 3, 0.0, "furniture", 0), (4, 0.5, 90, 0.0, 1, 1.0, "furniture", 0),
    (120, 0.0, 10, 0.0, 60, 0.0, "furniture", 0), (2, 0.0, 12, 0.0, 3, 0.0, "furniture", 0), (25, 0.2, 3, 0.0, 25, 0.2, "furniture", 0),
    (7, 1.0, 7, 1.0, 7, 1.0, "furniture", 0), (15, 0.0, 0, 0.0, 80, 0.0, "furniture", 0), (130, 0.0, 20, 0.0, 12, 0.0, "furniture", 0),
    (16, 0.0, 300, 0.0, 2, 1.0, "furniture", 0), (10, 0.0, 200, 0.0, 0, 0.0, "furniture", 0), (60, 0.0, 90, 0.0, 70, 0.0, "furniture", 0),
    (250, 0.0, 200, 0.0, 180, 0.0, "furniture", 1), (400, 0.02, 150, 0.0, 0, 0.0, "furniture", 1), (220, 0.0, 2, 0.0, 300, 0.0, "furniture", 1),
    # Readers' comments are none, however long.
    (12, 0.0, 60, 0.0, 0, 0.0, "comments", 0), (120, 0.0, 10, 0.0, 60, 0.0, "comments", 0), (400, 0.0, 200, 0.0, 300, 0.0, "comments", 0),
    (3, 0.0, 90, 0.0, 40, 0.0, "comments", 0), (1, 1.0, 5, 0.0, 1, 1.0, "comments", 0), (45, 0.0, 50, 0.0, 60, 0.0, "comments", 0),
    (8, 0.0, 90, 0.0, 85, 0.0, "comments", 0), (250, 0.0, 200, 0.0, 180, 0.0, "comments", 0), (60, 0.0, 2, 1.0, 3, 1.0, "comments", 0),
    # Pages without such tags: long runs of words are text, and so are short ones between long ones; links and scraps are not.
    (40, 0.0, 35, 0.0, 50, 0.0, "none", 1), (18, 0.0, 25, 0.0, 30, 0.0, "none", 1), (90, 0.1, 3, 1.0, 60, 0.0, "none", 1),
    (150, 0.0, 0, 0.0, 0, 0.0, "none", 1), (7, 0.0, 4, 1.0, 45, 0.0, "none", 1), (9, 0.0, 60, 0.0, 55, 0.0, "none", 1),
    (25, 0.2, 60, 0.0, 6, 0.6, "none", 1), (22, 0.0, 0, 0.0, 20, 0.0, "none", 1), (5, 0.0, 40, 0.0, 30, 0.0, "none", 1),
    (30, 0.0, 60, 0.0, 1, 1.0, "none", 1), (80, 0.0, 2, 1.0, 3, 1.0, "none", 1), (26, 0.1, 40, 0.0, 2, 1.0, "none", 1),
    (2, 1.0, 2, 1.0, 2, 1.0, "none", 0), (6, 0.8, 30, 0.0, 5, 1.0, "none", 0), (3, 0.0, 2, 1.0, 2, 1.0, "none", 0),
    (8, 0.0, 50, 0.0, 2, 1.0, "none", 0), (20, 0.7, 40, 0.0, 18, 0.8, "none", 0), (4, 0.0, 0, 0.0, 2, 1.0, "none", 0),
    (6, 0.0, 3, 0.0, 4, 0.0, "none", 0), (35, 0.9, 30, 0.9, 40, 0.8, "none", 0), (3, 0.0, 5, 0.0, 0, 0.0, "none", 0),
    (5, 1.0, 40, 0.0, 35, 0.0, "none", 0), (7, 0.0, 60, 0.0, 0, 0.0, "none", 0), (10, 0.6, 2, 1.0, 60, 0.0, "none", 0),
)

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", re.S)
#: The rest of a tag: quotes that follow an equals sign hold a value, which may hold the sign that ends a tag.
_REST = re.compile(r"""((?:[^>=]|=\s*"[^"]*"|=\s*'[^']*'|=(?!\s*["']))*+)>""", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def place_of(tag: str, attributes: str, outer: tuple[int, bool]) -> tuple[int, bool]:
    """The place of what is inside a tag, and whether an article inside it stays there."""
    if outer[1]:
        return outer
    names = set()
    if attributes and tag not in ("body", "html"):
        for m in _NAMED.finditer(attributes):
            for token in (m[1] or m[2] or m[3] or "").split():
                own = [w.lower() for w in _WORD.findall(token)]
                if not MODIFIERS.intersection(own):
                    names.update(own)
    if names & LASTING:
        return (PLACES["comments"], True)
    if tag in FURNITURE:
        return (PLACES["furniture"], True)
    if tag in BOXES:
        return (PLACES["boxed"], False)
    if names & NAMES:
        return (PLACES["named"], False)
    return (PLACES["article"], False) if tag in ("article", "main") else outer


def blocks(page: str) -> tuple[list[str], list[tuple[int, float, int]]]:
    """Texts of a page's blocks, and words, link density and place of each."""
    found, shape = [], []
    stack: list[tuple[str, tuple[int, bool]]] = []
    place, links, parts, linked, at = (PLACES["none"], False), 0, [], [], 0
    open_tags: dict[str, int] = {}

    def end():
        nonlocal parts, linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            found.append(text)
            shape.append((n, min(1.0, len(html.unescape("".join(linked)).split()) / n), place[0]))
        parts, linked = [], []

    def put(text):
        parts.append(text)
        if links:
            linked.append(text)

    size = len(page)
    while at < size:
        m = _PIECE.search(page, at)
        if m is None:
            put(page[at:])
            break
        if m.start() > at:
            put(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        rest = _REST.match(page, at)
        if rest is None:
            break
        at, attributes = rest.end(), rest[1]
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if m[1] else links + 1
                linked.append(" ")
            continue
        end()
        if tag in SILENT:
            if not m[1] and not attributes.endswith("/"):
                close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
                at = close.end() if close else size
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if m[1]:
            if open_tags.get(tag):  # a tag that closes nothing costs nothing
                links, closed = 0, None
                while closed != tag:
                    closed, place = stack.pop()
                    open_tags[closed] -= 1
        elif tag != "p":
            stack.append((tag, place))
            open_tags[tag] = open_tags.get(tag, 0) + 1
            place = place_of(tag, attributes, place)
    end()
    return found, shape


def features(shape: list[tuple[int, float, int]]) -> np.ndarray:
    """Words and link density of each block and its neighbours, and its place."""
    own = np.array(shape, float).reshape(-1, 3)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own[:-1, :2]]), np.concatenate([own[1:, :2], edge])
    return np.concatenate([own[:, :2], before, after, own[:, 2:]], axis=1)


def tree(table=TABLE) -> Node:
    """One tree over all features; the place is one of them."""
    rows = np.array([(*r[:6], PLACES[r[6]], r[7]) for r in table], float)
    return grow(rows[:, :7], rows[:, 7], DEPTH)


def main_text(page: str, model: Node) -> str:
    found, shape = blocks(page)
    if not found:
        return ""
    return " ".join(t for t, keep in zip(found, decide(model, features(shape)).tolist(), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    def work():
        model = tree()

        def step(data, offsets):
            raw = bytes(data)
            texts = [main_text(raw[a:b].decode("utf-8", "replace"), model) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return [pa.array(texts, pa.string()), np.array([len(x) for x in texts], np.int64)]

        return step

    return T.per_text(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html"), ["page_id", "url", "html"], "page_id long, url string, text string, n_chars long", work)
