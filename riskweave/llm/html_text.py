"""Main text of web pages from flat text blocks and a decision tree.

A page is read once into blocks of text. Each block is described by its number of words and
its share of words in links, the same of the blocks before and after it, whether it is a
heading, where it stands (in an article, outside of the page's article, in a part made for
something else by its element, or in a page without such marks), and ``held``: the share of
the page's link-poor words that the nearest part around it holds whose class, id or
``<form>`` names something else, 1 if there is none. A part that holds nearly all of them is
a wrapper around the article, whatever its name says. A decision tree fitted on the small
labelled table below decides which blocks are article text.

Null and empty pages, and pages without a kept block, give an empty text of 0 characters; an
empty table gives an empty result. Pages are read whole, cut-off pages as far as they go.
Rows are judged one by one: repeated rows give repeated results; null ids and urls are
carried through. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_arrow, table

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>?|<[!?][^>]*>?""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[a-z]+")

UNSEEN = frozenset("script style noscript template svg math title textarea select button iframe object canvas audio video map".split())
#: Without an end tag these take the rest of the page; other unseen elements end at the next tag of a page's body.
RAW = frozenset("script style".split())
_BODY_TAG = re.compile(r"</?(?:html|body|head|main|article|section|div|header|footer|nav|aside|p|h[1-6]|ul|ol|dl|table|form|figure|blockquote|pre|hr)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ASIDE = frozenset("nav aside footer menu dialog".split())
#: Parts of class and id names of reader comments, which are never article text.
COMMENT_PARTS = frozenset("comment comments reply replies disqus respond".split())
#: Parts of class and id names of page parts that are not article text, unless they hold nearly all of it.
OTHER_PARTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr
notice notices alert popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs
footer header masthead topbar related recommended share sharing social newsletter subscribe subscription signup login search widget
toolbar pager pagination tags copyright disclaimer skip""".split())

#: Parts of class and id names of page parts that hold the article.
ARTICLE_PARTS = frozenset("article content entry post story".split())

OTHER, OUTSIDE, UNMARKED, INSIDE = -2, -1, 0, 1
FEATURES = ["held", "place", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after"]

#: The labelled table: features in the order above but for ``held``, which is 1 here, then 1 for article text.
UNNAMED = [
    # in an article
    (1, 1, 9, 0.0, 0, 0.0, 80, 0.0, 1), (1, 0, 80, 0.0, 9, 0.0, 2, 0.0, 1), (1, 0, 1, 0.0, 60, 0.0, 30, 0.1, 1),
    (1, 0, 3, 0.0, 2, 0.0, 1, 0.0, 1), (1, 0, 40, 0.4, 3, 0.0, 90, 0.0, 1), (1, 0, 2, 1.0, 50, 0.0, 44, 0.0, 1),
    (1, 0, 300, 0.02, 1, 0.0, 0, 0.0, 1), (1, 1, 4, 1.0, 70, 0.0, 20, 0.0, 1), (1, 0, 12, 0.2, 6, 1.0, 5, 0.0, 1),
    (1, 0, 6, 0.5, 10, 1.0, 8, 1.0, 1), (1, 0, 25, 0.0, 3, 1.0, 3, 1.0, 1), (1, 0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    # in parts made for something else
    (-2, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (-2, 0, 1, 1.0, 1, 1.0, 9, 0.0, 0), (-2, 0, 30, 0.0, 1, 1.0, 8, 0.0, 0),
    (-2, 0, 120, 0.05, 40, 0.0, 60, 0.0, 0), (-2, 1, 4, 0.0, 200, 0.0, 1, 1.0, 0), (-2, 0, 14, 0.2, 70, 0.0, 0, 0.0, 0),
    (-2, 0, 60, 0.0, 6, 0.0, 55, 0.0, 0), (-2, 0, 5, 0.0, 3, 0.0, 2, 0.0, 0), (-2, 1, 7, 0.0, 1, 1.0, 50, 0.0, 0),
    # outside of the article of a page that marks one
    (-1, 0, 25, 0.0, 1, 1.0, 9, 0.0, 0), (-1, 0, 90, 0.0, 70, 0.0, 12, 0.3, 0), (-1, 1, 5, 0.0, 3, 1.0, 10, 0.0, 0),
    (-1, 0, 2, 1.0, 1, 1.0, 40, 0.0, 0), (-1, 0, 40, 0.1, 200, 0.0, 0, 0.0, 0), (-1, 0, 8, 0.0, 60, 0.0, 20, 0.0, 0),
    # pages without such marks: long blocks of few links, and what is short beside them
    (0, 0, 60, 0.0, 40, 0.0, 70, 0.0, 1), (0, 0, 35, 0.1, 2, 1.0, 50, 0.0, 1), (0, 0, 22, 0.0, 30, 0.0, 18, 0.0, 1),
    (0, 0, 18, 0.05, 25, 0.0, 3, 1.0, 1), (0, 1, 6, 0.0, 2, 1.0, 45, 0.0, 1), (0, 1, 3, 0.0, 50, 0.0, 60, 0.1, 1),
    (0, 0, 4, 0.0, 55, 0.0, 38, 0.0, 1), (0, 0, 1, 0.0, 28, 0.0, 33, 0.0, 1), (0, 0, 150, 0.2, 1, 0.0, 2, 0.0, 1),
    (0, 0, 16, 0.0, 1, 0.0, 20, 0.0, 1), (0, 0, 26, 0.15, 8, 0.0, 9, 0.0, 1), (0, 1, 10, 0.0, 0, 0.0, 21, 0.0, 1),
    (0, 0, 23, 0.05, 2, 0.0, 1, 0.0, 1), (0, 0, 30, 0.1, 1, 0.0, 1, 0.0, 1), (0, 0, 15, 0.1, 3, 0.0, 2, 0.0, 1),
    (0, 0, 1, 1.0, 1, 1.0, 1, 1.0, 0), (0, 0, 3, 1.0, 40, 0.0, 2, 1.0, 0), (0, 0, 30, 0.9, 2, 1.0, 5, 0.6, 0),
    (0, 0, 12, 0.6, 5, 0.8, 7, 0.5, 0), (0, 0, 3, 0.0, 1, 1.0, 2, 1.0, 0), (0, 0, 6, 0.0, 4, 0.5, 1, 0.0, 0),
    (0, 0, 8, 0.3, 60, 0.0, 0, 0.0, 0), (0, 0, 5, 0.0, 2, 0.0, 3, 0.0, 0), (0, 1, 2, 0.0, 40, 0.0, 1, 1.0, 0),
    (0, 1, 2, 0.0, 1, 1.0, 2, 1.0, 0), (0, 0, 40, 0.7, 30, 0.0, 25, 0.0, 0), (0, 0, 2, 0.0, 0, 0.0, 4, 1.0, 0),
]

#: Blocks in parts whose names say something else, with ``held``: long, link-poor blocks too are no
#: article text where the part holds some of the page's words, but are where it holds about all.
NAMED = [
    (0.02, 1, 0, 30, 0.0, 80, 0.0, 70, 0.0, 0), (0.1, 0, 0, 60, 0.0, 40, 0.0, 70, 0.0, 0), (0.3, 0, 0, 35, 0.1, 2, 1.0, 50, 0.0, 0),
    (0.4, 1, 0, 80, 0.0, 9, 0.0, 2, 0.0, 0), (0.5, 0, 1, 6, 0.0, 2, 1.0, 45, 0.0, 0), (0.6, 1, 1, 9, 0.0, 0, 0.0, 80, 0.0, 0),
    (0.7, 0, 0, 150, 0.2, 1, 0.0, 2, 0.0, 0), (0.8, 1, 0, 120, 0.05, 40, 0.0, 60, 0.0, 0), (0.0, 0, 0, 2, 1.0, 3, 1.0, 2, 1.0, 0),
    (0.0, -1, 0, 25, 0.0, 1, 1.0, 9, 0.0, 0), (0.2, 1, 0, 6, 0.5, 10, 1.0, 8, 1.0, 0), (0.8, 0, 0, 22, 0.0, 30, 0.0, 18, 0.0, 0),
    (0.9, 1, 0, 80, 0.0, 9, 0.0, 2, 0.0, 1), (0.9, 0, 0, 60, 0.0, 40, 0.0, 70, 0.0, 1), (0.95, 0, 0, 35, 0.1, 2, 1.0, 50, 0.0, 1),
    (0.95, 1, 1, 9, 0.0, 0, 0.0, 80, 0.0, 1), (0.98, 0, 1, 6, 0.0, 2, 1.0, 45, 0.0, 1), (0.98, 1, 0, 120, 0.05, 40, 0.0, 60, 0.0, 1),
]
LABELLED = [(1.0, *row) for row in UNNAMED] + NAMED


def fit_tree(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple | int:
    """A tree of (feature, threshold, below, above) by least Gini impurity; leaves are labels."""
    if depth == 0 or len(set(labels.tolist())) == 1:
        return int(labels.mean() >= 0.5)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] < t
            gini = sum(len(p) * p.mean() * (1 - p.mean()) for p in (labels[low], labels[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = gini, f, t
    if best is None:
        return int(labels.mean() >= 0.5)
    _, f, t = best
    low = rows[:, f] < t
    return f, float(t), fit_tree(rows[low], labels[low], depth - 1), fit_tree(rows[~low], labels[~low], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | int:
    data = np.array(LABELLED, float)
    return fit_tree(data[:, :-1], data[:, -1])


def decide(node, row) -> bool:
    while isinstance(node, tuple):
        f, t, low, high = node
        node = low if row[f] < t else high
    return bool(node)


def _place_of(tag: str, attributes: str, above: int) -> tuple[int, bool]:
    """Where the contents of an element stand, given where it stands itself, and whether its
    name says that it is made for something else."""
    if above == OTHER:
        return OTHER, False
    if tag in ASIDE or (tag == "header" and above != INSIDE):
        return OTHER, False
    marked = set()
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id"):
                marked.update(_NAME_PARTS.findall(value))
            elif name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"):
                return OTHER, False
            elif (name == "hidden") or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
                return OTHER, False
    if tag in ("html", "body"):
        return above, False
    if marked & COMMENT_PARTS:
        return OTHER, False
    if tag in ("article", "main"):
        return INSIDE, False
    place = INSIDE if marked & ARTICLE_PARTS and tag in ("div", "section") else above
    return place, tag == "form" or bool(marked & OTHER_PARTS)


class Block(NamedTuple):
    text: str
    words: int
    links: float  # share of words in links
    place: int
    heading: int
    held: float


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out, words_in, linked = [], [], 0
    stack: list[tuple[str, int, int]] = []
    above: list[int] = []  # the named part around each named part, -1 for none
    place, part, heading, in_link = UNMARKED, -1, 0, 0

    def flush():
        nonlocal words_in, linked
        if words_in:
            text = " ".join("".join(words_in).split())
            if text:
                n = text.count(" ") + 1
                out.append((text, n, min(1.0, linked / n), place, heading, part))
        words_in, linked = [], 0

    def take(piece: str):
        nonlocal linked
        piece = html.unescape(piece) if "&" in piece else piece
        words_in.append(piece)
        if in_link:
            linked += len(piece.split())

    def enter(tag: str, found: tuple[int, bool]):
        nonlocal place, part
        stack.append((tag, place, part))
        place = found[0]
        if found[1]:
            above.append(part)
            part = len(above) - 1

    at, size, ends = 0, len(page), {}
    while at < size:
        found = _TOKEN.search(page, at)
        if not found:
            take(page[at:])
            break
        if found.start() > at:
            take(page[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(found[1])
        if tag in UNSEEN:
            if not closing and not found[3].endswith("/"):
                at = _end_of(page, tag, at, ends)
            if tag not in INLINE:
                flush()
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag in INLINE:
            if tag in ("br", "wbr", "img"):
                words_in.append(" " if tag != "wbr" else "")
            elif not closing and found[3] and place != OTHER and ((own := _place_of(tag, found[3], place))[0] == OTHER or own[1]):
                flush()  # an inline element made for something else stands by itself
                enter(tag, own)
            elif closing and stack and stack[-1][0] == tag:
                flush()
                _, place, part = stack.pop()
            continue
        flush()
        if tag in HEADINGS:
            heading = 0 if closing else 1
        if tag in VOID or (tag == "p" and not closing and not found[3].strip()):
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    _, place, part = stack[k]
                    del stack[k:]
                    break
        elif not found[3].endswith("/"):
            if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                _, place, part = stack.pop()
            enter(tag, _place_of(tag, found[3], place))
    flush()
    return _weighed(out, above)


def _end_of(page: str, tag: str, at: int, ends: dict) -> int:
    """Where an unseen element that begins before ``at`` ends. ``ends`` keeps the next end tag of each
    element, so that many unclosed ones don't search the page again and again."""
    end = ends.get(tag)
    if tag not in ends or end and end.start() < at:
        end = ends[tag] = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
    if tag in RAW:
        return end.end() if end else len(page)
    body = _BODY_TAG.search(page, at, end.start() if end else len(page))
    if end and body and re.compile(rf"<{re.escape(tag)}\b", re.I).search(page, body.end(), end.start()):
        end = None  # that is the end of a later one
    return end.end() if end else body.start() if body else len(page)


def _weighed(found: list[tuple], above: list[int]) -> list[Block]:
    """The blocks with the share of words that the named part around each holds: of the words of
    articles if the page marks one, else of all that stand in no part made for something else."""
    marked = any(b[3] == INSIDE for b in found)
    held, total = [0.0] * len(above), 0.0
    for _, n, share, place, _, part in found:
        if place == (INSIDE if marked else UNMARKED):
            words = n * (1 - share)
            total += words
            if part >= 0:
                held[part] += words
    for k in range(len(above) - 1, -1, -1):  # an outer part comes before those in it
        if above[k] >= 0:
            held[above[k]] += held[k]
    return [
        Block(text, n, share, OUTSIDE if marked and place == UNMARKED else place, heading, 1.0 if part < 0 else held[part] / total if total else 0.0)
        for text, n, share, place, heading, part in found
    ]


def main_text(page: str, node=None) -> str:
    node = tree() if node is None else node
    found = blocks(page)
    kept = []
    for k, b in enumerate(found):
        before = found[k - 1][1:3] if k else (0, 0.0)
        after = found[k + 1][1:3] if k + 1 < len(found) else (0, 0.0)
        if decide(node, (b.held, b.place, b.heading, b.words, b.links, *before, *after)):
            kept.append(b.text)
    return "\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = tree()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [main_text(page or "", node) for page in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
