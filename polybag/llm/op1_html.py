"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into blocks at block-level tags.  What is not text, and parts that are marked as
something else than an article (menu, header, footer, sidebar, form, advert, notice, comments), are
cut away before there are blocks.  Of the blocks left, each has its words, the share of them that
stands in links, and the same of the block before and the block after (nothing at an end of the
page); no mark goes in.  A decision tree fitted on ``LABELLED``, a small table of labelled blocks,
tells main text from the rest by these six numbers.  The tree is fitted once per query by Spark ML
and sent to the tasks as a list of its nodes.

White space inside a block, tags and line breaks included as far as they are white space,
becomes one space.  A null or empty page, or one without main text, has the empty text.  Unclosed
and stray tags are read as browsers do: a paragraph ends where the next block starts, an item or
cell where the next one of its list or row does, an end tag without its start is skipped, a link
ends at the next link or where the element around it ends, and what is open at the end is closed.
A quote opens a value only after ``=``.  ``<svg/>`` and ``<math/>`` are empty; of the elements without
text, only script and style hide the rest of a page if nothing ends them.  Time and memory grow
with the length of a page, however its tags are nested or broken.  Repeated pages are rows like
others; an empty table gives none; no other column is read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polybag.llm.common import ROW, kept_whole
from polybag.session import ship_package

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after")
# Blocks of news, blog, shop and forum pages, without their marked parts: words and share of links
# of the block, of the one before and of the one after, and whether it is main text.
LABELLED = (
    # Paragraphs, and what stands between them: headings, short lines, a line before or after all.
    (60, 0.00, 45, 0.00, 52, 0.00, 1), (80, 0.05, 6, 0.00, 47, 0.00, 1), (25, 0.10, 60, 0.00, 4, 1.00, 1),
    (5, 0.00, 55, 0.00, 48, 0.00, 1), (9, 0.00, 41, 0.00, 28, 0.00, 1), (19, 0.00, 22, 0.10, 35, 0.00, 1),
    (3, 0.00, 30, 0.00, 26, 0.00, 1), (31, 0.25, 44, 0.00, 39, 0.00, 1), (58, 0.00, 2, 1.00, 3, 1.00, 1),
    (33, 0.00, 70, 0.00, 3, 1.00, 1), (40, 0.00, 2, 1.00, 45, 0.00, 1), (27, 0.05, 3, 1.00, 2, 1.00, 1),
    (7, 0.00, 0, 0.00, 64, 0.00, 1), (4, 0.00, 0, 0.00, 2, 0.00, 1), (12, 0.00, 0, 0.00, 9, 0.00, 1),
    (2, 0.00, 35, 0.00, 0, 0.00, 1), (1, 0.00, 6, 0.00, 8, 0.00, 1), (6, 0.00, 3, 0.00, 0, 0.00, 1),
    (150, 0.02, 9, 0.00, 0, 0.00, 1), (14, 0.00, 0, 0.00, 0, 0.00, 1), (3, 0.00, 0, 0.00, 0, 0.00, 1),
    (8, 0.00, 3, 1.00, 64, 0.00, 1), (11, 0.00, 2, 1.00, 80, 0.05, 1), (22, 0.30, 50, 0.00, 44, 0.00, 1),
    (10, 0.20, 33, 0.00, 29, 0.00, 1), (2, 0.00, 2, 0.00, 3, 0.00, 1), (45, 0.35, 60, 0.10, 52, 0.00, 1),
    (2, 0.00, 2, 0.00, 8, 0.25, 1), (6, 0.00, 30, 0.00, 40, 0.30, 1), (4, 0.00, 0, 0.00, 25, 0.35, 1),
    (5, 0.00, 40, 0.35, 30, 0.00, 1), (3, 0.00, 12, 0.30, 0, 0.00, 1), (9, 0.00, 20, 0.25, 18, 0.35, 1),
    (25, 0.00, 20, 1.00, 0, 0.00, 1), (40, 0.00, 18, 0.90, 30, 0.00, 1), (30, 0.00, 12, 1.00, 2, 1.00, 1),
    (18, 0.10, 6, 0.90, 22, 0.00, 1),
    # Lists of links, their headings, teasers, lines of a page's frame beside them.
    (2, 1.00, 2, 1.00, 3, 1.00, 0), (3, 1.00, 50, 0.00, 2, 1.00, 0), (12, 0.80, 4, 1.00, 10, 0.90, 0),
    (6, 0.50, 2, 1.00, 5, 0.60, 0), (4, 0.00, 2, 1.00, 3, 1.00, 0), (5, 0.00, 40, 0.00, 2, 1.00, 0),
    (4, 0.00, 0, 0.00, 3, 1.00, 0), (30, 0.70, 5, 1.00, 22, 0.60, 0), (2, 1.00, 60, 0.00, 55, 0.00, 0),
    (16, 0.60, 90, 0.00, 20, 0.40, 0), (9, 0.00, 4, 1.00, 0, 0.00, 0), (1, 1.00, 0, 0.00, 40, 0.00, 0),
    (8, 0.90, 0, 0.00, 0, 0.00, 0), (3, 0.00, 2, 1.00, 4, 0.80, 0), (7, 0.00, 3, 1.00, 2, 1.00, 0),
    (2, 0.00, 5, 1.00, 0, 0.00, 0), (10, 0.00, 1, 1.00, 6, 0.90, 0), (20, 0.55, 30, 0.00, 0, 0.00, 0),
    (6, 0.00, 25, 0.00, 3, 1.00, 0), (13, 0.45, 3, 1.00, 12, 0.50, 0), (5, 0.60, 8, 0.00, 7, 0.00, 0),
)
# Fixed lists of HTML.
RAW = ("script", "style", "textarea", "title", "template", "noscript", "iframe", "svg", "math",
       "object", "select", "xmp")
INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn",
    "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label", "picture",
    "source"))
VOID = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr"))
ASIDE_TAGS = frozenset((
    "nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "fieldset"))
# Words in class, id or role that mark what a part of a page is.
ASIDE_WORDS = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb",
    "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "form", "header", "login", "masthead", "menu", "meta",
    "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo",
    "promotion", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup",
    "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget"))
# The rest of a tag: a quoted value may hold what ends a tag elsewhere.  Nothing is tried twice.
_REST = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+>"
_PIECE = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})(?=[\s/>]){_REST}"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<rest>{_REST})"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"<[!?/]")
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_MARK = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HEADINGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
# Starts that end an open element: which, and the elements they do not look beyond.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")), "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption"), ("table",))}


class Block(NamedTuple):
    text: str
    words: int
    linked: int


def _set_aside(tag: str, rest: str) -> bool:
    """Whether an element is marked as something else than main text."""
    if tag in ASIDE_TAGS:
        return True
    return "=" in rest and not ASIDE_WORDS.isdisjoint(
        w.lower() for found in _MARK.findall(rest) for value in found for w in _WORDS.findall(value))


class _Open:
    """The open block elements, with the places of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.aside: list[bool] = []
        self.places: dict[str, list[int]] = {}

    def last(self, *tags: str) -> int:
        """Place of the innermost of these tags; -1 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, aside: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.aside.append(aside or self.is_aside())

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all inside it."""
        while len(self.tags) > place:
            self.places[self.tags.pop()].pop()
            self.aside.pop()

    def is_aside(self) -> bool:
        return bool(self.aside) and self.aside[-1]


def flat_blocks(page: str) -> list[Block]:
    """The text blocks in page order, without those of parts that are set aside."""
    blocks: list[Block] = []
    opened = _Open()
    pieces: list[tuple[str, bool]] = []
    # How many elements were open where the open link began; None outside links.
    link: int | None = None

    def flush() -> None:
        nonlocal pieces
        if pieces and not opened.is_aside():
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                linked = sum(len(html.unescape(p).split()) for p, in_link in pieces if in_link)
                words = len(text.split(" "))
                blocks.append(Block(text, words, min(linked, words)))
        pieces = []

    # Beyond the last ``>`` no tag ends: what looks like a comment there hides the rest.
    at, end_of_tags = 0, page.rfind(">") + 1
    hidden = _HIDDEN.search(page, end_of_tags)
    page_end = hidden.start() if hidden else len(page)
    # Raw elements that nothing ends from here on.
    unclosed: set[str] = set()
    while match := _PIECE.search(page, at, end_of_tags):
        if match.start() > at:
            pieces.append((page[at:match.start()], link is not None))
        at = match.end()
        if match[0].startswith("<!--") and not match[0].endswith("-->"):
            at = page_end
        tag = (match["tag"] or "").lower()
        raw = (match["raw"] or "").lower()
        # An icon of one tag is empty.
        if raw and raw not in unclosed and not (raw in ("svg", "math") and match[0].endswith("/>")):
            end = _RAW_END[raw].search(page, at)
            if end:
                at = end.end()
            elif raw in ("script", "style"):
                at = page_end = len(page)
            else:
                unclosed.add(raw)
        if raw in ("title", "textarea", "select", "iframe"):
            flush()
        if not tag:
            continue
        if tag == "a":
            link = None if match["end"] else len(opened.tags)
        if tag == "br":
            pieces.append((" ", link is not None))
        # Elements of a page's own making are inline unless a style says otherwise.
        if tag in INLINE or "-" in tag:
            continue
        flush()
        if match["end"]:
            place = opened.last(tag)
            if place >= 0:
                opened.cut(place)
        elif tag not in VOID:
            while opened.tags and opened.tags[-1] in _HEADINGS:
                opened.cut(len(opened.tags) - 1)
            if tag in _ENDS:
                ended, scope = _ENDS[tag]
                place = opened.last(*ended)
                if place > opened.last(*scope):
                    opened.cut(place)
            if not match["rest"].endswith("/>"):
                opened.push(tag, _set_aside(tag, match["rest"]))
        if link is not None and link > len(opened.tags):
            link = None
    if at < page_end:
        pieces.append((page[at:page_end], link is not None))
    flush()
    return blocks


def block_features(blocks: list[Block]) -> list[tuple[float, ...]]:
    shape = [(0.0, 0.0), *((float(b.words), b.linked / b.words) for b in blocks), (0.0, 0.0)]
    return [(*shape[i + 1], *shape[i], *shape[i + 2]) for i in range(len(blocks))]


class Tree(NamedTuple):
    """Nodes as (feature, threshold, left, right), or (-1, class, 0, 0); node 0 is the root."""

    nodes: list[tuple[int, float, int, int]]

    def predict(self, row: tuple[float, ...]) -> bool:
        feature, value, left, right = self.nodes[0]
        while feature >= 0:
            feature, value, left, right = self.nodes[left if row[feature] <= value else right]
        return value > 0.5


def fit_tree(spark: SparkSession, labelled: tuple = LABELLED) -> Tree:
    """Fit the classifier on the labelled table."""
    rows = spark.createDataFrame(
        [tuple(map(float, r)) for r in labelled], [*FEATURES, "label"]).coalesce(1)
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = DecisionTreeClassifier(maxDepth=8, maxBins=64, seed=7).fit(vectors)
    nodes: list[tuple[int, float, int, int]] = []

    def add(node) -> int:
        here = len(nodes)
        nodes.append((-1, float(node.prediction()), 0, 0))
        if node.getClass().getSimpleName() == "InternalNode":
            left = add(node.leftChild())
            nodes[here] = (node.split().featureIndex(), float(node.split().threshold()), left,
                           add(node.rightChild()))
        return here

    add(model._call_java("rootNode"))
    return Tree(nodes)


def main_text(page: str | None, tree: Tree) -> str:
    blocks = flat_blocks(page or "")
    return "\n".join(b.text for b, row in zip(blocks, block_features(blocks)) if tree.predict(row))


def _extract(tree: Tree) -> Column:
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield batch.map(lambda page: main_text(page, tree))
    run.__annotations__ = {"pages": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(F.coalesce("html", F.lit("")))


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """Every row as a struct, with the ``text`` of its page."""
    ship_package(pages.sparkSession)
    tree = tree or fit_tree(pages.sparkSession)
    return kept_whole(pages, _extract(tree).alias("text"))


def html_digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select(
        f"{ROW}.page_id", f"{ROW}.url", "text", F.length("text").cast("bigint").alias("n_chars"))
