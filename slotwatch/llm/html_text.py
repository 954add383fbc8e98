"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a row of text blocks with their word count, the share of words inside links,
the same of the blocks before and after, and where they stand: inside an article or main
element, whether they are headings, and in what container. A container is an element that is furniture
by its name, or by a word in its class, id or role. As a wrapper of the whole page may be named so too,
what counts of a block's innermost container is how much of the page's unlinked text it holds and
which share of the page's articles or headlines. A decision tree, trained when the module is
loaded on the labelled blocks in ``LABELLED``, says which blocks are main text.
Scanning is linear in the page, whatever is left unclosed.

Null and empty pages have empty text. Repeated rows are each extracted, an empty table gives an empty one, and
extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slotwatch.llm.common import table, text_of

# HTML element names by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td "
    "tfoot th thead tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style title textarea noscript template iframe noembed noframes svg math xmp object audio video canvas".split())
FURNITURE_TAGS = frozenset("nav footer aside form menu dialog button select fieldset header".split())
MAIN_TAGS = frozenset(["article", "main"])
# Words in class, id or role that mark page furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr "
    "comment comments disqus reply replies respond sidebar aside widget widgets menu nav navbar navigation breadcrumb breadcrumbs "
    "footer foot header masthead topbar toolbar related recommended share sharing social subscribe newsletter signup login search "
    "popup modal overlay notice notices alert pagination pager copyright contentinfo complementary legal skip hidden".split()
)

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
_MARK = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
_HIDDEN = re.compile(r"""\shidden(?=[\s/>=])|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACES = re.compile(r"\s+")


@dataclass
class Container:
    """Unlinked words, those of them in articles, and headlines before its start and by its end."""

    start: tuple[int, int, int]
    end: tuple[int, int, int]


@dataclass
class Block:
    text: str
    words: int
    linked: int
    in_main: bool
    container: Container | None
    heading: bool


def _is_marked(attributes: str) -> bool:
    for value in _MARK.findall(attributes):
        if not FURNITURE_WORDS.isdisjoint(p.lower() for p in _PARTS.findall(value)):
            return True
    return bool(_HIDDEN.search(attributes))


class _Scanner:
    """One pass over a page; keeps the open elements and the text since the last block edge."""

    def __init__(self, page: str):
        self.page, self.blocks = page, []
        self.parts: list[tuple[str, bool]] = []  # text, in a link
        self.open: list[tuple[str, int, int, Container | None, bool]] = []  # name and the state outside it
        self.count: dict[str, int] = {}
        self.main = self.furniture = 0
        self.container: Container | None = None
        self.story = False  # in an article, and in no container inside it
        self.words = self.article_words = self.headlines = 0  # so far; words outside of links
        self.quotes = True  # attribute quotes are still balanced

    def run(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            lt = page.find("<", at)
            if lt < 0:
                self.text(page[at:])
                break
            self.text(page[at:lt])
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = end + 3 if end >= 0 else len(page)
            elif page.startswith(("<!", "<?"), lt):
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            elif name := _NAME.match(page, lt + 1):
                at = self.tag(name, self.tag_end(name.end()))
            else:
                self.text("<")
                at = lt + 1
        self.edge()
        while self.open:
            self.pop()
        return self.blocks

    def tag_end(self, at: int) -> int:
        if self.quotes:
            if m := _TAG_END.match(self.page, at):
                return m.end()
            self.quotes = False  # a quote never closes: from here on the first > ends a tag
        end = self.page.find(">", at)
        return end + 1 if end >= 0 else len(self.page)

    def tag(self, name: re.Match, end: int) -> int:
        tag, closing = name[1].lower(), self.page[name.start()] == "/"
        attributes = self.page[name.end() : end]
        if tag in BLOCK_TAGS:
            self.edge()
        elif tag == "br":
            self.text(" ")
        if tag in VOID_TAGS:
            return end
        if closing:
            self.close(tag)
        elif tag in RAW_TAGS:
            if attributes.endswith("/>"):
                return end
            found = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, end)
            close = self.page.find(">", found.end()) if found else -1
            return close + 1 if close >= 0 else len(self.page)
        else:
            if tag in ("p", "a", "li", "option") and self.open and self.open[-1][0] == tag:
                self.close(tag)
            self.open.append((tag, self.main, self.furniture, self.container, self.story))
            self.count[tag] = self.count.get(tag, 0) + 1
            if tag in FURNITURE_TAGS or attributes and _is_marked(attributes):
                self.container, self.story = Container(self.totals(), (0, 0, 0)), False
            elif tag in MAIN_TAGS:
                self.story = True
            self.headlines += tag == "h1" and not self.furniture
            self.main += tag in MAIN_TAGS
            self.furniture += tag in FURNITURE_TAGS and tag != "form"
        return end

    def close(self, tag: str) -> None:
        if self.count.get(tag):
            while self.pop() != tag:
                pass

    def totals(self) -> tuple[int, int, int]:
        return self.words, self.article_words, self.headlines

    def pop(self) -> str:
        inner = self.container
        name, self.main, self.furniture, self.container, self.story = self.open.pop()
        if inner is not self.container:
            inner.end = self.totals()
        self.count[name] -= 1
        return name

    def text(self, text: str) -> None:
        if text:
            self.parts.append((text, self.count.get("a", 0) > 0))

    def edge(self) -> None:
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        text = _SPACES.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
        if text:
            words = len(text.split())
            linked = min(words, sum(len(p.split()) for p, link in parts if link))
            self.words += words - linked
            self.article_words += self.story * (words - linked)
            heading = any(self.count.get(f"h{i}") for i in range(1, 7))
            self.blocks.append(Block(text, words, linked, self.main > 0, self.container, heading))


def places(found: list[Block], totals: tuple[int, int, int]) -> list[tuple[float, float]]:
    """What each block's container holds of the page: the share of unlinked words and of those in
    articles. Without articles on the page the second is that of headlines, if it holds any, else
    a half. Both are 1 outside of any container."""
    out = []
    for b in found:
        if (c := b.container) is None:
            out.append((1.0, 1.0))
            continue
        words, articles, headlines = ((e - s) / t if t else 0.0 for s, e, t in zip(c.start, c.end, totals))
        out.append((words, articles if totals[1] else headlines or 0.5))
    return out


FEATURES = ("share", "article", "in_main", "link", "words", "prev_link", "prev_words", "next_link", "next_words", "heading")

# Blocks labelled by hand, in the order of FEATURES, then 1 for main text.
LABELLED = [
    # menus, one or few words, all of them links
    (0.0, 0.0, 0, 1.0, 1, 0.0, 0, 1.0, 1, 0, 0), (0.0, 0.0, 0, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (0.02, 0.0, 0, 1.0, 2, 1.0, 1, 0.0, 12, 0, 0),
    (1.0, 1.0, 0, 1.0, 1, 1.0, 1, 1.0, 2, 0, 0), (1.0, 1.0, 0, 1.0, 3, 1.0, 2, 1.0, 1, 0, 0), (1.0, 1.0, 0, 0.9, 10, 1.0, 4, 0.0, 8, 0, 0),
    (1.0, 1.0, 0, 1.0, 6, 0.0, 80, 1.0, 5, 0, 0), (1.0, 1.0, 0, 0.6, 15, 1.0, 6, 1.0, 6, 0, 0), (0.97, 1.0, 0, 1.0, 2, 1.0, 1, 0.0, 60, 0, 0),
    (0.95, 0.5, 0, 1.0, 1, 0.0, 0, 1.0, 1, 0, 0),
    (1.0, 1.0, 0, 0.95, 40, 0.0, 60, 0.0, 4, 0, 0), (1.0, 1.0, 0, 0.8, 28, 1.0, 3, 0.0, 50, 0, 0), (1.0, 1.0, 0, 1.0, 35, 1.0, 30, 1.0, 33, 0, 0),
    (0.95, 1.0, 0, 0.9, 45, 0.0, 70, 1.0, 20, 0, 0),
    # adverts, notices, sidebars and forms in marked containers
    (0.05, 0.0, 0, 0.0, 7, 1.0, 1, 0.0, 6, 0, 0), (0.1, 0.0, 0, 0.0, 12, 1.0, 1, 0.0, 9, 0, 0), (0.2, 0.0, 0, 0.0, 40, 1.0, 1, 0.0, 60, 0, 0),
    (0.08, 0.0, 1, 0.0, 15, 0.0, 60, 0.0, 45, 0, 0), (0.15, 0.0, 1, 0.2, 30, 0.0, 50, 0.0, 70, 0, 0), (0.06, 0.0, 1, 0.0, 3, 0.0, 90, 0.0, 20, 1, 0),
    (0.0, 0.0, 1, 1.0, 4, 0.0, 33, 0.0, 0, 0, 0), (0.12, 0.5, 0, 0.1, 22, 0.0, 10, 0.5, 4, 0, 0), (0.3, 0.0, 0, 0.0, 2, 0.0, 9, 0.0, 2, 1, 0),
    (0.7, 0.0, 0, 0.0, 30, 0.0, 6, 0.0, 9, 0, 0), (0.04, 0.5, 0, 0.0, 5, 1.0, 1, 0.0, 60, 0, 0), (0.45, 0.5, 0, 0.0, 18, 0.0, 21, 0.0, 9, 0, 0),
    (0.1, 0.3, 1, 0.0, 14, 1.0, 3, 1.0, 3, 0, 0), (0.3, 0.6, 1, 0.1, 20, 1.0, 5, 0.0, 20, 0, 0),
    (0.0, 0.67, 1, 1.0, 2, 0.0, 2, 1.0, 3, 0, 0), (0.0, 0.67, 1, 1.0, 3, 1.0, 2, 0.0, 9, 0, 0), (0.02, 0.5, 1, 1.0, 4, 0.0, 60, 1.0, 4, 0, 0),
    # footers and reader comments
    (0.06, 0.0, 0, 0.0, 9, 0.0, 50, 0.0, 0, 0, 0), (0.1, 0.0, 0, 0.3, 14, 0.0, 120, 0.0, 0, 0, 0), (0.35, 0.0, 0, 0.0, 25, 0.0, 3, 0.0, 31, 0, 0),
    (0.8, 0.0, 1, 0.0, 55, 0.0, 4, 0.0, 18, 0, 0), (1.0, 1.0, 0, 0.0, 4, 0.0, 70, 0.0, 0, 0, 0), (1.0, 1.0, 0, 0.0, 5, 1.0, 1, 1.0, 2, 0, 0),
    (0.9, 0.0, 0, 0.0, 41, 0.0, 40, 0.0, 38, 0, 0), (0.2, 0.25, 1, 0.0, 30, 0.0, 4, 0.0, 33, 0, 0), (0.96, 1.0, 0, 0.0, 4, 0.0, 80, 0.0, 0, 0, 0),
    # articles: headings, paragraphs of any length, lists of links in the text
    (1.0, 1.0, 1, 0.0, 6, 0.0, 9, 0.0, 8, 1, 1), (1.0, 1.0, 1, 0.0, 1, 0.0, 50, 0.0, 40, 0, 1), (1.0, 1.0, 1, 0.0, 120, 0.0, 6, 0.0, 80, 0, 1),
    (1.0, 1.0, 1, 0.0, 3, 0.0, 1, 0.0, 2, 0, 1), (1.0, 1.0, 1, 0.1, 45, 0.0, 60, 0.0, 9, 0, 1), (1.0, 1.0, 1, 0.5, 8, 0.0, 44, 0.0, 70, 0, 1),
    (1.0, 1.0, 1, 1.0, 3, 0.0, 30, 0.0, 25, 0, 1), (1.0, 1.0, 1, 0.0, 9, 0.0, 70, 0.0, 7, 0, 1), (1.0, 1.0, 1, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1),
    (1.0, 1.0, 1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1), (1.0, 1.0, 1, 0.0, 15, 1.0, 2, 0.0, 14, 1, 1),
    (1.0, 1.0, 1, 0.0, 2, 0.0, 60, 1.0, 2, 0, 1), (1.0, 1.0, 1, 0.3, 12, 0.0, 60, 1.0, 3, 0, 1), (1.0, 1.0, 1, 0.0, 20, 0.0, 6, 1.0, 4, 0, 1),
    (1.0, 1.0, 1, 1.0, 4, 1.0, 3, 1.0, 3, 0, 1), (1.0, 1.0, 1, 0.0, 3, 1.0, 3, 1.0, 2, 1, 1), (0.9, 1.0, 1, 0.0, 2, 0.0, 60, 1.0, 2, 0, 1),
    # the same in wrappers whose class, id or element is that of furniture
    (0.98, 1.0, 1, 0.0, 7, 0.0, 9, 0.0, 60, 1, 1), (0.9, 1.0, 1, 0.0, 50, 0.0, 40, 0.0, 70, 0, 1), (0.75, 1.0, 1, 0.0, 3, 0.0, 40, 0.0, 20, 0, 1),
    (0.5, 1.0, 1, 0.0, 40, 0.0, 7, 0.0, 33, 0, 1), (0.3, 1.0, 1, 0.0, 28, 0.0, 4, 0.0, 30, 0, 1), (0.95, 1.0, 1, 1.0, 2, 0.0, 40, 0.0, 30, 0, 1),
    (0.97, 1.0, 0, 0.0, 44, 0.0, 6, 0.0, 52, 0, 1), (0.85, 1.0, 0, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1), (0.92, 0.5, 0, 0.0, 70, 0.0, 4, 0.0, 66, 0, 1),
    (0.8, 0.5, 0, 0.05, 35, 0.0, 40, 0.0, 28, 0, 1), (0.9, 0.5, 0, 0.0, 26, 0.0, 0, 0.0, 30, 0, 1), (0.99, 0.5, 0, 0.0, 58, 1.0, 2, 0.0, 3, 0, 1),
    # main text of pages without an article element
    (1.0, 1.0, 0, 0.0, 60, 0.0, 5, 0.0, 70, 0, 1), (1.0, 1.0, 0, 0.05, 90, 0.0, 60, 0.0, 4, 0, 1), (1.0, 1.0, 0, 0.0, 35, 1.0, 2, 0.0, 50, 0, 1),
    (1.0, 1.0, 0, 0.0, 7, 1.0, 3, 0.0, 64, 1, 1), (1.0, 1.0, 0, 0.0, 5, 0.0, 40, 0.0, 52, 0, 1), (1.0, 1.0, 0, 0.2, 48, 0.0, 33, 0.0, 29, 0, 1),
    (1.0, 1.0, 0, 0.0, 22, 0.0, 30, 0.0, 26, 0, 1), (1.0, 1.0, 0, 0.0, 18, 0.0, 25, 1.0, 3, 0, 1), (1.0, 1.0, 0, 0.1, 30, 0.0, 28, 0.0, 3, 0, 1),
    (1.0, 1.0, 0, 0.0, 50, 0.0, 45, 0.0, 0, 0, 1), (1.0, 1.0, 0, 0.0, 33, 0.0, 60, 1.0, 1, 0, 1), (1.0, 1.0, 0, 0.0, 28, 0.0, 0, 0.0, 0, 0, 1),
    (1.0, 1.0, 0, 0.0, 41, 0.0, 5, 0.0, 2, 0, 1), (1.0, 1.0, 0, 0.0, 26, 0.0, 55, 0.0, 1, 0, 1),
]
# Blocks of articles and of small containers are what they are whatever stands around them.
_NEIGHBOURS = [(0.0, 0), (0.0, 60), (1.0, 2)]
LABELLED += [
    (*row[:5], *before, *after, *row[9:])
    for row in LABELLED
    if row[2] and row[-1] or row[0] < 0.3 and row[1] < 0.3 and not row[-1]
    for before in _NEIGHBOURS
    for after in _NEIGHBOURS
]


def grow(rows: list[tuple], depth: int = 6):
    """A tree of ``(feature, threshold, low, high)`` by least Gini impurity; leaves are labels.

    Ties take the first feature in order and the lowest threshold.
    """
    ones = sum(r[-1] for r in rows)
    if not depth or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            impurity = sum(2 * k * (len(s) - k) / len(s) for s in sides for k in [sum(r[-1] for r in s)])
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, cut, sides)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, cut, (low, high) = best
    return (f, cut, grow(low, depth - 1), grow(high, depth - 1))


TREE = grow(LABELLED)


def classify(features: tuple) -> int:
    node = TREE
    while not isinstance(node, int):
        f, cut, low, high = node
        node = low if features[f] <= cut else high
    return node


def main_text(page: str | None) -> str:
    """The main text of a page, blocks parted by line ends; empty if there is none."""
    scan = _Scanner(page or "")
    found = scan.run()
    place = places(found, scan.totals())
    link = [b.linked / b.words for b in found]
    out = []
    for i, b in enumerate(found):
        prev_link, prev_words = (link[i - 1], found[i - 1].words) if i else (0.0, 0)
        next_link, next_words = (link[i + 1], found[i + 1].words) if i + 1 < len(found) else (0.0, 0)
        if classify((*place[i], b.in_main, link[i], b.words, prev_link, prev_words, next_link, next_words, b.heading)):
            out.append(b.text)
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def _main_text_udf(pages: pd.Series) -> pd.Series:
    return pages.map(main_text)


def extracted(page: Column) -> Column:
    """Main text of a column of pages; null counts as empty."""
    return _main_text_udf(text_of(page))


def op3_html_text(spark, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", "url", extracted(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
