"""Main text of web pages by text-to-tag ratios over the standard library's parser events.

The page is fed to the parser in pieces. Its events build lines, one for each block of text, each with its
tags and the block elements it stands in. A line's ratio of text to tags is smoothed over its neighbours
with a Gaussian; lines at or above a threshold, half the deviation of the smoothed ratios, form clusters.

The clusters choose the regions: in the tree of block elements each clustered line counts for its text, each
other line that has more than the two tags of its own block against by the text that its tags lack to reach the threshold (up to LACK for a tag), and the element
of the greatest sum is a region, the innermost of equals. So link lists, menus and small print beside the clusters
push it inwards, whatever the elements are called; elements beside it that have a cluster of their own are regions too.
All lines of a region are its text, short ones too, but for those in elements which HTML or their own
names call menus, headers, footers, sidebars, notices, adverts, forms or reader comments: those never count for
a region, as the ratio cannot tell a reader's comment from the article. A name is a whole one, or words of such
names alone: "no-sidebar" sets nothing apart. Where no clustered line but headings would be left, the elements around the heaviest one count whatever their names.

Defined results. Null, empty and textless pages have an empty text. Unclosed and stray tags are taken as
browsers do: a closing tag ends what it matches, if anything. Repeated rows are extracted each; columns
other than those asked for are passed through untouched.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, strings

#: Fixed values of HTML: elements without an end tag, elements that begin and end a block, elements without readable text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("head script style noscript template button select textarea iframe object svg canvas audio video map".split())
#: Elements and roles that HTML itself sets apart from the article.
ASIDE = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id names of what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc sidebar rail aside footer foot masthead topbar toolbar "
    "comment comments respond replies disqus share sharing social related recommended newsletter subscribe signup login search widget".split()
)
#: Those of what readers wrote, which a ratio cannot tell from an article.
READERS = frozenset("comment comments respond replies disqus".split())
#: Words that such a name may also have: "comment-list" is a name, "no-sidebar" and "search-results" are none.
BESIDE = frozenset(
    "area bar block body bottom box button buttons card cell column container footer form group header holder icon icons inner item items label left line link links list main "
    "message module more outer page panel post posts primary right row secondary section site slot space spot stories thread title top unit wrap wrapper zone".split()
)
SPACES = re.compile(r"\s+")
WORDS = re.compile(r"[a-z]+|[^a-z\s]*[^a-z\s\d_-][^a-z\s]*")
PIECE = 1 << 16
SIGMA = 2.0
#: Characters that a line outside of clusters lacks for each tag, at most: one huge line raises the threshold for all others.
LACK = 25.0
#: How a block is set apart: not at all, by its name, by its element or role, as without readable text.
PLAIN, NAMED, APART, MUTE = range(4)


def tells(name: str) -> bool:
    """Whether a class or id name sets its element apart: it has a word of NAMES, and others are of BESIDE."""
    words = WORDS.findall(name)
    return not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words)


class Line(NamedTuple):
    text: str
    tags: int
    block: int  # the innermost block element, -1 for the page
    apart: int  # the strongest way in which the elements around are set apart
    named: frozenset[int] = frozenset()  # elements around that only their names set apart, by number


class Lines(HTMLParser):
    """Collects a line for each block of text, and the tree of block elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.parents: list[int] = []  # of block elements, by number as they open
        self.open: list[tuple[str, int, int, frozenset[int]]] = []  # name, number or -1, the strongest way around, the elements around that are set apart by name
        self.elements = 0
        self.headings: set[int] = set()  # blocks
        self.readers: set[int] = set()  # those that hold what readers wrote
        self.articles = 0  # open article and main elements
        self.text: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        if self.text:
            line = SPACES.sub(" ", "".join(self.text)).strip()
            if line:
                block = next((n for _, n, *_ in reversed(self.open) if n >= 0), -1)
                self.lines.append(Line(line, self.tags, block, *(self.open[-1][2:] if self.open else (PLAIN, frozenset()))))
                self.tags = 0
            self.text = []

    def _apart(self, tag: str, attrs: list) -> int:
        if tag in SILENT or any(name == "hidden" or name == "aria-hidden" and value == "true" for name, value in attrs):
            return MUTE
        if tag in ASIDE or tag == "header" and not self.articles or any(name == "role" and value and value.lower() in ROLES for name, value in attrs):
            return APART
        if tag not in ("html", "body", "article", "main") and any(name in ("class", "id") and value and any(map(tells, value.lower().split())) for name, value in attrs):
            return NAMED
        return PLAIN

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1  # of the line that it begins
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        if tag in ("article", "main"):  # a menu that was never closed ends here
            for k, (name, _, apart, _) in enumerate(self.open):
                if apart >= APART and name in ("nav", "header", "ul", "head"):
                    self._close(k)
                    break
        if tag in BLOCKS:  # a block ends a paragraph that is open, an item the item before it
            last = next((k for k in range(len(self.open) - 1, -1, -1) if self.open[k][1] >= 0), -1)
            if last >= 0 and self.open[last][0] in ("p", tag if tag == "li" else "p"):
                self._close(last)
        number = -1
        if tag in BLOCKS:
            number = len(self.parents)
            self.parents.append(next((n for _, n, *_ in reversed(self.open) if n >= 0), -1))
            if re.fullmatch("h[1-6]", tag):
                self.headings.add(number)
        around, named = self.open[-1][2:] if self.open else (PLAIN, frozenset())
        apart = self._apart(tag, attrs)
        self.elements += 1
        if apart == NAMED and any(name in ("class", "id") and value and READERS & set(WORDS.findall(value.lower())) for name, value in attrs):
            self.readers.add(self.elements)
        self.open.append((tag, number, around if apart == NAMED else max(around, apart), named | {self.elements} if apart == NAMED else named))
        self.articles += tag in ("article", "main")

    def _close(self, k: int) -> None:
        self.articles -= sum(name in ("article", "main") for name, *_ in self.open[k:])
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._close(k)
                break

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if not self.open or self.open[-1][2] < MUTE:
            self.text.append(data)


def parsed(html: str) -> Lines:
    parser = Lines()
    for at in range(0, len(html), PIECE):
        parser.feed(html[at : at + PIECE])
    parser.close()
    parser.flush()
    return parser


def smoothed(lines: list[Line]) -> np.ndarray:
    """Text-to-tag ratios of the lines under a Gaussian; the ends are repeated outwards."""
    ratio = np.array([len(x.text) / max(1, x.tags) for x in lines])
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(np.pad(ratio, reach, "edge"), kernel / kernel.sum(), "valid")


def clusters(lines: list[Line]) -> tuple[np.ndarray, float]:
    """Which lines belong to content clusters, and the threshold of the smoothed ratio."""
    smooth = smoothed(lines)
    least = float(min(smooth.std() / 2 + 1e-9, smooth.max()))
    return smooth >= least, least


def regions(lines: list[Line], parents: list[int], inside: np.ndarray, least: float, apart: int) -> set[int]:
    """The block elements that are the text; -1 is the page.

    The first has the greatest sum, the innermost of equals, among blocks that hold blocks. Blocks beside it with a sum above 0 and a
    clustered line that reaches the threshold by itself follow in order of their sums, none within another.
    """
    weight, inner, strong = [0.0] * (len(parents) + 1), [False] * (len(parents) + 1), [False] * (len(parents) + 1)  # the last is the page
    for x, clustered in zip(lines, inside):
        weight[x.block] += (len(x.text) if x.apart < apart else 0) if clustered else min(0.0, len(x.text) - min(least, LACK) * x.tags) if x.tags > 2 else 0.0  # its own block's two tags are no lack
        strong[x.block] |= bool(clustered) and x.apart < apart and len(x.text) >= least * max(1, x.tags)
    for k in range(len(parents) - 1, -1, -1):  # children have greater numbers than their parents
        weight[parents[k]] += weight[k]
        strong[parents[k]] |= strong[k]
        inner[parents[k]] = True
    order = sorted(range(-1, len(parents)), key=lambda k: (-weight[k], -k))
    first = next(k for k in order if inner[k] or k < 0)
    chosen, around = {first}, set(_upwards(first, parents))
    for k in order:
        if weight[k] > 0 and strong[k] and k not in around and chosen.isdisjoint(_upwards(k, parents)):
            chosen.add(k)
            around.update(_upwards(k, parents))
    return chosen


def _upwards(k: int, parents: list[int]) -> list[int]:
    """``k``, the blocks around it, and the page."""
    out = [k]
    while k >= 0:
        k = parents[k]
        out.append(k)
    return out


def within(lines: list[Line], parents: list[int], chosen: set[int], apart: int) -> list[str]:
    """Text of the lines in the blocks ``chosen`` that are not set apart."""
    held = [False] * len(parents) + [-1 in chosen]  # the last is the page
    for k, parent in enumerate(parents):
        held[k] = k in chosen or held[parent]
    return [x.text for x in lines if x.apart < apart and held[x.block]]


def apart_by_name(lines: list[Line], inside: np.ndarray, readers: set[int], headings: set[int]) -> list[Line]:
    """``lines`` with those set apart that stand in an element of such a name.

    A name does not decide against the ratio: where no clustered line but headings would be left, the elements around the heaviest line count as
    not named, and so on until one is left. Elements of readers are spared only where there is no other line at all.
    """
    spared: set[int] = set()
    while True:
        told = [x._replace(apart=NAMED) if x.apart == PLAIN and not x.named <= spared else x for x in lines]
        if any(x.apart == PLAIN and clustered and x.block not in headings for x, clustered in zip(told, inside)):
            return told
        left = [x for x, clustered in zip(told, inside) if clustered and x.apart == NAMED and readers.isdisjoint(x.named)]
        if not left and not any(x.apart == PLAIN for x in told):
            left = [x for x in told if x.apart == NAMED]
        if not left:
            return told
        spared |= max(left, key=lambda x: len(x.text)).named


def main_text(html: str) -> str:
    parser = parsed(html)
    lines = parser.lines
    if not lines:
        return ""
    inside, least = clusters(lines)
    lines = apart_by_name(lines, inside, parser.readers, parser.headings)
    return "\n".join(within(lines, parser.parents, regions(lines, parser.parents, inside, least, NAMED), NAMED))


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in a column ``text`` in its place."""
    at = pages.columns.index(html)
    names = [text if c == html else c for c in pages.columns if c == html or c != text]
    others = [k for k, c in enumerate(pages.columns) if c == html or c != text]

    def texts(batches):
        for batch in slices(batches):
            out = pa.array([main_text(x) for x in strings(batch.column(at))], pa.string())
            yield pa.RecordBatch.from_arrays([out if k == at else batch.column(k) for k in others], names)

    kinds = dict(pages.dtypes)
    return pages.mapInArrow(texts, ", ".join(f"`{n}` {'string' if n == text else kinds[n]}" for n in names))
