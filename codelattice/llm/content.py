"""Main text of web pages by text-to-tag ratio.

The parser of the standard library streams a page's events into lines, one per block, each with its text, its
tags and its part of the page. Ratios of text to tags are smoothed over neighbouring lines with a Gaussian and
split into two clusters; the parts of the page that hold lines of the upper cluster are the content, with the low
lines and the lists and tables that they enclose. An article or main element counts as one part, and its lines reach
the upper cluster with half the ratio. Lines in menus, headers, footers, side columns, notices, adverts, forms and
reader comments never count.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA = 1.0  # lines
RADIUS = 3
PRIOR = 2.0  # by which the ratios of lines in an article or main element count for more
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that never hold content.
DROPPED = frozenset(
    "head title script style noscript template nav footer aside form button select textarea option iframe object svg canvas dialog menu audio video datalist".split())
#: Words of a class, id or role that mark what is not content.
MARKED = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices
    popup modal overlay newsletter subscribe subscription sidebar sidebars menu nav navigation navbar breadcrumb breadcrumbs header footer
    masthead topbar comment comments commentlist respond disqus reply replies share sharing social related recommended widget widgets login
    signup search searchbox toolbar pagination pager contentinfo complementary alert alertdialog dialog form hidden""".split())
#: Wrappers whose marks are ignored: a page may call its body anything.
WHOLE = frozenset(["html", "body", "main", "article"])
CONTAINERS = frozenset("article main".split())
LISTS = frozenset("table td ul ol dl".split())
SECTIONS = frozenset("div section body".split()) | LISTS
#: Start tag -> open elements that it ends, up to the nearest of the elements behind.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
_WORDS = re.compile(r"[a-z0-9]+")


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    part: int = 0


class Lines(HTMLParser):
    """Collects the lines of a page that may be content."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int]] = []  # tag, dropped, part
        self.dropped = 0
        self.links = 0
        self.parts = [False]  # part number -> whether it is an article or a main element
        self.lists = [False]  # whether it is a list or table, or a cell
        self.above = [0]  # the part around it
        self.lines: list[Line] = []
        self.line = Line()

    def _flush(self) -> None:
        if self.line.text:
            self.lines.append(self.line)
        self.line = Line(part=self.stack[-1][2] if self.stack else 0)

    def _pop_to(self, at: int) -> None:
        for tag, dropped, _ in self.stack[at:]:
            self.dropped -= dropped
            self.links -= tag == "a"
        del self.stack[at:]

    def _close_open(self, tag: str) -> None:
        kinds, stop = ENDS.get(tag, ((), ()))
        if tag not in INLINE and tag not in ENDS:
            kinds, stop = ("p",), ("div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "button", "aside", "nav", "footer", "header", "form")
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in kinds:
                self._pop_to(at)
                return
            if self.stack[at][0] in stop:
                return

    def _is_dropped(self, tag: str, attrs: list) -> bool:
        inside = any(t in CONTAINERS for t, _, _ in self.stack)
        if tag in DROPPED or tag == "header" and not inside:
            return True
        named = {k: (v or "").lower() for k, v in attrs}
        if "hidden" in named or re.search(r"display\s*:\s*none", named.get("style", "")):
            return True
        if tag in WHOLE and not (tag == "article" and inside):
            return False
        words = set(_WORDS.findall(" ".join(named.get(k, "") for k in ("class", "id", "role"))))
        if tag == "header":  # that of an article holds its title
            words -= {"header"}
        return bool(words & MARKED)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in INLINE:
            self._close_open(tag)
            self._flush()
        if tag == "main" and self.dropped and "main" not in [t for t, _, _ in self.stack]:
            self._pop_to(0)  # what was left open before the main element ends
        self.line.tags += 1
        if tag in VOID:
            return
        part = self.stack[-1][2] if self.stack else 0
        within = self.parts[part]
        if tag in CONTAINERS and not (within and tag == "article" and any(t == "article" for t, _, _ in self.stack)) or tag in SECTIONS and not within:
            self.above.append(part)
            self.lists.append(tag in LISTS)
            part = len(self.parts)
            self.parts.append(tag in CONTAINERS)
            self.line.part = part
        dropped = self._is_dropped(tag, attrs)
        self.stack.append((tag, dropped, part))
        self.dropped += dropped
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._flush()
        self.line.tags += 1
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                self._pop_to(at)
                break
            if tag in INLINE and self.stack[at][0] not in INLINE:
                break
        self.line.part = self.stack[-1][2] if self.stack else 0

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.line.text.append(data)
            self.line.linked += len(data.strip()) if self.links else 0


def smoothed(ratios: np.ndarray, sigma: float = SIGMA, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over neighbouring lines."""
    weights = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    top = np.convolve(ratios, weights, "same") if len(ratios) >= len(weights) else np.convolve(ratios, weights)[radius : radius + len(ratios)]
    ones = np.ones(len(ratios))
    norm = np.convolve(ones, weights, "same") if len(ratios) >= len(weights) else np.convolve(ones, weights)[radius : radius + len(ratios)]
    return top / norm


def two_clusters(values: np.ndarray) -> float:
    """The threshold between the two clusters of least spread; the least value if there is one only."""
    ordered = np.sort(values)
    if ordered[0] == ordered[-1]:
        return float(ordered[0])
    n = np.arange(1, len(ordered))
    sums, squares = np.cumsum(ordered), np.cumsum(ordered**2)
    left = squares[:-1] - sums[:-1] ** 2 / n
    right = (squares[-1] - squares[:-1]) - (sums[-1] - sums[:-1]) ** 2 / (len(ordered) - n)
    return float(ordered[int(np.argmin(left + right)) + 1])


def content_parts(parser: Lines, parts: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """For each part of a page whether it is content; of each line the part, text outside links, text, and cluster."""
    n = len(parser.parts)
    unit = list(range(n))  # the outermost article or main element, else the part itself
    for p in range(1, n):
        if parser.parts[p] and parser.parts[parser.above[p]]:
            unit[p] = unit[parser.above[p]]
    whole, units = np.array(parser.parts), np.array(unit)
    of_line = units[parts]
    texts = np.bincount(parts, sizes, minlength=n) >= 0.5 * np.bincount(parts, lengths, minlength=n)  # not mostly links
    votes = np.bincount(of_line, np.where(upper, sizes, 0), minlength=n)
    high = np.bincount(parts[upper], minlength=n) > 0
    held = np.bincount(of_line[upper], minlength=n) > 0
    held &= np.bincount(of_line, sizes, minlength=n) >= 0.5 * np.bincount(of_line, lengths, minlength=n)
    held &= whole | (votes > 1e-3 * votes.max())
    if not held.any():  # links only: those of the article with most text, if there is one
        held = whole & (np.arange(n) == np.argmax(np.bincount(of_line, lengths * whole[of_line], minlength=n)))
    around = [{parser.above[p] for p in np.flatnonzero(held & whole)}, np.flatnonzero(held[of_line] & whole[of_line])]
    for p in np.flatnonzero(whole & (units == np.arange(n)) & ~held & texts):  # an article between such parts
        at = np.flatnonzero(of_line == p)
        held[p] = len(at) and parser.above[p] in around[0] and around[1][0] < at[0] < around[1][-1]
    kept = held[units] & (high | texts | (units == np.arange(n)))
    for p in range(1, n):  # lists and tables belong to the part around them
        kept[p] |= parser.lists[p] and texts[p] and kept[parser.above[p]]
    return kept


def main_text(html: str | None) -> str:
    """The content of one page; empty for null, and for pages without any."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    lines = [(" ".join("".join(x.text).split()), x) for x in parser.lines]
    lines = [(text, x) for text, x in lines if text]
    if not lines:
        return ""
    sizes = np.array([len(text) - min(x.linked, len(text)) for text, x in lines], float)
    smooth = smoothed(sizes / np.array([max(1, x.tags) for _, x in lines]))
    parts = np.array([x.part for _, x in lines])
    upper = smooth * np.where(np.array(parser.parts)[parts], PRIOR, 1.0) >= two_clusters(smooth)
    kept = content_parts(parser, parts, sizes, np.array([len(text) for text, _ in lines], float), upper)
    return " ".join(text for text, x in lines if kept[x.part])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Null pages are empty ones and have empty text, as have pages without content. Broken markup is read as a
    browser would roughly read it. Repeated rows are answered each; further columns are ignored.
    """

    @F.pandas_udf("string")
    def text_of(html: pd.Series) -> pd.Series:
        return html.map(main_text, na_action=None)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(F.coalesce(F.col("html").cast("string"), F.lit(""))).alias("text"))
