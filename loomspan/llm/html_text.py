"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element, in page order. Tags only weigh lines: a line inside
boilerplate (menus, page headers, footers, asides, notices, adverts, forms, comment threads) keeps
its place but counts no text, link text outside an article counts none either, and lines of marked articles count ARTICLE_WEIGHT times.

The sums of the weights over sliding windows of lines then decide. The floor comes from the page itself: if its window
sums fall into two kinds far apart, it is the threshold between these (Otsu's, on logarithms), else a single
character. Content starts where a window surges to the floor and ends where the windows dive below it. All lines between a
surge and its dive are kept, short ones included; at both ends, lines that stand in another container than the text do not
belong to it, and lines in the same one do.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.session import small_arrow_batches

WINDOW = 3
APART = 4.0
ARTICLE_WEIGHT = 8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?:script|style|noscript|template|textarea|iframe|svg|select|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?<=/)>"
    r"|<(script|style|textarea|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|</[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements whose content is dropped where they are closed.
_DROPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("noscript", "template", "svg", "select", "object", "canvas", "math")}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form head menu dialog button datalist dir frameset".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo "
    "promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
CONTAINERS = frozenset("article body center details div main section td th".split())
P_CLOSERS = BLOCKS - {"body", "html", "head"}


def _is_hidden(attributes: str) -> bool:
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true" or name == "style" and _UNSHOWN.search(value):
            return True
    return False


def _is_boilerplate(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or tag == "header" and not in_article:
        return True
    if tag in ("html", "body", "article", "main", "p", "h1") or not attributes:
        return False
    if _is_hidden(attributes):
        return True
    words = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower()
    return not BOILERPLATE_NAMES.isdisjoint(re.split(r"[\s_-]+", words))


@dataclass(eq=False)
class Container:
    """An element that holds lines: how deep it lies in others, and the lines [first, end) inside it."""

    depth: int
    first: int
    end: float = math.inf


PAGE = Container(0, 0)


@dataclass
class Line:
    """A block of text at place `at` of the page: its weight is its length without links outside an article; container is the innermost around it."""

    text: str
    weight: int
    at: int
    container: Container
    in_article: bool


def page_lines(source: str) -> list[Line]:
    """The block lines of a page; those in boilerplate have neither text nor weight. Work is linear in the page, however its tags nest or stay open."""
    lines: list[Line] = []
    part: list[str] = []
    linked: list[str] = []
    links = 0
    open_tags: list[tuple[str, bool]] = []
    known: Counter[str] = Counter()  # of open_tags
    containers: list[Container] = []
    never_closed: set[str] = set()
    muted = articles = 0

    def flush() -> None:
        text = " ".join(html.unescape("".join(part)).split())
        part.clear()
        if text:
            weight = 0 if muted else len(text) - min(len(text), len(" ".join(html.unescape("".join(linked)).split())))
            lines.append(Line("" if muted else text, weight, len(lines), containers[-1] if containers else PAGE, articles > 0))
        linked.clear()

    def close(upto: int) -> None:
        nonlocal muted, articles
        while len(open_tags) > upto:
            tag, mutes = open_tags.pop()
            known[tag] -= 1
            muted -= mutes
            articles -= tag in ("article", "main")
            if tag in CONTAINERS:
                containers.pop().end = len(lines)

    def opened(tag: str, mutes: bool) -> None:
        nonlocal muted
        open_tags.append((tag, mutes))
        known[tag] += 1
        muted += mutes

    at = 0
    while m := _TOKEN.search(source, at):
        if m.start() > at:
            piece = source[at : m.start()]
            part.append(piece)
            if links and not articles:
                linked.append(piece)
        at = m.end()
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in _DROPPED and not m[2] and tag not in never_closed:
            if end := _DROPPED[tag].search(source, at):
                at = end.end()
                continue
            never_closed.add(tag)
        if tag == "a":
            links = 0 if m[2] else 1
            continue
        if tag not in BLOCKS and tag not in BOILERPLATE:
            if tag in ("br", "img", "input"):
                part.append(" ")
            elif m[2]:
                for k in range(len(open_tags) - 1, -1, -1) if known[tag] else ():
                    if open_tags[k][0] == tag:
                        close(k)
                        break
                    if open_tags[k][0] in BLOCKS:
                        break
            elif tag not in VOID and not m[4].endswith("/") and _is_boilerplate(tag, m[4], articles > 0):
                flush()
                opened(tag, True)
            continue
        flush()
        links = 0
        if tag in VOID:
            continue
        if m[2]:
            for k in range(len(open_tags) - 1, -1, -1) if known[tag] else ():
                if open_tags[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in P_CLOSERS and open_tags and open_tags[-1][0] == "p":
            close(len(open_tags) - 1)
        if tag in ("li", "dt", "dd", "td", "th", "tr", "option") and open_tags and open_tags[-1][0] == tag:
            close(len(open_tags) - 1)
        if tag == "body":
            close(0)
        opened(tag, _is_boilerplate(tag, m[4], articles > 0))
        articles += tag in ("article", "main")
        if tag in CONTAINERS:
            containers.append(Container(len(containers) + 1, len(lines)))
    part.append(source[at:])
    flush()
    return lines


def line_weights(lines: list[Line]) -> np.ndarray:
    """The weight of each line; lines inside articles count ARTICLE_WEIGHT times."""
    return np.array([x.weight * (ARTICLE_WEIGHT if x.in_article else 1) for x in lines], dtype=np.int64)


def window_sums(weights: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The sum of the window of lines that starts at each line; windows at the end are short."""
    total = np.concatenate([[0], np.cumsum(weights)])
    at = np.arange(len(weights))
    return total[np.minimum(at + window, len(weights))] - total[at]


def page_floor(sums: np.ndarray, apart: float = APART) -> float:
    """The least window sum of text: Otsu's threshold on the logarithms of a page's window sums, if both sides are `apart` times apart, else 1."""
    level = np.sort(np.log(sums[sums > 0]))
    if len(level) < 2:
        return 1.0
    n = np.arange(1, len(level))
    below = np.cumsum(level)[:-1] / n
    above = (level.sum() - np.cumsum(level)[:-1]) / (len(level) - n)
    k = int(np.argmax(n * (len(level) - n) * (above - below) ** 2))
    return float(np.exp(level[k + 1])) * (1 - 1e-9) if above[k] - below[k] >= np.log(apart) else 1.0


def _together(a: Line, b: Line) -> bool:
    """Do two lines stand in one container, or one of them in a container inside the other's? The page's body alone joins only its own lines."""
    inner, outer = (a, b) if a.container.depth >= b.container.depth else (b, a)
    if outer.container.depth <= 1:
        return inner.container.depth <= 1
    return outer.container.first <= inner.at < outer.container.end


def surges(lines: list[Line], weights: np.ndarray, floor: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, end) of each run of lines from a surge of the window sums to the dive that ends it."""
    full = window_sums(weights, window) >= floor
    found: list[tuple[int, int]] = []
    heavy = weights * window >= floor
    i = 0
    while i < len(lines):
        if not full[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and full[j]:
            j += 1
        end = min(len(lines), j - 1 + window)
        text = [k for k in range(i, end) if heavy[k] and weights[k]] or [i + int(np.argmax(weights[i:end]))]
        first, last = text[0], text[-1]
        # short lines beside the text belong to it if they stand in its container, however many they are
        while first and weights[first - 1] and _together(lines[first - 1], lines[text[0]]):
            first -= 1
        while last + 1 < len(lines) and weights[last + 1] and _together(lines[last + 1], lines[text[-1]]):
            last += 1
        if found and lines[first].container.depth > 1 and _together(lines[found[-1][1] - 1], lines[first]):
            first = found.pop()[0]  # what lies between two surges of one container is part of it
        found.append((first, last + 1))
        i = max(j, last + 1)
    return found


def main_text(source: str | None) -> str:
    lines = page_lines(source or "")
    weights = line_weights(lines)
    floor = page_floor(window_sums(weights))
    return "\n".join(x.text for a, b in surges(lines, weights, floor) for x in lines[a:b] if x.text)


@F.pandas_udf(StringType())
def _main_text(sources: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in sources], dtype=object)


def extract_text(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of each html in column `into`; a null, empty or textless page gives ''.

    A column of that name is replaced; all others, repeated rows and null ids stay as they are. A narrow map over pages: no
    shuffle, and Arrow batches of bounded rows. Truncated markup, an open quote in a tag too, ends at the end of the page; unknown character
    references stay as written. An empty table gives no rows.
    """
    small_arrow_batches(pages.sparkSession)
    return pages.withColumn(into, _main_text(F.col(html_column)))
