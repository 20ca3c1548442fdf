"""Line-block distribution on pages without tell-tale names, against a plain version on marked ones, and under Spark."""

import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspan.llm import html_text
from loomspan.llm.html_text import extract_text, line_weights, main_text, page_floor, page_lines, surges, window_sums

LONG = [" ".join(f"word{k}{j} of the story" for j in range(20 + 5 * k)) + "." for k in range(5)]
CELLS = "".join(f"<td>Item {k}</td>" for k in range(9))
PAGE = (
    f"<body><table><tr>{CELLS}</tr></table><div id=a7><p>Short notice.</p></div>"
    f"<div id=b2><h1>Head</h1><p>{LONG[0]}</p><p>{LONG[1]}</p><p>Yes.</p><p>{LONG[2]}</p><p>{LONG[3]}</p><p>The end.</p></div>"
    "<div id=c3><p>All rights reserved</p><p>Imprint</p></div></body>"
)
WANT = "\n".join(["Head", LONG[0], LONG[1], "Yes.", LONG[2], LONG[3], "The end."])


def test_text_between_surge_and_dive():
    assert main_text(PAGE) == WANT


def test_without_the_surge_step_the_page_keeps_everything(monkeypatch):
    monkeypatch.setattr(html_text, "page_floor", lambda sums: 1.0)
    assert main_text(PAGE) != WANT and "Item 3" in main_text(PAGE)


def test_a_giant_paragraph_drops_no_others():
    giant = " ".join(["giant"] * 20_000)
    page = f"<body><div id=x>{'<p>Cell</p>' * 8}</div><div id=y><p>{LONG[0]}</p><p>{giant}</p><p>{LONG[1]}</p><p>{LONG[2]}</p></div></body>"
    assert main_text(page) == "\n".join([LONG[0], giant, LONG[1], LONG[2]])


def test_an_article_weighs_more_than_long_lines_beside_it():
    page = f"<body><div id=legal>{LONG[2]}</div><article><h1>Head</h1><p>{LONG[0]}</p><p>{LONG[1]}</p></article><div id=z>{LONG[3]}</div></body>"
    assert main_text(page) == "\n".join(["Head", LONG[0], LONG[1]])


def test_links_between_two_parts_of_one_container_stay():
    links = "".join(f"<li><a href=x>Link {k}</a></li>" for k in range(5))
    page = f"<body><ul>{links}</ul><div><p>{LONG[0]}</p><p>{LONG[1]}</p><ul>{links}</ul><p>{LONG[2]}</p><p>{LONG[3]}</p></div></body>"
    assert main_text(page) == "\n".join([LONG[0], LONG[1], *[f"Link {k}" for k in range(5)], LONG[2], LONG[3]])


def test_window_sums_and_floor_equal_plain_loops():
    r = np.random.default_rng(5)
    for _ in range(50):
        w = r.choice([0, 3, 10, 400, 900], size=r.integers(1, 30))
        sums = window_sums(w)
        assert sums.tolist() == [sum(w[i : i + 3].tolist()) for i in range(len(w))]
        level = sorted(np.log([x for x in sums.tolist() if x]))
        best, floor = -1.0, 1.0
        for k in range(1, len(level)):
            low, high = np.mean(level[:k]), np.mean(level[k:])
            if (spread := k * (len(level) - k) * (high - low) ** 2) > best + 1e-9:
                best, floor = spread, float(np.exp(level[k])) if high - low >= np.log(4) else 1.0
        assert page_floor(sums) == pytest.approx(floor)


def test_runs_start_and_end_at_the_floor():
    lines = page_lines(PAGE)
    weights = line_weights(lines)
    runs = surges(lines, weights, page_floor(window_sums(weights)))
    assert [(lines[a].text, lines[b - 1].text) for a, b in runs] == [("Head", "The end.")]


class Plain(HTMLParser):
    """Blocks of the article, by the standard parser: a second version that knows only the marks of these pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.inside = [""], False

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "h2", "li", "ul", "article"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "ul", "article"):
            self.blocks.append("")
        self.inside = self.inside and tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages_equal_the_plain_version(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract_text(pages).collect()}
    for r in pages.collect():
        plain = Plain()
        plain.feed(r["html"] or "")
        blocks = [re.sub(r"\s+", " ", b).strip() for b in plain.blocks]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def test_odd_rows(spark):
    rows = [(1, "<p>a"), (1, "<p>a"), (None, ""), (2, None), (3, "<p>x\0y</p>"), (4, "<nav>n</nav>")]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("text", F.lit("old")).withColumn("weight", F.lit(1))
    got = extract_text(df)
    assert sorted(got.columns) == ["html", "page_id", "text", "weight"]
    assert sorted((r["page_id"] or 0, r["text"]) for r in got.collect()) == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "x\0y"), (4, "")]
    assert extract_text(df.limit(0)).count() == 0
