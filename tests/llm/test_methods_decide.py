"""Results come through the method named: leave a part of it out and they change. And hostile shapes: nested or open tags, repeated rows, short items."""

import time

import pytest
from pyspark.sql import functions as F

from loomspan.llm import html_text, queries, url_filter
from loomspan.llm.decontaminate import contaminated, uncontaminated
from loomspan.llm.html_text import main_text
from loomspan.llm.kd_shards import kd_shards

SF = "/root/testdata/sf0.01"


def test_every_level_of_the_cascade_decides_verdicts(spark, monkeypatch):
    def verdicts():
        return {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op4_url_filter(spark, SF).collect()}

    whole = verdicts()
    assert {v for _, v in whole.values()} == {"allow", "block"}
    monkeypatch.setattr(url_filter, "BITS_PER_KEY", (1, 1))
    monkeypatch.setattr(url_filter, "PROBES", (1, 1))
    levels = []
    build = url_filter.build_cascade
    monkeypatch.setattr(url_filter, "build_cascade", lambda keys: levels.append(build(keys)) or levels[-1])
    rows = spark.range(6000).select(F.concat(F.lit("http://h"), (F.col("id") % 3).cast("string"), F.lit(".com/"), F.col("id").cast("string")).alias("url"), F.col("id").alias("page_id"))
    rules = [url_filter.Rule("h1.com", "/", "block"), url_filter.Rule("h2.com", "/1", "block"), url_filter.Rule("h1.com", "/4", "allow")]

    def judged():
        return {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(rows, rules).collect()}

    want = {i: "block" if (i % 3 == 1 and not str(i).startswith("4")) or (i % 3 == 2 and str(i).startswith("1")) else "allow" for i in range(6000)}
    assert judged() == want
    count = len(levels[-1].levels)
    assert count > 2
    for k in range(count):
        monkeypatch.setattr(url_filter, "build_cascade", lambda keys, k=k: url_filter.Cascade([x for i, x in enumerate(build(keys).levels) if i != k]))
        assert judged() != want


def test_article_lines_win_by_weight(monkeypatch):
    beside = "".join(f"<p>A line of the side, number {k}.</p>" for k in range(6))
    article = "".join(f"<p>{'A sentence of the story, longer than most. ' * 3}{k}</p>" for k in range(5))
    page = f"<body><div>{beside}</div><article>{article}</article><div>{beside}</div></body>"
    assert "side" not in main_text(page) and main_text(page).count("\n") == 4
    monkeypatch.setattr(html_text, "page_floor", lambda sums: 1.0)
    assert "side" in main_text(page)


@pytest.mark.parametrize("shape", ["<p>x</p><noscript>a ", "<div>text here ", '<a "', "<span class=ad>", "<svg ", "<script ", "<template><p>y</p>", "</p></section>", "<li>a<td>b", "<!-- "])
def test_long_pages_of_open_tags_take_linear_time(shape):
    began = time.process_time()
    main_text("<div>" * 20_000 + shape * 20_000)
    assert time.process_time() - began < 10


def test_content_of_closed_elements_is_dropped_and_of_open_ones_kept():
    assert main_text("<p>a</p><noscript><p>b</p></noscript><p>c</p><svg><text>d</text></svg >") == "a\nc"
    assert main_text("<p>a</p><noscript><p>b</p>") == "a\nb"
    assert main_text('<p>a</p><p title="x>b</p>') == "a"


def test_repeated_rows_are_dealt_like_others(spark):
    rows = [(7, "same text " * 9, "web", "en")] * 900 + [(100 + k, "another text " * (k % 9 + 1), "web", "en") for k in range(100)] + [(None, None, None, None)] * 40
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = kd_shards(docs, 4).toPandas()
    total, each = got["size"].sum(), got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and sorted(each.index) == [0, 1, 2, 3]
    assert all(abs(x - total / 4) <= 3 * got["size"].max() for x in each)
    for _, part in got.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))


def test_short_items_are_found_inside_texts(spark):
    bench = spark.createDataFrame([(1, "Paris is nice"), (2, "42 km"), (3, "No."), (4, None), (5, "")], "item_id long, text string")
    texts = ["before it all Paris is nice now and then", "PARIS, is nice!", "in lovely Paris is very nice", "ran 42 km. no", "ran 43 km", "Is Nice Paris is nice Paris is nice", None, "nothing", "Paris is", "is nice"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["word"]) for r in contaminated(docs, bench).collect()}
    assert got == {(0, 1, 3), (1, 1, 0), (3, 2, 1), (3, 3, 3), (5, 1, 2)}
    assert sorted(r["doc_id"] for r in uncontaminated(docs, bench).collect()) == [2, 4, 6, 7, 8, 9]
