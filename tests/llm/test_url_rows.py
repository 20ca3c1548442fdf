"""The cascade on odd rows, on several blocks and on lists that the corpus doesn't hold."""

import pytest
from pyspark.sql import functions as F

from loomspan.llm import url_filter
from loomspan.llm.url_filter import Rule, judge_urls, listed_in_cascade


def test_odd_rows(spark):
    rows = [(1, None), (1, None), (None, "http://a.com/x"), (2, "no scheme"), (3, ""), (4, "HTTP://B.Com/En?q#f"), (5, "x://h"), (6, "http://a.com/x")]
    pages = spark.createDataFrame([(*r, "k", "h", True) for r in rows], "page_id long, url string, key string, host string, in_list boolean")
    listed = spark.createDataFrame([("a.com/x",), ("a.com/x",), (None,), ("nowhere/",)], "key string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in judge_urls(pages, [Rule("com", "/En", "block")], listed).collect())
    assert got == [(0, "a.com", "/x", "", "block"), (1, "", "", "", "allow"), (1, "", "", "", "allow"), (2, "", "", "", "allow"), (3, "", "", "", "allow"), (4, "b.com", "/En", "com/En", "block"), (5, "h", "", "", "allow"), (6, "a.com", "/x", "", "block")]
    assert judge_urls(pages.limit(0), [], listed).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, [], listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("bits", [1 << 26, 1 << 11])
def test_membership_is_exact_in_blocks(spark, bits, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BITS", bits)
    rows = spark.range(3000).select(F.concat(F.lit("key "), (F.col("id") % 1500).cast("string")).alias("key"), "id").union(spark.createDataFrame([(None, -1)], "key string, id long"))
    listed = spark.range(0, 4000, 7).select(F.concat(F.lit("key "), F.col("id").cast("string")).alias("key"))
    got = {(r["key"], r["hit"]) for r in listed_in_cascade(rows, "key", listed, "hit").collect()}
    assert got == {(f"key {k}", k % 7 == 0) for k in range(1500)} | {(None, False)}
