"""Queries and operators that must read every row of a key."""

import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import joins, stats
from loomspan.operators.boxes import box_pairs, near_pairs
from loomspan.plans import catalog, kernel_queries, layout_queries, text_queries  # noqa: F401 (the last three register queries)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [1024, 8])
def test_theil_sen_takes_all_pairs(spark, block):
    r = random.Random(3)
    points = [(k, float(r.randrange(60)), r.choice([-2.0, 0.0, 0.5, 3.0]) * r.randrange(9)) for k, n in ((1, 90), (2, 40), (3, 13), (4, 2)) for _ in range(n)]
    points += [(5, 1.0, float(i)) for i in range(20)] + [(6, float(i), 7.0) for i in range(50)] + [(7, 1.0, None), (7, None, 1.0)]
    got = {x["user"]: x["slope"] for x in stats.theil_sen(spark.createDataFrame(points, "user long, x double, y double"), "user", "x", "y", block).collect()}
    want = {}
    for k in range(1, 7):
        own = [p for p in points if p[0] == k]
        slopes = sorted((b[2] - a[2]) / (b[1] - a[1]) for a in own for b in own if a[1] < b[1])
        want[k] = slopes[len(slopes) // 2] if slopes else None
    assert got == want


def test_medians_of_large_keys_equal_sorting(spark):
    r = random.Random(4)
    rows = [(k, r.choice([None, 7.0, float(r.randrange(50)), r.random()])) for k in ("a", "b", None) for _ in range(301)] + [("one", 3.0), ("none", None)]
    got = {x["k"]: x["med"] for x in stats.upper_medians(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v").collect()}
    want = {}
    for k in ("a", "b", None, "one"):
        own = sorted(v for key, v in rows if key == k and v is not None)
        want[k] = own[len(own) // 2]
    assert got == want
    assert stats.upper_medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


def test_latest_before_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 10.0), (1, 10.0), (1, 30.0), (2, 5.0), (None, 1.0), (1, None)], "k long, at double")
    right = spark.createDataFrame([(1, 9.0, "a"), (1, 10.0, "b"), (1, 10.0, "c"), (1, 11.0, "d"), (3, 5.0, "e"), (None, 1.0, "f")], "k long, at double, v string")
    got = sorted((r["k"] or 0, r["at"] or 0.0, r["hit"]["v"] if r["hit"] else "") for r in joins.nearest_before(left, right, "k", "at", ["v"], 5.0).collect())
    assert got == [(0, 1.0, ""), (1, 0.0, ""), (1, 10.0, "c"), (1, 10.0, "c"), (1, 30.0, ""), (2, 5.0, "")]


def test_box_pairs_of_any_size_equal_nested_loop(spark):
    r = random.Random(6)
    boxes = [(i, i % 2, x, x + r.choice([0.0, 0.5, 3.0, 900.0]), y, y + r.choice([0.1, 2.0, 40.0])) for i in range(120) for x, y in [(r.uniform(-50, 50), r.uniform(-50, 50))]]
    df = spark.createDataFrame([*boxes, (500, 0, None, 1.0, 0.0, 1.0), (501, 0, 2.0, 1.0, 0.0, 1.0)], "id long, k long, x0 double, x1 double, y0 double, y1 double")
    pairs = [(x["id_l"], x["id_r"]) for x in box_pairs(df, df, ["k"], reach=[2.0, 0.5]).collect()]
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[1] == b[1] and a[2] - 2 <= b[3] and b[2] <= a[3] + 2 and a[4] - 0.5 <= b[5] and b[4] <= a[5] + 0.5}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_near_pairs_equal_nested_loop_and_one_far_box_costs_only_its_own(spark):
    r = random.Random(9)
    boxes = [(i, i % 2, x, x + r.choice([0.0, 0.5, 3.0, 60.0]), y, y + r.choice([0.1, 2.0, 40.0]), r.choice([0.0, 0.3, 5.0, None])) for i in range(150) for x, y in [(r.uniform(-50, 50), r.uniform(-50, 50))]]
    df = spark.createDataFrame([*boxes, (500, 0, None, 1.0, 0.0, 1.0, 1.0), (501, 0, 2.0, 1.0, 0.0, 1.0, 1.0)], "id long, k long, x0 double, x1 double, y0 double, y1 double, far double")
    pairs = [(x["id_l"], x["id_r"]) for x in near_pairs(df, ["k"], reach=[F.col("far"), 0.5]).collect()]
    touch = lambda a, b: a[2] - (a[6] or 0) <= b[3] + (b[6] or 0) and b[2] - (b[6] or 0) <= a[3] + (a[6] or 0) and a[4] - 0.5 <= b[5] + 0.5 and b[4] - 0.5 <= a[5] + 0.5
    want = {(a[0], b[0]) for a in boxes for b in boxes if a[0] < b[0] and a[1] == b[1] and touch(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
    grid = [(40 * i + j, 1, 10.0 * i, 10.0 * i + 4, 10.0 * j, 10.0 * j + 4) for i in range(40) for j in range(40)]
    schema = "id long, k long, x0 double, x1 double, y0 double, y1 double"
    met = {}
    for name, more in (("even", []), ("far", [(9999, 1, 0.0, 4.0, 0.0, 4.0)])):
        rows = spark.createDataFrame(grid + more, schema)
        met[name] = near_pairs(rows, ["k"], reach=[F.when(F.col("id") == 9999, 10_000.0).otherwise(1.0), F.when(F.col("id") == 9999, 10_000.0).otherwise(1.0)]).count()
    assert met["even"] == 0 and met["far"] == 1600


def test_garbled_documents_are_all_judged(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = catalog.QUERIES["bad_text_documents"](spark, SF)
    assert got.count() == docs.count() and got.select(F.count_distinct("garbled")).first()[0] == 2


@pytest.mark.parametrize("name", ["letter_pairs", "nearest_letters", "selected_lines", "built_lines", "crowded_selections", "paragraphs", "stroke_widths", "crawled_lines", "inpainted", "arrival_times", "wrap_least_ragged", "fitted_sizes"])
def test_empty_tables_give_no_rows(spark, tmp_path, name):
    for table in ("part", "orders", "events", "customer", "conversations"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 0
