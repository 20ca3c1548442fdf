"""The data source of layouts, table functions from SQL, and layout documents made by hand."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomspan.functions import tables
from loomspan.operators import graph, stats
from loomspan.sources import layouts


@pytest.fixture
def stored(spark, tmp_path):
    """24 lines of 3 images, 70 pixels apart, as strips in a folder."""
    layouts.register(spark)
    rows = [(f"img/{i}", f"r{k % 2}", f"l{k}", 5.0, 70.0 * k, 90.0, 70.0 * k + 20, k, 1, None if k == 3 else f"Text {k}, ß\n\"{i}\"") for i in range(3) for k in range(8)]
    lines = spark.createDataFrame(rows, "image string, region string, line string, x0 double, y0 double, x1 double, y1 double, lettercount int, direction int, text string")
    layouts.write_layouts(layouts.with_strips(lines), str(tmp_path / "store"))
    return str(tmp_path / "store"), rows


def touched(y0, y1):
    return {k for k in range(20) if k * 160 <= y1 and y0 < k * 160 + 250}


def test_strips_hold_the_lines_they_touch(spark, stored):
    path, rows = stored
    got = sorted(tuple(r) for r in spark.read.format("layouts").load(path).select("image", "strip", "line", "y0", "lettercount", F.coalesce("text", F.lit(""))).collect())
    assert got == sorted((r[0], k, r[2], r[4], r[7], r[9] or "") for r in rows for k in touched(r[4], r[6]))


def opened(df):
    return df.rdd.getNumPartitions()


def test_filters_reach_the_listing(spark, stored):
    path, rows = stored
    whole = spark.read.format("layouts").load(path)
    every = {(r[0], k) for r in rows for k in touched(r[4], r[6])}
    assert opened(whole) == len(every)
    one = whole.where("image = 'img/1' AND strip < 2 AND lettercount > 1")
    assert opened(one) == 2
    assert {(r["image"], r["strip"]) for r in one.collect()} == {("img/1", 0), ("img/1", 1)} and one.where("lettercount <= 1").count() == 0
    assert opened(whole.where("image IN ('img/0', 'img/2')")) == len({p for p in every if p[0] != "img/1"})
    assert whole.where("image = 'none'").count() == 0


def test_writes_append_overwrite_and_fail_whole(spark, stored):
    path, rows = stored
    before = spark.read.format("layouts").load(path).count()
    more = spark.createDataFrame([("img/1", 0, "new")], "image string, strip int, line string")
    layouts.write_layouts(more, path)
    assert spark.read.format("layouts").load(path).count() == before + 1
    bad = spark.createDataFrame([("img/1", 0, "x"), ("img/1", None, "y")], "image string, strip int, line string").coalesce(1)
    with pytest.raises(Exception, match="no strip"):
        bad.write.format("layouts").mode("append").save(path)
    assert spark.read.format("layouts").load(path).count() == before + 1
    layouts.write_layouts(more, path, "overwrite")
    assert [r["line"] for r in spark.read.format("layouts").load(path).collect()] == ["new"]
    assert not list(Path(path).rglob("_strip*.json")) or spark.read.format("layouts").load(path).count() == 1


def test_table_functions_equal_the_operators(spark):
    tables.register(spark)
    tables.predicate(spark, "beside", "STRUCT<x0: DOUBLE, x1: DOUBLE>", "b.x0 - a.x1 BETWEEN 0 AND 3")
    boxes = spark.range(60).selectExpr("id", "id DIV 20 AS img", "CAST(id % 20 * 10 + id * id % 7 AS DOUBLE) AS x0").withColumn("x1", F.col("x0") + 7)
    boxes.createOrReplaceTempView("boxes")
    pairs = spark.sql("SELECT a.id AS a, b.id AS b, a.img FROM boxes a JOIN boxes b ON a.img = b.img WHERE beside(struct(a.x0, a.x1), struct(b.x0, b.x1))")
    pairs.createOrReplaceTempView("pairs")
    assert pairs.count() > 10
    got = spark.sql("SELECT node, component FROM equivalence_classes(TABLE(SELECT a, b, img FROM pairs))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, graph.connected_components(pairs, "a", "b").collect()))
    odd = spark.sql("SELECT * FROM equivalence_classes(TABLE(SELECT * FROM VALUES (1L, NULL, 'k'), (5L, 5L, 'k'), (9L, 2L, 'k'), (9L, 4L, 'k'), (9L, 8L, 'm') AS t(a, b, k)))")
    assert sorted(map(tuple, odd.collect())) == [("k", 2, 2), ("k", 4, 2), ("k", 5, 5), ("k", 9, 2), ("m", 8, 8), ("m", 9, 8)]
    single = spark.sql("SELECT * FROM equivalence_classes(TABLE(SELECT a, b FROM pairs))")
    assert sorted(map(tuple, single.collect())) == sorted(map(tuple, graph.connected_components(pairs, "a", "b").collect()))
    items = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    items.createOrReplaceTempView("items")
    got = spark.sql("SELECT l_returnflag, threshold, n FROM otsu_cluster(TABLE(SELECT l_quantity, l_returnflag FROM items))")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stats.otsu(items, ["l_returnflag"], "l_quantity").collect()))
    assert spark.sql("SELECT * FROM otsu_cluster(TABLE(SELECT CAST(NULL AS DOUBLE) AS v, 1 AS k))").count() == 0


def test_strips_in_json_are_plain(stored):
    path, rows = stored
    file = next(Path(path).glob("img%2F0/strip-0-*.json"))
    assert [json.loads(x)["line"] for x in file.read_text().splitlines()] == [r[2] for r in rows[:8] if 0 in touched(r[4], r[6])]
