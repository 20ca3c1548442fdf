"""Joins of exploded rows and of compressed tables are no broadcasts, however small Spark takes them for."""

from pyspark.sql import functions as F

from loomspan.operators import boxes, inpaint, pixels, strokes
from loomspan.plans import catalog, kernel_queries  # noqa: F401 (registers queries)

SF = "/root/testdata/sf0.001"


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_box_joins_are_not_broadcast(spark):
    items = spark.range(50).select("id", F.lit(1).alias("k"), *[(F.col("id") % 7 + n).cast("double").alias(c) for c, n in (("x0", 0), ("x1", 3), ("y0", 0), ("y1", 2))])
    assert broadcasts(boxes.box_pairs(items, items, ["k"])) == broadcasts(boxes.near_pairs(items, ["k"])) == 0


def test_occlusion_count_is_not_broadcast(spark):
    assert broadcasts(catalog.QUERIES["occlusion_count"](spark, SF)) == 0


def test_a_layer_is_filled_without_broadcasts(spark):
    near = spark.createDataFrame([(1, 0, 0, 0.0, 7), (1, 0, 1, 0.0, 9)], "img long, y long, x long, u double, r int")
    target = spark.createDataFrame([(1, 0, 2, 1.0, 0), (1, 50, 50, 1.0, 3)], "img long, y long, x long, u double, r int")
    filled = inpaint.fill_layer(target, near, ["img"], ["r"], skip=None)
    assert broadcasts(filled) == 0 and {(q["y"], q["x"]): q["r"] for q in filled.collect()} == {(0, 2): 9, (50, 50): 3}


def test_first_layers_alone_equal_those_of_the_whole_filling(spark, monkeypatch):
    field = spark.range(400).selectExpr("1L AS img", "id DIV 20 AS y", "id % 20 AS x", "CAST(id * 37 % 256 AS INT) AS r")
    mask = field.where("y BETWEEN 4 AND 15 AND x BETWEEN 4 AND 15").select("img", "y", "x")
    whole = inpaint.inpaint(field, mask, ["img"], ["r"], skip=None)
    filled, fill = [], inpaint.fill_layer
    monkeypatch.setattr(inpaint, "fill_layer", lambda *a: filled.append(1) or fill(*a))
    first = inpaint.inpaint(field, mask, ["img"], ["r"], skip=None, layers=2)
    rows = lambda df: sorted(tuple(q) for q in df.collect())
    assert len(filled) == 2 and rows(first) == rows(whole.where("layer <= 2")) and whole.agg({"layer": "max"}).first()[0] > 2


def test_separators_and_edges_are_found_without_broadcasts(spark):
    ink = spark.createDataFrame([(1, y, x) for y in range(9) for x in (0, 1, 3, 7)], "img long, y long, x long")
    gaps = spark.createDataFrame([(1, 4, 4, 1, 7, 6)], "img long, y long, id long, x0 long, x1 long, goal long")
    found = strokes.separators(ink, gaps, ["img"])
    assert broadcasts(found) == 0 and [(q["id"], q["mid"], q["explored"]) for q in found.orderBy("mid").collect()] == [(4, 1, 10), (4, 3, 10)]
    assert broadcasts(pixels.components(ink.withColumn("p", F.expr("y * 40 + x")), ["img"], "p")) == 0


def test_rays_that_met_an_edge_take_no_more_steps(spark, monkeypatch):
    edges = spark.createDataFrame([(1, y, x, d, 0.0) for y in range(4) for x, d in ((2, 5.0), (4, -5.0), (30, 5.0), (60, -5.0))], "img long, y long, x long, dx double, dy double")
    tables, write = {}, strokes.materialise
    monkeypatch.setattr(strokes, "materialise", lambda df, name: tables.setdefault((name, len(tables)), write(df, name)))
    found = strokes.rays(edges, ["img"])
    assert broadcasts(found) == 0 and {(q["x"], q["steps"], q["width"]) for q in found.collect()} == {(2, 2, 2.0), (4, 2, 2.0), (30, 30, 30.0), (60, 30, 30.0)}
    assert next(df.count() for (name, _), df in tables.items() if name == "open") == 8
