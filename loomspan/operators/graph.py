"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import discard, large, materialise

MAX_ROUNDS = 60


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """One contraction. larger_only: the large star (neighbours above a node move to its least neighbour)."""
    if larger_only:
        sides = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sides = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = sides.join(large(least), "u")
    if larger_only:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): the least node reachable from every node that has an edge.

    Each round is a grouped minimum (combined before its shuffle) and a join that adaptive
    execution may split where one node has very many edges. Rounds grow with the logarithm of
    the longest chain. Null ends and self-loops are ignored; an empty edge list gives no rows.
    """
    now = materialise(edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        after = materialise(_star(_star(now, True), False), "edges")
        discard(now)
        now = after
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
