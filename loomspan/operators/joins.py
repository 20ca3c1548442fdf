"""Overlap, range and nearest-neighbour joins as equi-joins on buckets, or as windows over the union of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.boxes import box_pairs


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs of intervals [x0, x1] with equal keys that overlap, each once; other columns get the sides' suffixes.

    Intervals lie on grids as wide as they are, so a long one takes no more cells than a short one. Null ends match nothing.
    """
    return box_pairs(left, right, keys, ["x"], suffixes=suffixes)


def nearest_before(left: DataFrame, right: DataFrame, key: str, at: str, carry: list[str], within: float) -> DataFrame:
    """left with struct `hit` of (at, *carry) from the latest right row of the key at or before `at` by up to `within`; else null.

    Both sides are one sorted run per key and the hit is the last right row seen: no pair is built. The greatest
    `carry` of the latest rows wins; repeated left rows stay. Rows with null keys or times find nothing.
    """
    hit = F.struct(F.col(at).alias("at"), *carry)
    found = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), F.col(at).alias("t"), hit.alias("hit"), F.lit(0).alias("side"))
    rows = left.select(F.col(key).alias("k"), F.col(at).alias("t"), F.struct(*left.columns).alias("row"), F.lit(1).alias("side"))
    both = found.unionByName(rows, allowMissingColumns=True)
    seen = Window.partitionBy("k").orderBy("t", "side", F.col("hit").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("last", F.last("hit", ignorenulls=True).over(seen)).where("side = 1")
    near = F.col("last.at") >= F.col("t") - F.lit(within)
    return last.select("row.*", F.when(near, F.col("last")).alias("hit"))
