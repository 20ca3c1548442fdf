"""Gaps, sessions, smoothing, merged intervals and overlapping partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_gap(df: DataFrame, keys: list[str], order: list[str], at: str, into: str = "gap") -> DataFrame:
    """df with the distance to the previous row of its key, at least 0; null for the first row."""
    before = F.lag(at).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(into, F.when(before.isNotNull(), F.greatest(F.col(at) - before, F.lit(0))))


def gap_sessions(df: DataFrame, keys: list[str], order: list[str], breaks: Column, into: str = "session") -> DataFrame:
    """df with a session number from 0 in each key; a row for which `breaks` holds begins a new one."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(F.when(breaks, 1).otherwise(0)).over(upto))


def damped(values: Column, keep: float = 0.5) -> Column:
    """The last m of m = keep * m + (1 - keep) * v over an array, from 0."""
    return F.aggregate(values, F.lit(0.0), lambda m, v: F.lit(keep) * m + F.lit(1 - keep) * v)


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """(keys, start, end, n): the unions of intervals that overlap or touch."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    islands = gap_sessions(df.withColumn("begins", fresh), keys, [start, end], F.col("begins"), "island")
    return islands.groupBy(*keys, "island").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n")).drop("island")


def chunk_count(height: Column, size: int, halo: int) -> Column:
    """How many strips of `size` that overlap by `halo` cover a height; at least one."""
    return F.greatest(F.lit(1), F.ceil((height - F.lit(halo)) / F.lit(size - halo))).cast("int")


def chunks(df: DataFrame, height: str, size: int, halo: int) -> DataFrame:
    """df with one row for each strip: chunk number, top and bottom."""
    each = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunk_count(F.col(height), size, halo) - 1)))
    top = F.col("chunk") * F.lit(size - halo)
    return each.withColumns({"top": top, "bottom": F.least(top + F.lit(size), F.greatest(F.col(height), F.lit(size)))})


def candidate_chunks(y: Column, height: Column, size: int, halo: int) -> Column:
    """The strips that hold y, the one whose core it lies in first."""
    step = size - halo
    last = chunk_count(height, size, halo) - 1
    own = F.least(F.floor(y / F.lit(step)).cast("int"), last)
    other = own - 1
    return F.when((other >= 0) & (y < other * F.lit(step) + F.lit(size)), F.array(own, other)).otherwise(F.array(own))
