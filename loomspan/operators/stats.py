"""Thresholds, robust fits and histogram comparisons, all on pre-aggregated counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import materialise, small_arrow_batches

POINTS = 1024


def histogram(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, bin, n): rows for each whole value; combined before its shuffle, so a hot key costs no more than its bins."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, F.floor(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def otsu(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, threshold, n): the whole value that maximises the variance between those up to it and those above; first of ties.

    The window runs over the bins of a key and not over its rows. A key with one bin has threshold 0.
    """
    bins = histogram(df, keys, value)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    weighted = F.col("bin") * F.col("n")
    cum = bins.select(*keys, "bin", F.sum("n").over(upto).alias("w"), F.sum(weighted).over(upto).alias("s"), F.sum("n").over(whole).alias("tw"), F.sum(weighted).over(whole).alias("ts"))
    apart = F.col("s") / F.col("w") - F.try_divide(F.col("ts") - F.col("s"), F.col("tw") - F.col("w"))
    between = F.when(F.col("tw") > F.col("w"), F.col("w") * (F.col("tw") - F.col("w")) * apart * apart).otherwise(F.lit(0.0))
    scored = cum.withColumn("between", F.round(between, 3))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("bin", "between"), F.struct("between", -F.col("bin"))).alias("best"), F.max("tw").alias("n"))
    return best.select(*keys, F.when(F.col("best.between") > 0, F.col("best.bin")).otherwise(0).cast("long").alias("threshold"), "n")


def upper_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, med): the element at floor(n/2) of every key's sorted values, exact, with no group in one task.

    Equal values are one row with a count. These are dealt to ranges of (keys, value), so a large key spreads over tasks;
    the counts of the ranges tell which of them holds the median, and only that one is ordered. Null values don't count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(counts.repartitionByRange(parts, *keys, "v").withColumn("part", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy(*keys, "part").agg(F.sum("n").alias("w"))
    upto, whole = Window.partitionBy(*keys).orderBy("part"), Window.partitionBy(*keys)
    placed = ranges.select(*keys, "part", (F.sum("w").over(upto) - F.col("w")).alias("before"), F.col("w"), F.floor(F.sum("w").over(whole) / 2).alias("rank"))
    placed = placed.where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("w"))).withColumnsRenamed({k: f"{k} of the range" for k in keys})
    on = [dealt[k].eqNullSafe(placed[f"{k} of the range"]) for k in keys] + [dealt["part"] == placed["part"]]
    inside = dealt.join(placed, on).select(*[dealt[k] for k in keys], "v", "n", "before", "rank")
    reached = F.col("before") + F.sum("n").over(Window.partitionBy(*keys).orderBy("v"))
    return inside.withColumn("reached", reached).where("reached > rank").groupBy(*keys).agg(F.min("v").alias("med"))


def deviation_about_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, med, mad): mean absolute deviation about the upper median; the medians are joined back, one row a key."""
    medians = upper_medians(df, [key], value)
    return df.join(medians, key).groupBy(key).agg(F.first("med").alias("med"), F.avg(F.abs(F.col(value) - F.col("med"))).alias("mad"))


def _slopes(x: np.ndarray, y: np.ndarray, u: np.ndarray, v: np.ndarray, same: bool) -> Iterator[np.ndarray]:
    """Slopes between the points (x, y) and (u, v) of different x, some rows of pairs at once; same: both are one block, each pair counts once."""
    for i in range(0, len(x), 64):
        dx, dy = u[None, :] - x[i : i + 64, None], v[None, :] - y[i : i + 64, None]
        taken = dx != 0
        if same:
            taken &= np.arange(len(u))[None, :] > np.arange(i, min(i + 64, len(x)))[:, None]
        with np.errstate(all="ignore"):
            yield dy[taken] / dx[taken] + 0.0


def _ranked(slopes: np.ndarray) -> np.ndarray:
    """Numbers without sign that are ordered as the slopes are."""
    bits = slopes.view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _unranked(rank: int) -> float:
    return float(np.array([rank ^ (1 << 63) if rank >> 63 else rank ^ ((1 << 64) - 1)], dtype=np.uint64).view(np.float64)[0])


def _points(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False).astype(np.float64)


def _block_slopes(batch: pa.RecordBatch, row: int) -> Iterator[np.ndarray]:
    return _slopes(*(_points(batch, c, row) for c in ("xs", "ys", "us", "vs")), batch.column("same")[row].as_py())


def _whole_medians(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in range(batch.num_rows):
            slopes = np.concatenate([np.zeros(0), *_block_slopes(batch, row)])
            out.append(float(np.partition(slopes, len(slopes) // 2)[len(slopes) // 2]) if len(slopes) else None)
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out, pa.float64())], ["key", "slope"])


def _digit_counts(digit: int):
    """Counts of the next 16 bits of the ranks that begin with the digits found so far, for every pair of blocks."""
    down = np.uint64(48 - 16 * digit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                begins, counts = np.uint64(batch.column("found")[row].as_py() % (1 << 64)), np.zeros(1 << 16, dtype=np.int64)
                for slopes in _block_slopes(batch, row):
                    ranks = _ranked(slopes)
                    if digit:
                        ranks = ranks[ranks >> (down + np.uint64(16)) == begins]
                    counts += np.bincount(((ranks >> down) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
                used = np.flatnonzero(counts)
                keys = batch.column("key").take(pa.array([row] * len(used), pa.int32()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(used), pa.array(counts[used])], ["key", "digit", "n"])

    return run


def theil_sen(df: DataFrame, key: str, x: str, y: str, block: int = POINTS) -> DataFrame:
    """(key, slope): upper median of the slopes of all pairs with different x; null for a key without such a pair.

    Points of a key are dealt to blocks of about `block`, and pairs of blocks, not of points, are joined. A key of one block
    is settled at once; for one of more, the median is found by four passes that each count 16 more bits of the slopes.
    Rows whose key, x or y is null are left out.
    """
    small_arrow_batches(df.sparkSession)
    points = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    sizes = points.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    dealt = points.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("x", "y", F.monotonically_increasing_id()), F.col("blocks")))
    kept = materialise(dealt.groupBy("key", "blocks", "block").agg(F.collect_list("x").alias("xs"), F.collect_list("y").alias("ys")), "points")
    kind = kept.schema["key"].dataType.simpleString()
    single = kept.where("blocks = 1").select("key", "xs", "ys", F.col("xs").alias("us"), F.col("ys").alias("vs"), F.lit(True).alias("same"))
    medians = single.mapInArrow(_whole_medians, f"key {kind}, slope double")
    large = kept.where("blocks > 1")
    if not large.isEmpty():
        others = large.select(F.col("key").alias("k"), F.col("block").alias("b"), F.col("xs").alias("us"), F.col("ys").alias("vs"))
        pairs = large.join(others, (F.col("key") == F.col("k")) & (F.col("block") <= F.col("b"))).withColumn("same", F.col("block") == F.col("b"))
        found = large.select("key", F.lit(0).cast("long").alias("found"), F.lit(None).cast("long").alias("left")).distinct()
        for digit in range(4):
            each = pairs.join(found, "key").repartition(F.col("key"), F.col("block"), F.col("b")).select("key", "xs", "ys", "us", "vs", "same", "found")
            counts = each.mapInArrow(_digit_counts(digit), f"key {kind}, digit long, n long").groupBy("key", "digit").agg(F.sum("n").alias("n"))
            upto = Window.partitionBy("key").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
            summed = counts.withColumns({"upto": F.sum("n").over(upto), "all": F.sum("n").over(Window.partitionBy("key"))}).join(found, "key")
            left = F.coalesce("left", F.floor(F.col("all") / 2))
            hit = summed.withColumn("left", left).where("upto > left AND upto - n <= left")
            found = materialise(hit.select("key", (F.shiftleft("found", 16) + F.col("digit")).alias("found"), (F.col("left") - F.col("upto") + F.col("n")).alias("left")), "slopes")
        slope = F.udf(lambda rank: None if rank is None else _unranked(rank % (1 << 64)), "double")
        settled = large.select("key").distinct().join(found, "key", "left")
        medians = medians.union(settled.select("key", slope("found").alias("slope")))
    return medians.select(F.col("key").alias(key), "slope")


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def dominant_bins(df: DataFrame, value: str, inside: Column, factor: float) -> DataFrame:
    """(bin, n_in, n_out) of bins that hold over `factor` times as many rows inside as outside, plus one."""
    counts = df.groupBy(F.floor(value).cast("int").alias("bin")).agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"))
    return counts.where(F.col("n_in") > F.lit(factor) * (1 + F.col("n_out")))


def densest_window(df: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    """(keys, center, mass): the bin whose neighbourhood [-radius, radius) holds most rows; least of ties."""
    around = Window.partitionBy(*keys).orderBy("bin").rangeBetween(-radius, radius - 1)
    mass = histogram(df, keys, value).withColumn("mass", F.sum("n").over(around))
    best = mass.groupBy(*keys).agg(F.max_by(F.struct("bin", "mass"), F.struct("mass", -F.col("bin"))).alias("b"))
    return best.select(*keys, F.col("b.bin").cast("long").alias("center"), F.col("b.mass").alias("mass"))


def neighbour_votes(df: DataFrame, bins: list[str]) -> DataFrame:
    """(bins, votes): every row votes for its own bin and the two next to it along each axis."""
    steps = [[0] * len(bins)] + [[s if i == k else 0 for i in range(len(bins))] for k in range(len(bins)) for s in (-1, 1)]
    own = df.groupBy(*bins).agg(F.count("*").alias("n"))
    moved = own.withColumn("step", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])))
    return moved.groupBy(*[(F.col(b) + F.col("step")[i]).alias(b) for i, b in enumerate(bins)]).agg(F.sum("n").alias("votes"))
