"""Letters to words, lines and regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.sequences import gap_sessions
from loomspan.operators.stats import otsu

CROWDED_GAPS = 15
LEAST_SPREAD = 0.4


def bounding_box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def word_breaks(letters: DataFrame) -> DataFrame:
    """letters (src, region, line, x0, x1, cx, ...) with their gap to the left and the number of their word in the line.

    A region's threshold is the Otsu threshold of the whole gaps of its lines; in crowded lines the largest gap counts
    as the second largest. A region with three gaps or fewer, or whose gaps hardly vary, has one word a line.
    """
    place = ["src", "region", "line"]
    row = Window.partitionBy(*place).orderBy("cx", "x0")
    gap = F.when(F.lag("x1").over(row).isNotNull(), F.greatest(F.lit(0.0), F.col("x0") - F.lag("x1").over(row)))
    gaps = letters.withColumn("gap", gap)
    rank = Window.partitionBy(*place).orderBy(F.col("gap").desc_nulls_last())
    ranked = gaps.withColumn("rank", F.row_number().over(rank))
    second = ranked.where("rank = 2").select(*place, F.col("gap").alias("second"))
    counts = ranked.groupBy(*place).agg(F.count("gap").alias("gaps"))
    eased = ranked.join(second, place, "left").join(counts, place)
    eased = eased.withColumn("eased", F.when((F.col("rank") == 1) & (F.col("gaps") > CROWDED_GAPS), F.col("second")).otherwise(F.col("gap")))
    stats = eased.groupBy("src", "region").agg(F.count("eased").alias("m"), F.stddev_pop("eased").alias("sd"), F.avg("eased").alias("mean_gap"))
    limits = otsu(eased, ["src", "region"], "eased").select("src", "region", "threshold")
    both = gaps.join(stats, ["src", "region"]).join(limits, ["src", "region"])
    breaks = (F.col("gap") > F.col("threshold")) & (F.col("m") > 3) & (F.col("sd") > F.col("mean_gap") * LEAST_SPREAD)
    return gap_sessions(both, place, ["cx", "x0"], breaks, "word_number").drop("m", "sd", "mean_gap", "threshold")


def roll_up(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Boxes and counts of the next level up; width and height without the closing pixel."""
    boxes = rows.groupBy(*keys).agg(*bounding_box(), F.count("*").alias(count))
    return boxes.withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})

