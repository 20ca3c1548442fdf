"""Raster kernels on rows (keys, y, x, value): stencils, morphology, pooling, components, rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.graph import connected_components
from loomspan.session import large

CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def along(value: str, keys: list[str], axis: str, weights: list[float]) -> Column:
    """Weighted sum of a pixel and its two neighbours along an axis; the edge is repeated outwards."""
    line = Window.partitionBy(*keys, "x" if axis == "y" else "y").orderBy(axis)
    v = F.col(value)
    before, after = F.coalesce(F.lag(value).over(line), v), F.coalesce(F.lead(value).over(line), v)
    return weights[0] * before + weights[1] * v + weights[2] * after


def separable(pixels: DataFrame, keys: list[str], value: str, rows: list[float], columns: list[float], into: str) -> DataFrame:
    """A 3 x 3 kernel that is the product of weights along x and along y: two windows over lines of pixels, no join."""
    across = pixels.withColumn(into, along(value, keys, "x", rows))
    return across.withColumn(into, along(into, keys, "y", columns))


def sobel(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """pixels with their gradients dx and dy."""
    flat, slope = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
    return separable(separable(pixels, keys, value, slope, flat, "dx"), keys, value, flat, slope, "dy")


def shifted(mask: DataFrame, keys: list[str], offsets: list[tuple[int, int]]) -> DataFrame:
    """(keys, y, x): all places at an offset from a pixel of the mask."""
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in offsets])).alias("p")
    return mask.select(*keys, near).select(*keys, "p.y", "p.x").distinct()


def dilated(mask: DataFrame, pixels: DataFrame, keys: list[str], offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pixels (keys, y, x) on or beside the mask."""
    return shifted(mask, keys, offsets or CROSS).join(large(pixels.select(*keys, "y", "x")), [*keys, "y", "x"], "left_semi")


def eroded(mask: DataFrame, pixels: DataFrame, keys: list[str], offsets: list[tuple[int, int]] | None = None) -> DataFrame:
    """The pixels of the mask with no pixel outside it beside them; places outside the image don't count."""
    place = [*keys, "y", "x"]
    outside = pixels.select(*place).join(large(mask.select(*place)), place, "left_anti")
    return mask.select(*place).join(large(shifted(outside, keys, offsets or CROSS)), place, "left_anti")


def components(mask: DataFrame, keys: list[str], pixel: str) -> DataFrame:
    """mask (keys, y, x, pixel id, ...) with the least pixel id of its 8-connected component in column `component`.

    Neighbours are met by an equi-join on their place; no task holds an image.
    """
    ahead = [o for o in AROUND if o > (0, 0)]
    steps = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in ahead])).alias("p")
    near = mask.select(*keys, F.col(pixel).alias("a"), steps).select(*keys, "a", "p.y", "p.x")
    edges = near.join(large(mask.select(*keys, "y", "x", F.col(pixel).alias("b"))), [*keys, "y", "x"]).select("a", "b")
    found = connected_components(edges, "a", "b").select(F.col("node").alias(pixel), "component")
    return mask.join(large(found), pixel, "left").withColumn("component", F.coalesce("component", pixel))


def rings(mask: DataFrame, pixels: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(keys, y, x, ring): how many cross dilations of the mask it takes to reach a pixel, from 1 to `most`."""
    offsets = [(dy, dx) for dy in range(-most, most + 1) for dx in range(-most, most + 1) if abs(dy) + abs(dx) <= most]
    near = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(abs(dy) + abs(dx)).alias("ring")) for dy, dx in offsets])).alias("p")
    reached = mask.select(*keys, near).select(*keys, "p.*").groupBy(*keys, "y", "x").agg(F.min("ring").alias("ring")).where("ring > 0")
    return reached.join(large(pixels.select(*keys, "y", "x")), [*keys, "y", "x"], "left_semi")


def thinned(gradients: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels (keys, y, x, m) whose gradient (dx, dy) is at least as strong as the one before and stronger than the one after it along its own direction.

    Directions fall in four sectors; m is the sum of both gradients' sizes. Neighbours outside the image count 0.
    """
    m, dx, dy = F.abs("dx") + F.abs("dy"), F.col("dx"), F.col("dy")
    steep, flat = F.abs(dy) > 2.414213562373095 * F.abs(dx), F.abs(dy) < 0.4142135623730951 * F.abs(dx)
    sx = F.when(steep, 0).when(flat, 1).when(dx * dy > 0, 1).otherwise(-1)
    sy = F.when(steep, 1).when(flat, 0).otherwise(1)
    marked = gradients.withColumns({"m": m, "sx": sx, "sy": sy})
    place = [*keys, "y", "x"]

    def beside(sign: int, name: str) -> DataFrame:
        own = marked.select(*place, (F.col("y") + sign * F.col("sy")).alias("ny"), (F.col("x") + sign * F.col("sx")).alias("nx"))
        other = marked.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("m").alias(name))
        return own.join(large(other), [*keys, "ny", "nx"]).select(*place, name)

    both = marked.join(large(beside(-1, "before")), place, "left").join(large(beside(1, "after")), place, "left")
    return both.where((F.col("m") >= F.coalesce("before", F.lit(0.0))) & (F.col("m") > F.coalesce("after", F.lit(0.0)))).select(*place, "m")
