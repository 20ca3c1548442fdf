"""Which pixels near letters have the letters' colours: histograms of a region's letters against those of a ring around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions import colour

RADIUS = 4
PAD_X, PAD_Y = 30, 20
LEAST_RATIO = 3.0
CELL = 32
#: A bin and its neighbours along the three axes, as they lie in one row of 16 x 16 x 16 bins.
AROUND = (0, 1, -1, 16, -16, 256, -256)


def colour_bin(r: Column, g: Column, b: Column) -> Column:
    """The bin of a colour among 16 levels of lightness and of both opponent axes."""
    l_, a, b_ = colour.lab(r, g, b)
    level = lambda v: F.floor(v / 16 + 0.5).cast("int")
    return level(2 * l_ + 40) + 16 * level(a + 128) + 256 * level(b_ + 128)


def marked(pixels: DataFrame, contours: DataFrame, keys: list[str], radius: int = RADIUS) -> DataFrame:
    """pixels (keys, y, x, ...) that lie on a contour or within `radius` of one along both axes, with `inside`: on a contour."""
    place = [*keys, "y", "x"]
    own = contours.select(*place).distinct()
    near = own
    for axis in ("x", "y"):  # the square is a line along x, then along y
        near = near.withColumn(axis, F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))).distinct()
    flagged = near.join(own.withColumn("inside", F.lit(True)), place, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    return pixels.join(flagged, place)


def in_boxes(pixels: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each pixel and box (keys, region, x0, x1, y0, y1) that holds it; sides x1 and y1 lie outside. They meet in cells of a grid."""
    span = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / CELL), F.floor((F.col(f"{a}1") - 1) / CELL)))
    cells = boxes.where("x0 < x1 AND y0 < y1").withColumn("cell_x", span("x")).withColumn("cell_y", span("y"))
    placed = pixels.withColumns({f"cell_{a}": F.floor(F.col(a) / CELL) for a in ("x", "y")})
    return placed.join(cells, [*keys, "cell_x", "cell_y"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").drop("cell_x", "cell_y", "x0", "x1", "y0", "y1")


def prevailing_bins(coloured: DataFrame, by: list[str], axes: tuple[int, ...] = AROUND, least: float = LEAST_RATIO) -> DataFrame:
    """(by, bin, ratio): bins of coloured (by, bin, inside) that prevail inside: n / (1 + m) > least, n and m pixels inside and outside, each counting for the bins around its own too."""
    counts = coloured.groupBy(*by, "bin").agg(F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("m"))
    spread = counts.withColumn("bin", F.explode(F.array(*[F.col("bin") + d for d in axes])))
    sums = spread.groupBy(*by, "bin").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    return sums.withColumn("ratio", F.col("n") / (1 + F.col("m"))).where(F.col("ratio") > least).select(*by, "bin", "ratio")


def local_colours(pixels: DataFrame, contours: DataFrame, keys: list[str], radius: int = RADIUS, pad: tuple[int, int] = (PAD_X, PAD_Y), least: float = LEAST_RATIO) -> DataFrame:
    """(keys, y, x, region, marker) of the pixels (keys, y, x, r, g, b) near a region whose colour prevails in its letters; contours: (keys, region, y, x).

    A region is its contours' box widened by `pad`. Its pixels on contours, of any region, are counted against those around them; marker is twice the ratio, 255 at most. Where regions
    overlap, the last one that marks a pixel decides.
    """
    box = contours.groupBy(*keys, "region").agg(*[f(a).alias(f"{a}{k}") for a in "xy" for k, f in ((0, F.min), (1, F.max))])
    widened = box.select(*keys, "region", *[(F.col(f"{a}{k}") + (2 * k - 1) * p).alias(f"{a}{k}") for a, p in zip("xy", pad, strict=True) for k in (0, 1)])
    coloured = pixels.select(*keys, "y", "x", colour_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin"))
    near = in_boxes(marked(coloured, contours, keys, radius), widened, keys)
    found = prevailing_bins(near, [*keys, "region"], least=least)
    hits = in_boxes(coloured, widened, keys).join(found, [*keys, "region", "bin"])
    marker = F.floor(F.least(F.lit(255.0), 2 * F.col("ratio"))).cast("int")
    last = hits.groupBy(*keys, "y", "x").agg(F.max(F.struct("region", marker.alias("marker"))).alias("m"))
    return last.select(*keys, "y", "x", "m.region", "m.marker")
