"""Edges, stroke widths and separators: rays that march from edge pixels, and walks down and up through ink, as joins on generated places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.boxes import box_pairs
from loomspan.operators.pixels import components, thinned
from loomspan.session import large, materialise

LONGEST = 35
#: So many steps all rays take before those that have met an edge are left out.
FIRST_STEPS = 3


def canny(gradients: DataFrame, keys: list[str], pixel: str, low: float, high: float) -> DataFrame:
    """(keys, y, x, m) of gradients (keys, y, x, pixel id, dx, dy): thin edges above `low` that hang together with one above `high`."""
    thin = thinned(gradients.select(*keys, "y", "x", "dx", "dy"), keys).where(F.col("m") > low)
    named = thin.join(large(gradients.select(*keys, "y", "x", pixel)), [*keys, "y", "x"])
    found = materialise(components(named, keys, pixel), "edges")
    linked = found.where(F.col("m") > high).select("component").distinct()
    return found.join(large(linked), "component", "left_semi").select(*keys, "y", "x", "m")


def _along(place: str, slope: str, step: Column) -> Column:
    """Where a ray is after `step` pixels, rounded half up."""
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    unit = F.when(length == 0, F.lit(1.0 if slope == "dx" else 0.0)).otherwise(F.col(slope) / length)
    return F.floor(F.col(place) + unit * step + 0.5).cast("long")


def rays(edges: DataFrame, keys: list[str], direction: int = 1, longest: int = LONGEST) -> DataFrame:
    """(keys, y, x, dx, dy, steps, width): the edge pixels whose ray along (direction 1) or against (-1) their gradient meets an edge of opposite gradient first.

    A ray takes up to longest - 1 steps of one pixel and ends at the first edge pixel it meets; it counts if both gradients are more than a right angle apart. A pixel without a
    gradient looks to the right. Steps are generated rows that meet the edges in an equi-join on their place; a grouped minimum keeps each ray's first. The first steps go by
    themselves, and only rays that have met nothing take the next ones, twice as many each time.
    """
    place = ["y", "x"]
    ray = [*keys, *place, "dx", "dy"]
    other = edges.select(*keys, *[F.col(c).alias(f"t{c}") for c in place], F.col("dx").alias("ex"), F.col("dy").alias("ey"))
    flat = lambda dx, dy: F.when((F.col(dx) == 0) & (F.col(dy) == 0), F.lit(1.0)).otherwise(F.col(dx))
    facing = flat("dx", "dy") * flat("ex", "ey") + F.col("dy") * F.col("ey")
    open_, met, step, many = edges.select(*ray), None, 1, FIRST_STEPS
    while met is None or step < longest:
        last = min(step + many, longest) - 1
        at = open_.withColumn("step", F.explode(F.filter(F.sequence(F.lit(step), F.lit(max(step, last))), lambda s: s <= last)))
        at = at.withColumns({"ty": _along("y", "dy", direction * F.col("step")), "tx": _along("x", "dx", direction * F.col("step"))})
        hits = at.join(large(other), [*keys, "ty", "tx"]).groupBy(*ray).agg(F.min(F.struct("step", "ty", "tx", facing.alias("facing"))).alias("hit"))
        step, many = last + 1, many * 2
        if step < longest:
            hits = materialise(hits, "hits")
            open_ = materialise(open_.join(large(hits.select(*ray)), ray, "left_anti"), "open")
        met = hits if met is None else met.unionByName(hits)
    across, down = F.col("hit.tx") - F.col("x"), F.col("hit.ty") - F.col("y")
    return met.where("hit.facing < 0").select(*keys, *place, "dx", "dy", F.col("hit.step").alias("steps"), F.sqrt((across * across + down * down).cast("double")).alias("width"))


def stroke_widths(edges: DataFrame, keys: list[str], direction: int = 1, longest: int = LONGEST) -> DataFrame:
    """(keys, y, x, stroke) of the pixels on rays between edges (keys, y, x, dx, dy) of a stroke.

    A pixel has the least width of the rays through it. Then each ray offers the upper median of its pixels' widths (its start left out), and a pixel takes the least of its
    own width and of what its rays offer, which evens out corners. All medians are those of the first widths, so no order of rays matters.
    """
    found = materialise(rays(edges, keys, direction, longest), "rays")
    place = [*keys, "y", "x"]
    k = F.explode(F.sequence(F.lit(0), F.col("steps"))).alias("k")
    on = found.select(*keys, "y", "x", "dx", "dy", "width", k).withColumns({"py": _along("y", "dy", direction * F.col("k")), "px": _along("x", "dx", direction * F.col("k"))})
    first = materialise(on.groupBy(*keys, "py", "px").agg(F.min("width").alias("stroke")), "strokes")
    behind = on.where("k > 0").select(*place, "py", "px").join(large(first), [*keys, "py", "px"])
    # a ray has fewer pixels than the longest stroke
    each = behind.groupBy(*place).agg(F.sort_array(F.collect_list("stroke")).alias("s"), F.collect_set(F.struct("py", "px")).alias("pixels"))
    offered = each.withColumn("median", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1)).select(*keys, F.explode("pixels").alias("p"), "median")
    offered = offered.groupBy(*keys, F.col("p.py").alias("py"), F.col("p.px").alias("px")).agg(F.min("median").alias("median"))
    out = first.join(large(offered), [*keys, "py", "px"], "left")
    return out.select(*keys, F.col("py").alias("y"), F.col("px").alias("x"), F.least("stroke", F.coalesce("median", "stroke")).alias("stroke"))


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x0, x1): the maximal runs of pixels (keys, y, x) along each row."""
    row = Window.partitionBy(*keys, "y").orderBy("x")
    island = (F.col("x") - F.row_number().over(row)).alias("island")
    return mask.select(*keys, "y", "x", island).groupBy(*keys, "y", "island").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("island")


def _jumps(mask: DataFrame, keys: list[str], levels: int) -> list[DataFrame]:
    """For each k: (keys, way, y, x, to): where a walk that enters row y at column x stands after 2**k rows, if it gets that far. way 1 walks down, -1 up.

    In a row a walk takes its own column, else the one to the right, else the one to the left, if there is ink; else it ends.
    """
    entries = F.explode(F.array(*[F.struct((F.col("x") + d).alias("x"), F.lit(rank).alias("rank")) for rank, d in enumerate((0, -1, 1))])).alias("e")
    single = mask.select(*keys, "y", F.col("x").alias("to"), entries).groupBy(*keys, "y", F.col("e.x").alias("x")).agg(F.min_by("to", "e.rank").alias("to"))
    out = [materialise(single.select(*keys, F.explode(F.array(F.lit(1), F.lit(-1))).alias("way"), "y", "x", "to"), "jumps")]
    for k in range(1, levels):
        ahead = out[-1].select(*keys, "way", (F.col("y") - F.col("way") * (1 << (k - 1))).alias("y"), F.col("x").alias("to"), F.col("to").alias("then"))
        out.append(materialise(out[-1].join(large(ahead), [*keys, "way", "y", "to"]).select(*keys, "way", "y", "x", F.col("then").alias("to")), "jumps"))
    return out


def separators(mask: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, explored, goal): for every run of ink that ends inside a gap (keys, id, y, x0, x1, goal), how far a walk from its middle comes, down and up together.

    A gap runs from column x0 up to x1 in row y; a run that reaches column x1 or starts in column 0 is no separator's. A walk follows ink row by row for at most `goal` rows either
    way. Walks leap: tables of where 1, 2, 4, ... rows lead are joined with themselves, so rounds follow the logarithm of the goal.
    """
    most = gaps.agg(F.max("goal")).first()[0] or 0
    levels = max(1, math.floor(math.log2(max(most, 1))) + 1)
    row = [*keys, "y"]
    inner = box_pairs(gaps.withColumn("x1", F.col("x1") - 1), runs(mask, keys), row, ["x"]).where("x1_r + 1 <= x1_l AND greatest(x0_l, x0_r) > 0")
    start = F.floor((F.col("x1_r") + 1 + F.greatest("x0_l", "x0_r")) / 2).cast("long")
    walks = inner.select(*row, F.col("id_l").alias("id"), F.col("goal_l").alias("goal"), start.alias("mid"))
    walks = walks.withColumn("way", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({"at": F.col("y"), "x": F.col("mid"), "left": F.col("goal").cast("long")})
    jumps = _jumps(mask, keys, levels)
    for k in range(levels - 1, -1, -1):
        ahead = jumps[k].withColumnRenamed("y", "at")
        walks = walks.join(large(ahead), [*keys, "way", "at", "x"], "left")
        takes = F.col("to").isNotNull() & (F.col("left") >= (1 << k))
        walks = walks.withColumns({"at": F.when(takes, F.col("at") + F.col("way") * (1 << k)).otherwise(F.col("at")), "x": F.when(takes, F.col("to")).otherwise(F.col("x")), "left": F.when(takes, F.col("left") - (1 << k)).otherwise(F.col("left"))}).drop("to")
    return walks.groupBy(*row, "id", "goal", "mid").agg(F.sum(F.col("goal") - F.col("left")).alias("explored")).drop("y")
