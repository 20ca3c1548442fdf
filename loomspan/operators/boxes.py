"""Joins of boxes and intervals on grids whose cells grow with the boxes, and column helpers for pairs of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import large

#: Sides of the smallest grid cells are 2**LEAST_LEVEL.
LEAST_LEVEL = -4


def shared(axis: str, a: str = "_l", b: str = "_r") -> Column:
    """Length that two boxes share along an axis; negative: their gap."""
    return F.least(f"{axis}1{a}", f"{axis}1{b}") - F.greatest(f"{axis}0{a}", f"{axis}0{b}")


def ratio(name: str, a: str = "_l", b: str = "_r") -> Column:
    """The larger of two values over the smaller; null where that is 0."""
    return F.try_divide(F.greatest(name + a, name + b), F.least(name + a, name + b))


def relative_gap(name: str, a: str = "_l", b: str = "_r") -> Column:
    """Difference of two values over the smaller one."""
    return F.try_divide(F.abs(F.col(name + a) - F.col(name + b)), F.least(name + a, name + b))


def _placed(df: DataFrame, axes: list[str], reach: list[float]) -> DataFrame:
    """df with the level of its box, widened by reach: its sides are no longer than a cell's."""
    sides = [F.col(f"{a}1") - F.col(f"{a}0") + F.lit(2.0 * r) for a, r in zip(axes, reach, strict=True)]
    widest = F.greatest(*sides, F.lit(2.0**LEAST_LEVEL)) if len(sides) > 1 else F.greatest(sides[0], F.lit(2.0**LEAST_LEVEL))
    return df.withColumn("level", F.ceil(F.log2(widest)).cast("int"))


def _in_cells(df: DataFrame, axes: list[str], reach: list[float], level: Column) -> DataFrame:
    """A row for each cell of the level's grid that a widened box touches: at most two along each axis."""
    out = df.withColumn("grid", level)
    for a, r in zip(axes, reach, strict=True):
        cell = lambda x: F.floor(x / F.pow(F.lit(2.0), F.col("grid")))
        out = out.withColumn(f"cell_{a}", F.explode(F.sequence(cell(F.col(f"{a}0") - F.lit(r)), cell(F.col(f"{a}1") + F.lit(r)))))
    return out


def box_pairs(left: DataFrame, right: DataFrame, keys: list[str], axes: list[str] | None = None, reach: list[float] | None = None, suffixes: tuple[str, str] = ("_l", "_r")) -> DataFrame:
    """Pairs of boxes (x0, x1, y0, y1, or other axes) with equal keys that touch or lie within `reach` along every axis, each once.

    Other columns get the sides' suffixes. A box lies on the grid whose cells are just as large as it; the smaller box of a pair is
    looked for on the grid of the larger one, so a box takes few cells however long it is. A pair is kept in the one cell
    that holds the lower corner of what both cover. Boxes with null or inverted sides match nothing. Self-joins give both orders of a pair
    and each box with itself: compare ids to choose.
    """
    axes = axes or ["x", "y"]
    reach = reach or [0.0] * len(axes)
    none = [0.0] * len(axes)
    a, b = suffixes
    sound = " AND ".join(f"{x}0 <= {x}1" for x in axes)
    left, right = _placed(left.where(sound), axes, reach), _placed(right.where(sound), axes, none)
    levels = [sorted(r[0] for r in df.select("level").distinct().collect()) for df in (left, right)]  # a few dozen powers of two
    above = lambda known, strictly: F.filter(F.array(*[F.lit(x) for x in known]).cast("array<int>"), lambda x: (x > F.col("level")) if strictly else (x >= F.col("level")))

    def sides(known_left: bool) -> DataFrame:
        """Pairs whose right box is at least as large as the left one, or whose left box is larger."""
        if known_left:
            l_, r_ = _in_cells(left.withColumn("up", F.explode(above(levels[1], False))), axes, reach, F.col("up")).drop("up"), _in_cells(right, axes, none, F.col("level"))
        else:
            l_, r_ = _in_cells(left, axes, reach, F.col("level")), _in_cells(right.withColumn("up", F.explode(above(levels[0], True))), axes, none, F.col("up")).drop("up")
        on = [*keys, "grid", *[f"cell_{x}" for x in axes]]
        named = lambda df, s: df.drop("level").withColumnsRenamed({c: c + s for c in df.columns if c not in on})
        pairs = named(l_, a).join(large(named(r_, b)), on)
        for x, r in zip(axes, reach, strict=True):
            low, high = F.greatest(F.col(f"{x}0{a}") - F.lit(r), F.col(f"{x}0{b}")), F.least(F.col(f"{x}1{a}") + F.lit(r), F.col(f"{x}1{b}"))
            pairs = pairs.where((low <= high) & (F.floor(low / F.pow(F.lit(2.0), F.col("grid"))) == F.col(f"cell_{x}")))
        return pairs.drop("grid", *[f"cell_{x}" for x in axes])

    return sides(True).unionByName(sides(False))


def near_pairs(items: DataFrame, keys: list[str], axes: list[str] | None = None, reach: list[Column | float] | None = None, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """Pairs of boxes of one table with equal keys that touch when each is widened by its own `reach` along every axis, each once.

    All other columns get the suffixes _l and _r; `order` tells which box of a pair is the left one, and a box is no pair with itself or with one of the same place in that order. A box is as
    large as its own reach makes it, so one far-reaching box costs its own pairs and no other's; the smaller box of a pair looks for the larger one on the grid of that, never the other way
    round. Boxes with null or inverted sides match nothing.
    """
    axes = axes or ["x", "y"]
    own = [F.coalesce(r, F.lit(0.0)) if isinstance(r, Column) else F.lit(float(r)) for r in reach or [0.0] * len(axes)]
    rest = [c for c in items.columns if c not in keys]
    sound = items.where(" AND ".join(f"{a}0 <= {a}1" for a in axes))
    wide = sound.select(*keys, F.struct(*rest).alias("row"), *[(F.col(f"{a}{k}") + (2 * k - 1) * r).alias(f"{a}{k}") for a, r in zip(axes, own, strict=True) for k in (0, 1)])
    placed = _placed(wide, axes, [0.0] * len(axes))
    levels = sorted(r[0] for r in placed.select("level").distinct().collect())  # a few dozen powers of two
    up = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("level"))
    none = [0.0] * len(axes)
    on = [*keys, "grid", *[f"cell_{a}" for a in axes]]
    named = lambda df, s: df.withColumnsRenamed({c: c + s for c in df.columns if c not in on})
    small = named(_in_cells(placed.withColumn("up", F.explode(up)), axes, none, F.col("up")).drop("up"), "_s")
    big = named(_in_cells(placed, axes, none, F.col("level")), "_b")
    place = lambda s: F.struct(*[F.col(f"row{s}")[c] for c in order])
    pairs = small.join(large(big), on).where((place("_s") < place("_b")) | (F.col("level_s") < F.col("level_b")) & (place("_s") > place("_b")))
    for a in axes:
        low, high = F.greatest(f"{a}0_s", f"{a}0_b"), F.least(f"{a}1_s", f"{a}1_b")
        pairs = pairs.where((low <= high) & (F.floor(low / F.pow(F.lit(2.0), F.col("grid"))) == F.col(f"cell_{a}")))
    first = place("_s") < place("_b")
    sides = pairs.select(*keys, F.when(first, F.col("row_s")).otherwise(F.col("row_b")).alias("l"), F.when(first, F.col("row_b")).otherwise(F.col("row_s")).alias("r"))
    return sides.select(*keys, *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "lr" for c in rest])
