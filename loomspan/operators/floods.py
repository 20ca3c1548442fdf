"""Components of pixels whose values belong together: by a ratio of means, contracted in rounds, and by floods from the highest pixels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.graph import connected_components
from loomspan.session import materialise

AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def neighbours(pixels: DataFrame, keys: list[str], pixel: str) -> DataFrame:
    """(a, b) of pixels (keys, y, x, pixel id) that touch along a side or a corner, each pair once."""
    steps = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in AHEAD])).alias("p")
    near = pixels.select(*keys, F.col(pixel).alias("a"), steps).select(*keys, "a", "p.y", "p.x")
    return near.join(pixels.select(*keys, "y", "x", F.col(pixel).alias("b")), [*keys, "y", "x"]).select("a", "b")


def ratio_components(pixels: DataFrame, keys: list[str], pixel: str, value: str, ratio: float) -> DataFrame:
    """(pixel, component) of pixels (keys, y, x, pixel id, value) of values above 0: neighbours are joined as long as their components' means are within `ratio` of each other.

    In a round every component that has a neighbour within the ratio joins the one whose mean is most like its own, of equal ones by the pair's ids, and all components that are joined to each other
    become one, named by its least pixel; means are those before the round. So the outcome depends on no order of rows, and at least half of the components that can join
    are gone after each round. Components carry their sum, as decimals of six places, and their size; only pairs of components are kept, and contracted.
    """
    live = materialise(pixels.where(F.col(value) > 0).select(*keys, "y", "x", F.col(pixel).cast("long").alias("p"), F.col(value).cast("decimal(20,6)").alias("v")), "pixels")
    pairs = materialise(neighbours(live, keys, "p").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "pairs")
    parts = live.select(F.col("p").alias("c"), F.col("v").alias("s"), F.lit(1).cast("long").alias("n"))
    placed = live.select("p", F.col("p").alias("c"))
    while True:
        means = parts.select("c", (F.col("s").cast("double") / F.col("n")).alias("mean"))
        side = lambda k: means.select(F.col("c").alias(k), F.col("mean").alias(f"mean_{k}"))
        like = F.greatest("mean_a", "mean_b") / F.least("mean_a", "mean_b")
        able = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", like.alias("like")).where(F.col("like") <= ratio)
        both = able.select(F.explode(F.array("a", "b")).alias("c"), F.struct("like", "a", "b").alias("pair"))
        chosen = materialise(both.groupBy("c").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct(), "chosen")
        if not chosen.limit(1).count():
            return placed.withColumnsRenamed({"p": pixel, "c": "component"})
        joined = materialise(connected_components(chosen, "a", "b").withColumnsRenamed({"node": "c", "component": "into"}), "joined")
        into = F.coalesce("into", "c")
        parts = materialise(parts.join(joined, "c", "left").groupBy(into.alias("c")).agg(F.sum("s").cast("decimal(38,6)").alias("s"), F.sum("n").alias("n")), "parts")
        placed = materialise(placed.join(joined, "c", "left").select("p", into.alias("c")), "placed")
        for end in ("a", "b"):
            moved = joined.select(F.col("c").alias(end), "into")
            pairs = pairs.join(moved, end, "left").withColumn(end, F.coalesce("into", end)).drop("into")
        pairs = materialise(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")


def _flooded(y: np.ndarray, x: np.ndarray, v: np.ndarray, name: np.ndarray, power: float) -> np.ndarray:
    """The component of each pixel, named by its least pixel: pairs join from the highest down, while the lower pixel's power stays above both tops."""
    width = int(x.max() - x.min()) + 3 if len(x) else 1
    code = (y - y.min()) * width + (x - x.min()) if len(x) else y
    order = np.argsort(code, kind="stable")
    code, v, name = code[order], v[order], name[order]
    a, b = [], []
    for dy, dx in AHEAD:
        at = np.searchsorted(code, code + dy * width + dx)
        hit = np.flatnonzero(code[np.minimum(at, len(code) - 1)] == code + dy * width + dx) if len(code) else at
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    low = np.minimum(v[a], v[b])
    down = np.argsort(-low, kind="stable")
    root, top = list(range(len(v))), v.tolist()

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j, reach in zip(a[down].tolist(), b[down].tolist(), (low[down] ** power).tolist(), strict=True):
        i, j = find(i), find(j)
        if i != j and reach > top[i] and reach > top[j]:
            if name[j] < name[i]:
                i, j = j, i
            root[j] = i
            top[i] = max(top[i], top[j])
    out = np.empty(len(v), dtype=np.int64)
    out[order] = [name[find(k)] for k in range(len(v))]
    return out


def priority_components(pixels: DataFrame, keys: list[str], pixel: str, value: str, power: float = 1.5) -> DataFrame:
    """(keys, pixel, component) of pixels (keys, y, x, pixel id, value) of values above 0: floods from the highest pixel left, over pixels whose value to the `power` exceeds the flood's highest.

    The same components come from joining neighbours from the highest pair down while both sides' tops stay below the lower pixel's power: a component with a higher top can never join again, and
    the others may join at a level in any order, as none of them rises above that. That is one sorted pass for each image, whose pixels bound its group.
    """
    named = {f.name: f.dataType.simpleString() for f in pixels.schema}

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_numpy()
        found = _flooded(column("y"), column("x"), column("v"), column("p"), power)
        return pa.Table.from_arrays([*[table.column(k) for k in keys], table.column("p"), pa.array(found, pa.int64())], [*keys, pixel, "component"])

    schema = ", ".join([*[f"{k} {named[k]}" for k in keys], f"{pixel} long", "component long"])
    rows = pixels.where(F.col(value) > 0).select(*keys, F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(pixel).cast("long").alias("p"), F.col(value).cast("double").alias("v"))
    return rows.groupBy(*keys).applyInArrow(run, schema)
