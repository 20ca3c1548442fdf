"""Fast marching: how long a front that starts at a mask's edge takes to each of its pixels, and filling in the order of arrival.

Arrival times solve the upwind eikonal equation on the four neighbours of a pixel, which has one solution whatever the order of updates. An image is cut into tiles;
a tile marches by itself from the times on its rim, and only tiles whose rim has changed march again. A task holds one tile.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import large, materialise

TILE = 64
RADIUS = 5
#: A colour that stands for "no pixel" (fixed values).
NO_COLOUR = (250, 254, 252)
SMALL = 1e-6
SCALE = 1 << 40
FOUR = ((0, 1), (0, -1), (1, 0), (-1, 0))


def arrival(across: float, down: float) -> float:
    """The time at a pixel whose earlier neighbours along both axes were reached at these times."""
    early, late = min(across, down), max(across, down)
    return 1 + early if late - early >= 1 else (early + late + math.sqrt(2 - (late - early) ** 2)) / 2


def march(times: dict[tuple[int, int], float], free: set[tuple[int, int]]) -> None:
    """Lower the times of the free places until each follows from its neighbours; the earliest place goes first."""
    front = [(u, p) for p, u in times.items() if u < math.inf]
    heapq.heapify(front)
    at = lambda p: times.get(p, math.inf)
    while front:
        u, (y, x) = heapq.heappop(front)
        if u > times[y, x]:
            continue
        for dy, dx in FOUR:
            p = (y + dy, x + dx)
            if p in free:
                found = arrival(min(at((p[0], p[1] - 1)), at((p[0], p[1] + 1))), min(at((p[0] - 1, p[1])), at((p[0] + 1, p[1]))))
                if found < at(p):
                    times[p] = found
                    heapq.heappush(front, (found, p))


def _tile(keys: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ty, tx, tile = (v.as_py() for v in key[keys : keys + 3])
        place = list(zip(table.column("y").to_pylist(), table.column("x").to_pylist(), strict=True))
        before = [math.inf if u is None else u for u in table.column("u").to_pylist()]
        times = dict(zip(place, before, strict=True))
        own = [k for k, ((y, x), masked) in enumerate(zip(place, table.column("masked").to_pylist(), strict=True)) if masked and y // tile == ty and x // tile == tx]
        march(times, {place[k] for k in own})
        after = [times[place[k]] for k in own]
        out = table.take(pa.array(own, pa.int64())).drop_columns(["u", "masked", "ty", "tx", "tile"])
        out = out.append_column("u", pa.array([None if u == math.inf else u for u in after], pa.float64()))
        return out.append_column("changed", pa.array([a != before[k] for a, k in zip(after, own, strict=True)], pa.bool_()))

    return run


def arrivals(pixels: DataFrame, mask: DataFrame, keys: list[str], tile: int = TILE) -> DataFrame:
    """(keys, y, x, u) of the pixels of the mask (keys, y, x): the time a front of speed 1 takes from the pixels (keys, y, x) beside the mask; null where none leads to them.

    Every round costs one grouped job over the tiles that a changed rim borders on; rounds follow the number of tiles that the front crosses.
    """
    place = [*keys, "y", "x"]
    own = materialise(mask.select(*place).distinct().join(large(pixels.select(*place)), place, "left_semi"), "mask")
    beside = own.select(*keys, F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in FOUR])).alias("p")).select(*keys, "p.*").distinct()
    edge = beside.join(large(pixels.select(*place)), place, "left_semi").join(large(own), place, "left_anti")
    edge = materialise(edge.withColumns({"u": F.lit(0.0), "masked": F.lit(False)}), "edge")
    now = own.withColumns({"u": F.lit(None).cast("double"), "masked": F.lit(True)})
    near = [F.floor(F.col(a) / tile) for a in ("y", "x")]
    types = {f.name: f.dataType.simpleString() for f in own.schema}
    schema = ", ".join([*[f"{c} {types[c]}" for c in place], "u double", "changed boolean"])

    def rims(rows: DataFrame) -> DataFrame:
        """rows once for their own tile and once for each tile that they border on."""
        around = [F.struct(F.floor((F.col("y") + dy) / tile).alias("ty"), F.floor((F.col("x") + dx) / tile).alias("tx")) for dy, dx in ((0, 0), *FOUR)]
        return rows.withColumn("t", F.explode(F.array_distinct(F.array(*around)))).select(*place, "u", "masked", "t.ty", "t.tx")

    active = None
    while True:
        rows = rims(now.unionByName(edge))
        rows = rows if active is None else rows.join(large(active), [*keys, "ty", "tx"], "left_semi")
        group = [*keys, "ty", "tx", "tile"]
        fresh = rows.withColumn("tile", F.lit(tile)).groupBy(*group).applyInArrow(_tile(len(keys)), schema)
        fresh = materialise(fresh, "times")
        if active is None:
            now = fresh.select(*place, "u").withColumn("masked", F.lit(True))
        else:
            stale = now.withColumns({"ty": near[0], "tx": near[1]}).join(large(active), [*keys, "ty", "tx"], "left_anti").drop("ty", "tx")
            now = materialise(stale.unionByName(fresh.select(*place, "u").withColumn("masked", F.lit(True))), "now")
        moved = rims(fresh.where("changed").select(*place, "u").withColumn("masked", F.lit(True))).where((F.col("ty") != near[0]) | (F.col("tx") != near[1]))
        active = materialise(moved.select(*keys, "ty", "tx").distinct(), "active")
        if not active.limit(1).count():
            return now.select(*place, "u")


def _disc(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if 0 < dy * dy + dx * dx <= radius * radius]


def _slope(axis: str, target: Window) -> Column:
    """The slope of the times at a pixel, from the neighbours that were reached before it."""
    other = "x" if axis == "y" else "y"
    at = lambda step: F.max(F.when((F.col(f"d{axis}") == step) & (F.col(f"d{other}") == 0), F.col("ku"))).over(target)
    up, down = at(1), at(-1)
    return F.when(up.isNotNull() & down.isNotNull(), (up - down) * 0.5).when(up.isNotNull(), up - F.col("u")).when(down.isNotNull(), F.col("u") - down).otherwise(0.0)


def fill_layer(targets: DataFrame, known: DataFrame, keys: list[str], channels: list[str], radius: int = RADIUS, skip: tuple[int, ...] | None = NO_COLOUR) -> DataFrame:
    """targets (keys, y, x, u, channels) with new channels: weighted means of the known pixels (the same columns) within `radius`.

    A pixel weighs more the nearer it is, the more it lies along the front's way and the more alike its time. Pixels of the colour `skip` don't count; a target with no other keeps
    its channels. Weights are whole numbers of 2**-40, so sums don't depend on their order.
    """
    place = [*keys, "y", "x"]
    offsets = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _disc(radius)])).alias("o")
    asked = targets.select(*place, "u", *channels, offsets).select(*place, "u", *channels, "o.dy", "o.dx").withColumns({"ky": F.col("y") + F.col("dy"), "kx": F.col("x") + F.col("dx")})
    given = known.select(*keys, F.col("y").alias("ky"), F.col("x").alias("kx"), F.col("u").alias("ku"), *[F.col(c).alias(f"k{c}") for c in channels])
    # a window runs over the pixels of a disc
    target = [*place, "u", *channels]
    met = asked.join(large(given), [*keys, "ky", "kx"]).withColumns({f"s{axis}": _slope(axis, Window.partitionBy(*target)) for axis in ("y", "x")})
    square = (F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")).cast("double")
    way = F.abs(F.col("dx") * F.col("sx") + F.col("dy") * F.col("sy"))
    w = F.floor((way / (square * F.sqrt(square)) / (1 + F.abs(F.col("ku") - F.col("u"))) + SMALL) * SCALE)
    if skip:
        w = F.when(sum((F.when(F.col(f"k{c}") == v, 1).otherwise(0) for c, v in zip(channels, skip, strict=True)), F.lit(0)) == len(channels), F.lit(0)).otherwise(w)
    sums = [F.sum(F.col("w") * F.col(f"k{c}")).alias(f"sum_{c}") for c in channels]
    weighed = met.withColumn("w", w.cast("long")).groupBy(*target).agg(F.sum("w").alias("norm"), *sums)
    mean = lambda c: F.when(F.col("norm") > 0, F.floor(F.col(f"sum_{c}") / F.col("norm") + 0.5).cast("int")).otherwise(F.col(c)).alias(c)
    filled = weighed.select(*place, "u", *[mean(c) for c in channels])
    lonely = targets.select(*place, "u", *channels).join(large(filled.select(*place)), place, "left_anti")
    return filled.unionByName(lonely)


def inpaint(pixels: DataFrame, mask: DataFrame, keys: list[str], channels: list[str], radius: int = RADIUS, skip: tuple[int, ...] | None = NO_COLOUR, tile: int = TILE, layers: int | None = None) -> DataFrame:
    """(keys, y, x, u, layer, channels) of the mask's pixels, filled layer by layer from its edge inwards; a layer holds the times of one unit and sees those before it.

    Only pixels within `radius` of the mask take part. Pixels that no front reaches keep their channels and have no layer. With `layers` set, rows of later layers, on which those
    before don't depend, are neither filled nor given.
    """
    place = [*keys, "y", "x"]
    times = materialise(arrivals(pixels, mask, keys, tile), "arrivals")
    near = times.select(*place)
    for axis in ("x", "y"):
        near = near.withColumn(axis, F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))).distinct()
    cut = materialise(pixels.select(*place, *[F.col(c).cast("int").alias(c) for c in channels]).join(large(near), place, "left_semi"), "near")
    known = cut.join(large(times.select(*place)), place, "left_anti").withColumn("u", F.lit(0.0))
    known = materialise(known, "known")
    open_ = materialise(cut.join(large(times), place).withColumn("layer", F.ceil("u").cast("int")), "open")
    done = open_.where("layer IS NULL")
    last = open_.agg(F.max("layer")).first()[0] or 0
    for layer in range(1, (last if layers is None else min(last, layers)) + 1):
        fresh = fill_layer(open_.where(F.col("layer") == layer), known, keys, channels, radius, skip)
        fresh = materialise(fresh, "layer")
        known = known.unionByName(fresh)
        done = done.unionByName(fresh.withColumn("layer", F.lit(layer)))
    return done.select(*place, "u", "layer", *channels)
