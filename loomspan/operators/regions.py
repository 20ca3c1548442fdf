"""Lines to regions: merges, paragraph adjacency, votes, continuations, splits and stitching of overlapping chunks."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.boxes import near_pairs, ratio, relative_gap, shared
from loomspan.operators.graph import connected_components
from loomspan.operators.sequences import gap_sessions
from loomspan.operators.stats import otsu
from loomspan.session import discard, materialise

#: Fixed values of the layout rules.
THICKNESS_RATIO, HEIGHT_RATIO, LETTER_SIZE = 3.0, 2.5, 0.4
LEAST_SPACING, MOST_SPACING, MISALIGNED, COLUMN_BREAK = 0.1, 1.7, 0.1, 0.3
CHUNK, CHUNK_OVERLAP = 250, 90


def letter_pairs(letters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, left, right, dist) of letters that may stand in one line; the left one ends first, equal ends by id. A letter reaches as far as twice its smaller side."""
    pairs = near_pairs(letters, keys, reach=[2 * F.least("width", "height"), 5.0], order=("x1", "id"))
    c = F.col
    inside = ((c("x0_l") < c("x0_r")) & (c("x1_l") > c("x1_r"))) | ((c("x0_r") < c("x0_l")) & (c("x1_r") > c("x1_l")))
    w, h = F.greatest(F.lit(0.0), -shared("x")), F.greatest(F.lit(0.0), -shared("y"))
    widest = F.greatest(F.least("height_l", "width_l"), F.least("height_r", "width_r"))
    dy, dx = c("cy_r") - c("cy_l"), c("cx_r") - c("cx_l")
    fits = (ratio("thickness") <= THICKNESS_RATIO) & (ratio("height") <= HEIGHT_RATIO) & (ratio("width") <= 10) & ~inside & (w <= 2 * widest) & (h <= 10)
    fits &= (dx != 0) & (F.abs(dy) <= F.abs(dx))
    return pairs.where(fits).select(*keys, c("id_l").alias("left"), c("id_r").alias("right"), F.sqrt(20 * F.pow(dy + h, 2) + F.pow(dx + w, 2)).alias("dist"))


def grouped(items: DataFrame, edges: DataFrame, group: str) -> DataFrame:
    """items (id, ...) with the least id that edges (a, b) reach in column `group`; an item without edges is its own."""
    found = connected_components(edges, "a", "b").select(F.col("node").alias("id"), F.col("component").alias(group))
    return items.join(found, "id", "left").withColumn(group, F.coalesce(group, "id"))


def merge_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of lines that continue each other horizontally."""
    pairs = near_pairs(lines, keys, reach=[0.2 * F.col("width"), 0.0])
    gap = -shared("x")
    fits = (shared("y") > 0) & (shared("y") >= 0.8 * F.least("height_l", "height_r")) & (gap >= 0) & (gap <= 0.2 * F.greatest("width_l", "width_r"))
    fits &= (gap <= 3 * F.greatest("height_l", "height_r")) & (F.abs("angle_l") <= 0.2) & (F.abs("angle_r") <= 0.2) & (ratio("height") <= 1.4)
    return pairs.where(fits).select(F.col("id_l").alias("a"), F.col("id_r").alias("b"))


def paragraph_edges(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b) of lines of one paragraph: near, aligned and alike."""
    pairs = near_pairs(lines, keys, reach=[0.0, MOST_SPACING / 2 * F.col("height")])
    c, spacing = F.col, (F.col("height_l") + F.col("height_r")) / 2
    offset = F.least(F.abs(c("x0_l") - c("x0_r")), F.abs(c("x1_l") - c("x1_r")), F.abs(c("cx_l") - c("cx_r")))
    fits = (ratio("thickness") <= THICKNESS_RATIO) & (ratio("height") <= 2) & (shared("x") > 0)
    fits &= (shared("y") < LEAST_SPACING * spacing) & (-shared("y") < MOST_SPACING * spacing) & (ratio("avgheight") < 1.7)
    fits &= (offset < MISALIGNED * F.greatest("width_l", "width_r")) & (F.abs(c("angle_l") - c("angle_r")) < 0.1) & (c("lettercount_l") > 2) & (c("lettercount_r") > 2)
    fits &= (relative_gap("lettersize") < LETTER_SIZE) & (relative_gap("xheight") < LETTER_SIZE) & (c("direction_l") == c("direction_r"))
    return pairs.where(fits).select(c("id_l").alias("a"), c("id_r").alias("b"))


def wrap(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Regions of lines: box, means, summed letters, weighted angle (0 where few letters leave it unsure) and the first line's direction.

    Angles are summed as decimals of nine places, so that the order of the lines changes no bit of the result.
    """
    count = F.sum("lettercount")
    angle = F.sum(F.col("angle").cast("decimal(18,9)") * F.col("lettercount").cast("decimal(18,0)")).cast("double") / count
    boxes = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    means = [F.avg(c).alias(c) for c in ("lineheight", "xheight", "thickness", "lettersize")]
    out = lines.groupBy(*keys).agg(*boxes, *means, count.alias("lettercount"), angle.alias("angle"), F.count("*").alias("lines"), F.min_by("direction", "id").alias("direction"))
    return out.withColumn("angle", F.when((F.col("lettercount") < 5) & (F.col("angle") < 0.1), F.lit(0.0)).otherwise(F.col("angle")))


def letter_scores(letters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score): over clusters of touching letters, the upper median stroke times the root of the largest width, summed.

    A stroke is no wider than the letter's pixels allow. Letters have ids of their own. One pass in the order of x0 finds runs whose letters hang together along x; where all letters of
    a run share rows it is a cluster, and one row of it goes on. Only letters of other runs are met in pairs.
    """
    stroke = F.least(F.col("thickness"), F.col("size") / F.least("width", "height")).alias("stroke")
    sound = F.coalesce((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")), F.lit(False))
    for k in keys:
        sound &= F.col(k).isNotNull()
    rows = letters.select(*keys, "id", "x0", "x1", "y0", "y1", "width", stroke, sound.alias("sound"))
    order = Window.partitionBy(*keys, "sound").orderBy("x0", "id")
    reached = F.max("x1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("fresh", F.when(reached - F.col("x0") > -2, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "sound", "run")
    rows = rows.withColumns({"even": F.col("sound") & (F.min("y1").over(run) - F.max("y0").over(run) > -2), "w": F.max("width").over(run), "n": F.count("stroke").over(run)})
    rows = rows.withColumn("k", F.row_number().over(run.orderBy(F.col("stroke").asc_nulls_last(), "id"))).where("NOT even OR k = n DIV 2 + 1")
    rows = materialise(rows.select(*keys, "id", "x0", "x1", "y0", "y1", "width", "stroke", "even", "w"), "runs")
    even = rows.where("even").select(*keys, F.col("stroke").alias("median"), "w")

    rest = rows.where("NOT even").drop("even", "w")
    pairs = near_pairs(rest, keys, reach=[1.0, 1.0]).where((shared("x") > -2) & (shared("y") > -2))
    clusters = grouped(rest, pairs.select(F.col("id_l").alias("a"), F.col("id_r").alias("b")), "cluster")
    # a cluster is a run of letters that touch, so its strokes fit one row
    each = clusters.groupBy(*keys, "cluster").agg(F.sort_array(F.collect_list("stroke")).alias("s"), F.max("width").alias("w"))
    each = each.select(*keys, F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("median"), "w")
    return even.unionByName(each).groupBy(*keys).agg(F.sum(F.col("median") * F.sqrt("w")).alias("score"))


def direction_votes(lines: DataFrame, scores: DataFrame, group: str) -> DataFrame:
    """(group, vote): the direction of most weight among a group's lines; lines without a score don't vote."""
    voted = lines.join(scores.withColumnRenamed("line", "id"), "id").groupBy(group)
    share = F.try_divide(F.sum(F.col("direction") * F.col("score")), F.sum("score")) - 0.001
    return voted.agg(F.signum(share).cast("int").alias("vote"))


def spacing_deviation(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mad): mean absolute deviation of line spacings about their upper median."""
    order = Window.partitionBy(*keys).orderBy("cy", "id")
    gaps = rows.withColumn("gap", F.when(F.lead("cy").over(order).isNotNull(), F.greatest(F.lit(0.0), F.lead("cy").over(order) - F.col("cy")))).where("gap IS NOT NULL")
    # the lines of two regions: an array of some dozens
    sorted_ = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list("gap")).alias("g")).withColumn("m", F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1))
    return sorted_.select(*keys, F.aggregate("g", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("m")), lambda s: s / F.size("g")).alias("mad"))


def continuation_edges(regions: DataFrame, lines: DataFrame, keys: list[str], region: str) -> DataFrame:
    """(a, b) of regions above each other whose lines have one spacing. lines: (id, region, cy)."""
    boxes = regions.withColumnRenamed(region, "id").withColumns({"width": F.col("x1") - F.col("x0"), "height": F.col("y1") - F.col("y0")})
    pairs = near_pairs(boxes, keys, reach=[0.0, 2 * F.col("lineheight")])
    c = F.col
    fits = (c("direction_l") == c("direction_r")) & (relative_gap("lettersize") < LETTER_SIZE) & (c("lines_l") + c("lines_r") > 2)
    fits &= (shared("x") >= 0.9 * F.least("width_l", "width_r")) & (shared("y") < 0) & (-shared("y") < 2 * F.greatest("lineheight_l", "lineheight_r")) & (ratio("lineheight") < 1.5)
    near = materialise(pairs.where(fits).select(c("id_l").alias("a"), c("id_r").alias("b")), "near-regions")
    both = near.select("a", "b", F.explode(F.array("a", "b")).alias(region)).join(lines.select(region, "id", "cy"), region)
    return spacing_deviation(both, ["a", "b"]).where("mad < 2").select("a", "b")


def split_at_gaps(lines: DataFrame, keys: list[str], spread: float = COLUMN_BREAK) -> DataFrame:
    """lines with their `part` of a region, counted from the top: a new one starts after a gap above the region's Otsu threshold.

    Regions of three lines or fewer, or whose gaps vary little, have one part.
    """
    order = Window.partitionBy(*keys).orderBy("cy", "id")
    above = F.when(F.lag("y1").over(order).isNotNull(), F.greatest(F.lit(0.0), F.col("y0") - F.lag("y1").over(order)))
    gaps = lines.withColumn("gap", above)
    stats = gaps.groupBy(*keys).agg(F.count("*").alias("m"), F.stddev_pop("gap").alias("sd"), F.avg("gap").alias("mean_gap"))
    both = gaps.join(stats, keys).join(otsu(gaps, keys, "gap").select(*keys, "threshold"), keys, "left")
    breaks = (F.col("gap") > F.col("threshold")) & (F.col("m") > 3) & (F.col("sd") > F.col("mean_gap") * spread)
    return gap_sessions(both, keys, ["cy", "id"], breaks, "part").drop("m", "sd", "mean_gap", "threshold")


def greedy_subset(items: DataFrame, edges: DataFrame, weight: str) -> DataFrame:
    """The items (id, ...) that a greedy choice by falling weight keeps, when of two items with an edge (a, b) only one may stay.

    In rounds on the cluster: an item without an open neighbour before it is kept, and its neighbours go. The outcome is that of
    taking one item after the other; rounds follow the longest chain of falling weights. Equal weights go by id.
    """
    rank = F.struct(F.col(weight).alias("w"), (-F.col("id")).alias("i"))
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    ranked = items.select("id", rank.alias("rank"))
    open_ = materialise(both.join(ranked.withColumnsRenamed({"id": "a", "rank": "ra"}), "a").join(ranked.withColumnsRenamed({"id": "b", "rank": "rb"}), "b").where("ra > rb").select("a", "b"), "edges")
    gone = None
    while open_.limit(1).count():
        # a stands before b; an item that no open edge ends at is kept
        kept = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        lost = materialise(open_.join(kept, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "lost")
        gone = lost if gone is None else gone.union(lost)
        rest = open_.join(lost.withColumnRenamed("id", "b"), "b", "left_anti").join(lost.withColumnRenamed("id", "a"), "a", "left_anti")
        open_ = materialise(rest.select("a", "b"), "edges")
    return items if gone is None else items.join(gone, "id", "left_anti")


def stitch_image(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (id, chunk, x0, y0, x1, y1, direction, lettercount) of one image, with the `fate` of each line: valid or orphan.

    Chunk by chunk, lines that meet a line left over from the chunk before form a group; of the two sides of a group one stays. Near
    a chunk's edge that is the side further away from it, elsewhere the one with the longest line; on a tie the side that came first.
    """
    left: list[dict] = []
    fate: dict[int, str] = {}
    for _, now in rows.sort_values(["chunk", "id"]).groupby("chunk", sort=True):
        chunk = now.to_dict("records")
        before = [x for x in left if x["chunk"] == chunk[0]["chunk"] - 1]
        for x in left:
            if x not in before:
                fate[x["id"]] = "valid"
        left = []
        label = _linked_sides(chunk, before)
        for name in sorted(set(label.values())):
            cur, old = ([x for x in side if label[x["id"]] == name] for side in (chunk, before))
            if not cur or not old:
                fate.update({x["id"]: "valid" for x in old})
                left += cur
                continue
            edge, count = [min(map(_margin, side)) for side in (cur, old)], [max(x["lettercount"] for x in side) for side in (cur, old)]
            at_edge = min(edge) < CHUNK / 4 and (count[0] - count[1]) / (count[0] + count[1]) < 0.5
            a, b = edge if at_edge else count
            fate.update({x["id"]: "valid" if a > b else "orphan" for x in cur} | {x["id"]: "orphan" if a > b else "valid" for x in old})
    fate.update({x["id"]: "valid" for x in left})
    return rows.assign(fate=rows["id"].map(fate))


def _margin(line: dict) -> float:
    """How far a line is from the nearer edge of its chunk."""
    top = line["chunk"] * (CHUNK - CHUNK_OVERLAP)
    return min(max(0, line["y0"] - top), max(0, top + CHUNK - line["y1"]))


def _meets(a: dict, b: dict) -> bool:
    share = lambda axis: min(a[f"{axis}1"], b[f"{axis}1"]) - max(a[f"{axis}0"], b[f"{axis}0"])
    size = lambda axis: 0.7 * min(x[f"{axis}1"] - x[f"{axis}0"] + 1 for x in (a, b))
    return a["direction"] == b["direction"] and share("x") > size("x") and share("y") > size("y")


def _linked_sides(cur: list[dict], old: list[dict]) -> dict[int, int]:
    label = {x["id"]: x["id"] for x in cur + old}
    pairs = [(a["id"], b["id"]) for a in cur for b in old if _meets(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def stitched(lines: DataFrame, image: str) -> DataFrame:
    """lines with column `fate`. An image is one group: its lines are bounded by its pixels, and survivors of a chunk decide the next."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.schema)
    return lines.groupBy(image).applyInPandas(stitch_image, f"{fields}, fate string")



def overlap_edges(regions: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(a, b) of regions (id, x0, y0, x1, y1) that overlap by more than `share` of the smaller one."""
    area = lambda s: (F.col(f"x1{s}") - F.col(f"x0{s}")) * (F.col(f"y1{s}") - F.col(f"y0{s}"))
    w, h = shared("x"), shared("y")
    pairs = near_pairs(regions, keys).where((w > 0) & (h > 0) & (w * h > share * F.least(area("_l"), area("_r"))))
    return pairs.select(F.col("id_l").alias("a"), F.col("id_r").alias("b"))


def build_regions(lines: DataFrame, letters: DataFrame, key: str) -> DataFrame:
    """The lines that stay, with their `region`, named by its least line id.

    lines (key, id, ...) become paragraphs by adjacency; overlapping paragraphs vote on one direction and those of the other
    go; paragraphs that continue each other with even spacing are joined, columns are split at large gaps, and of regions that still
    overlap a greedy choice by letters stays. Tilted ones are joined instead. letters: (id, line, box, thickness, size).
    """
    boxes = lambda placed: wrap(placed, ["region", key])
    ids = lambda regions: regions.withColumnRenamed("region", "id")
    placed = materialise(grouped(lines, paragraph_edges(lines, [key]), "region"), "placed")

    found = materialise(ids(boxes(placed)), "regions")
    groups = grouped(found, overlap_edges(found, [key], 0.2), "group").select(F.col("id").alias("region"), "group", F.col("direction").alias("own"))
    votes = direction_votes(placed.join(groups, "region"), letter_scores(letters, ["line"]), "group")
    right = groups.join(votes, "group", "left").where("vote IS NULL OR vote = own").select("region")
    before, placed = placed, materialise(placed.join(right, "region", "left_semi"), "placed")
    discard(before)

    found = materialise(boxes(placed), "regions")
    groups = grouped(ids(found).select("id"), continuation_edges(found, placed, [key], "region"), "group").withColumnRenamed("id", "region")
    joined = materialise(placed.join(groups, "region"), "placed")
    discard(placed)
    even = spacing_deviation(joined, ["group"]).where("mad < 2").select("group", F.lit(True).alias("even"))
    placed = joined.join(even, "group", "left").withColumn("region", F.when(F.col("even"), F.col("group")).otherwise(F.col("region"))).drop("group", "even")

    parts = split_at_gaps(placed, ["region"]).drop("gap")
    first = F.min("id").over(Window.partitionBy("region", "part"))
    placed = materialise(parts.withColumn("first", first).drop("region", "part").withColumnRenamed("first", "region"), "placed")
    discard(joined)

    found = materialise(ids(boxes(placed)), "regions")
    edges = materialise(overlap_edges(found, [key], COLUMN_BREAK), "overlaps")
    groups = grouped(found.select("id", "angle", "lettercount"), edges, "group")
    tilted = groups.groupBy("group").agg(F.avg("angle").alias("mean"), F.count("*").alias("n")).where("abs(mean) > 0.1 AND n > 1").select("group")
    flat = groups.join(tilted, "group", "left_anti")
    kept = greedy_subset(flat, overlap_edges(found, [key], 0.2).join(flat.select(F.col("id").alias("a")), "a", "left_semi"), "lettercount").select("id", F.col("id").alias("name"))
    kept = kept.union(groups.join(tilted, "group", "left_semi").select("id", "group"))
    return placed.join(kept.withColumnRenamed("id", "region"), "region").drop("region").withColumnRenamed("name", "region")


def _slope(letters: list[dict]) -> float:
    """Upper median of the slopes between all pairs of letters, as an angle; pairs above each other don't count."""
    slopes = sorted((a["cy"] - b["cy"]) / (a["cx"] - b["cx"]) for k, a in enumerate(letters) for b in letters[:k] if a["cx"] != b["cx"])
    return math.atan(slopes[len(slopes) // 2]) if slopes else 0.0


def _bends(letters: list[dict], slack: float = 2.0) -> bool:
    """Does the vertical gap from letter to letter change along the line?"""
    gaps = [max(slack, max(a["y0"], b["y0"]) - min(a["y1"], b["y1"])) for a, b in zip(letters, letters[1:], strict=False)]
    return any(a != b for a, b in zip(gaps, gaps[1:], strict=False))


def _may_join(a: list[dict], b: list[dict], both: list[dict]) -> bool:
    if abs(_slope(both)) > 0.1 + abs(_slope(a)) + abs(_slope(b)) or _bends(both):
        return False
    (ax0, ay0, ax1, ay1), (bx0, by0, bx1, by1) = ((min(x["x0"] for x in s), min(x["y0"] for x in s), max(x["x1"] for x in s), max(x["y1"] for x in s)) for s in (a, b))
    w, h = min(ax1, bx1) - max(ax0, bx0), min(ay1, by1) - max(ay0, by0)
    if w > 0 and h > 0 and w * h > 0.3 * min((ax1 - ax0) * (ay1 - ay0), (bx1 - bx0) * (by1 - by0)):
        return False
    tall = sorted(max(x["height"] for x in s) for s in (a, b))
    return tall[1] <= (1.5 + 10 / max(len(a), len(b))) * tall[0]


def join_letters(letters: pd.DataFrame, pairs: pd.DataFrame) -> dict[int, int]:
    """The line of each letter id, named by its least letter: pairs are taken by distance, and join two lines if the outcome is straight and even."""
    line = {r["id"]: r["id"] for r in letters.to_dict("records")}
    members = {r["id"]: [r] for r in letters.to_dict("records")}
    for left, right in pairs.sort_values(["dist", "left", "right"])[["left", "right"]].itertuples(index=False):
        a, b = line[left], line[right]
        if a == b:
            continue
        both = sorted(members[a] + members[b], key=lambda x: (x["x1"], x["id"]))
        if len(both) > 2 and not _may_join(members[a], members[b], both):
            continue
        name, gone = min(a, b), max(a, b)
        del members[gone]
        members[name] = both
        line.update({x["id"]: name for x in both})
    return line


def built_lines(letters: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """(key, id, line) of letters (key, id, x0, y0, x1, y1, cx, cy, height), from pairs (key, left, right, dist).

    The order of the merges decides, so a chunk of an image is one group; its letters are bounded by its pixels.
    """

    def run(mine: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        return mine[[key, "id"]].assign(line=mine["id"].map(join_letters(mine, near)))

    columns = letters.select(F.col(key).cast("long").alias(key), "id", "x0", "y0", "x1", "y1", "cx", "cy", "height")
    near = pairs.select(F.col(key).cast("long").alias(key), "left", "right", "dist")
    return columns.groupBy(key).cogroup(near.groupBy(key)).applyInPandas(run, f"{key} long, id long, line long")
