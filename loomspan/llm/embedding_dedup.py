"""Embedding near-dedup: all pairs at or above a cosine, by dual traversal of a cover tree.

Unit vectors lie at chord distance sqrt(2 - 2 cos). A cover tree with nested levels of halving radii is built on a
bounded sample (SAMPLE_ROWS, at most MAX_CELLS leaves; it only decides where vectors go, never which are compared). The children of a
node are balls of half its radius around points further apart than that, the node's own center first. Balls that would hold
few vectors are not made: their points stay in the node's self-child, a leaf with the node's own ball, so that dense regions
are split even where the rest is scattered. Every vector descends to its leaf, and one grouped pass gives each leaf its true
covering radius and count.

The traversal visits pairs of nodes from the root down. By the triangle inequality a pair whose covering balls
stay further apart than the threshold is dropped with all its descendants, and a pair whose balls
lie within it is linked as a whole, without a comparison. Pairs of leaves in between are compared vector by
vector, in blocks of at most about BLOCK_BYTES on either side; every pair of blocks is one unit of work that returns only counts and a
spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from loomspan.operators.graph import connected_components
from loomspan.session import arrow_batches, materialise, scratch, small_arrow_batches

COSINE = 0.95
SAMPLE_ROWS = 16_384
SAMPLE_BYTES = 1 << 26
MAX_CELLS = 1024
CELL_ROWS = 4096
TRIES = 512
BLOCK_BYTES = 1 << 22
LEVELS = 12
TILE = 512
SLACK = 1e-9


@dataclass
class Node:
    """A ball of the tree. level k has nominal radius 2 / 2**k; radius and count are those of all vectors, once measured."""

    center: np.ndarray
    level: int
    children: list[int] = field(default_factory=list)
    cell: int = -1
    radius: float = 0.0
    count: int = 0


def _cosine_at(level: int) -> float:
    """The cosine of two unit vectors as far apart as the radius of a level."""
    return 1 - (2.0 / 2**level) ** 2 / 2


class CoverTree:
    def __init__(self, sample: np.ndarray, total: int, cell_rows: int = CELL_ROWS):
        """Split the most populous leaf first, while it stands for more than cell_rows of all `total` vectors."""
        scale = total / max(1, len(sample))
        self.nodes = [Node(sample[0], 0)]
        held = {0: np.arange(len(sample))}
        leaves = 1
        while held:
            k = max(held, key=lambda i: len(held[i]))
            rows, node = held.pop(k), self.nodes[k]
            if len(rows) * scale <= cell_rows:
                break
            if node.level + 1 >= LEVELS:
                continue
            balls = self._net(sample, rows, node, max(2, math.ceil(cell_rows / 4 / scale)))
            if not balls or leaves + len(balls) > MAX_CELLS:
                continue
            for center, mine in balls:
                self.nodes.append(Node(center, node.level + 1))
                node.children.append(len(self.nodes) - 1)
                held[len(self.nodes) - 1] = mine
            self.nodes.append(Node(node.center, node.level))
            node.children.append(len(self.nodes) - 1)
            leaves += len(balls)
        self.leaves = [i for i, n in enumerate(self.nodes) if not n.children]
        for cell, i in enumerate(self.leaves):
            self.nodes[i].cell = cell

    @staticmethod
    def _net(sample: np.ndarray, rows: np.ndarray, node: Node, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """(center, rows) of balls of half the node's radius that hold at least `least` of its rows; a ball's center lies in no earlier ball."""
        reach = _cosine_at(node.level + 1)
        balls, tried, center = [], 0, node.center
        left = rows
        while len(left) >= least and tried < TRIES:
            near = sample[left] @ center >= reach
            if near.sum() >= least:
                balls.append((center, left[near]))
                left = left[~near]
            else:
                left = np.roll(left, -1)
            center = sample[left[0]] if len(left) else center
            tried += 1
        return balls

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf cell, chord distance to its center) of each vector, descending to the nearest ball that covers it, else to the self-child."""
        cell, distance = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors))
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            k, rows = stack.pop()
            node = self.nodes[k]
            if not len(rows):
                continue
            if not node.children:
                cell[rows] = node.cell
                distance[rows] = np.linalg.norm(vectors[rows] - node.center, axis=1)
                continue
            *balls, own = node.children
            likeness = vectors[rows] @ np.stack([self.nodes[c].center for c in balls]).T
            nearest = np.where(likeness.max(axis=1) >= _cosine_at(node.level + 1), np.argmax(likeness, axis=1), len(balls))
            stack += [(c, rows[nearest == i]) for i, c in enumerate([*balls, own])]
        return cell, distance

    def measure(self, radius: dict[int, float], count: dict[int, int]) -> None:
        """Covering radii and counts from the leaves up; a parent's ball covers those of its children."""
        for node in reversed(self.nodes):
            if node.children:
                below = [self.nodes[c] for c in node.children if self.nodes[c].count]
                node.count = sum(c.count for c in below)
                node.radius = max((float(np.linalg.norm(c.center - node.center)) + c.radius for c in below), default=0.0)
            else:
                node.radius, node.count = radius.get(node.cell, 0.0), count.get(node.cell, 0)

    def traverse(self, reach: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """(pairs of cells to compare, pairs of cells all of whose vectors are within reach); each unordered pair once."""
        compare, within = [], []
        stack = [(0, 0)]
        while stack:
            i, j = stack.pop()
            a, b = self.nodes[i], self.nodes[j]
            if not a.count or not b.count:
                continue
            apart = float(np.linalg.norm(a.center - b.center))
            if i != j and apart - a.radius - b.radius > reach + SLACK:
                continue
            if a.children and (not b.children or a.radius >= b.radius or i == j):
                if i == j:
                    stack += [(x, y) for n, x in enumerate(a.children) for y in a.children[n:]]
                else:
                    stack += [(x, j) for x in a.children]
            elif b.children:
                stack += [(i, y) for y in b.children]
            elif apart + a.radius + b.radius <= reach - SLACK:
                within.append((a.cell, b.cell))
            else:
                compare.append((a.cell, b.cell))
        return compare, within


def _usable(kind: str):
    """(vec_id, vector as bytes of `kind`) of the rows whose vector has a direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
            start = np.cumsum(length) - length
            for size in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == size)
                vectors = values[start[rows][:, None] + np.arange(size)]
                with np.errstate(invalid="ignore"):
                    good = np.isfinite(vectors).all(axis=1) & (np.abs(vectors).max(axis=1) > 0)
                blobs = [v.tobytes() for v in vectors[good].astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[good])), pa.array(blobs, pa.binary())], ["vec_id", "vector"])

    return run


def _units(blob: bytes, rows: int, kind: str) -> np.ndarray:
    """Unit vectors in double precision; each is scaled by its largest component first, so that no square overflows."""
    raw = np.frombuffer(blob, dtype=kind).astype(np.float64).reshape(rows, -1)
    if not rows:
        return raw
    raw /= np.abs(raw).max(axis=1)[:, None]
    return raw / np.sqrt((raw * raw).sum(axis=1))[:, None]


def _matrix(column, kind: str) -> np.ndarray:
    blobs = column.to_pylist()
    return _units(b"".join(blobs), len(blobs), kind) if blobs else np.zeros((0, 1))


def _placed(tree, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, distance = tree.value.cells(_matrix(batch.column("vector"), kind))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(distance)], [*batch.schema.names, "cell", "distance"])

    return run


def _block(group: pa.Table) -> pa.Table:
    group = group.sort_by("rep")
    ids, weights = (group.column(c).to_numpy().astype(np.int64) for c in ("rep", "copies"))
    return pa.table({"cell": group.column("cell")[:1], "block": group.column("block")[:1], "ids": [ids.tobytes()], "weights": [weights.tobytes()], "vectors": [b"".join(group.column("vector").to_pylist())]})


@dataclass
class Block:
    ids: np.ndarray
    weights: np.ndarray
    units: np.ndarray


def _links_between(a: Block, b: Block, cosine: float) -> pa.RecordBatch | None:
    """(rep, n, to) of two blocks, or of one with itself: how many vectors each links with, and the least one it is connected with."""
    same, pairs = a is b, []
    for i in range(0, len(a.ids), TILE):
        for j in range(i if same else 0, len(b.ids), 8 * TILE):
            left, right = np.nonzero(a.units[i : i + TILE] @ b.units[j : j + 8 * TILE].T >= cosine)
            left, right = left + i, right + j
            if same:
                left, right = left[left < right], right[left < right]
            pairs.append(np.stack([left, right]))
    left, right = np.concatenate(pairs, axis=1)
    if not len(left):
        return None
    both = np.unique(np.concatenate([a.ids, b.ids]))
    la, lb = np.searchsorted(both, a.ids[left]), np.searchsorted(both, b.ids[right])
    n = np.zeros(len(both), dtype=np.int64)
    np.add.at(n, la, b.weights[right])
    np.add.at(n, lb, a.weights[left])
    label = np.arange(len(both))
    while True:
        least = np.minimum(label[la], label[lb])
        after = label.copy()
        np.minimum.at(after, la, least)
        np.minimum.at(after, lb, least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    used = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(both[used]), pa.array(n[used]), pa.array(both[label[used]])], ["rep", "n", "to"])


def _compared(cosine: float, kind: str):
    """Rows (pair, side, own, ...) sorted by pair and side: the two blocks of a pair follow each other, and an `own` pair is one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for r in batch.to_pylist():
                ids, weights = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "weights"))
                block = Block(ids, weights, _units(r["vectors"], len(ids), kind))
                if not r["own"] and r["side"] == 0:
                    held = block
                    continue
                found = _links_between(block if r["own"] else held, block, cosine)
                if found is not None:
                    yield found

    return run


def embedding_links(vectors: DataFrame, cosine: float = COSINE, key: str = "vec_id", value: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors; only `key` and `value` are read.

    Vectors that are null, empty or zero or hold null or non-finite components link with nothing, and
    so do vectors of different lengths with each other. Equal vectors are one class with one representative. Rows that
    repeat a vec_id are counted as vectors of their own and share one outcome; if their vectors differ, links of either are added.
    A null vec_id links with nothing and is never kept. An empty table gives no rows.
    """
    with scratch(vectors.sparkSession) as keep:
        return keep(_classed(vectors, cosine, key, value, cell_rows), "embedding-links")


def _classed(vectors: DataFrame, cosine: float, key: str, value: str, cell_rows: int) -> DataFrame:
    spark = vectors.sparkSession
    small_arrow_batches(spark)
    single = isinstance(vectors.schema[value].dataType.elementType, FloatType)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(value).cast("array<float>" if single else "array<double>").alias("v"))
    found = materialise(rows.where("vec_id IS NOT NULL AND v IS NOT NULL").mapInArrow(_usable(kind), "vec_id long, vector binary"), "vectors")
    sizes = [r[0] for r in found.select(F.length("vector")).distinct().collect()]  # one row for each vector length
    classes = materialise(found.groupBy("vector").agg(F.count("*").alias("copies"), F.min("vec_id").alias("rep")), "classes")
    of_class = found.join(classes, "vector").groupBy("vec_id").agg(F.min("rep").alias("rep"))
    links = None
    for size in sorted(sizes):
        part = _links_of(classes.where(F.length("vector") == size), cosine, math.sqrt(2 - 2 * cosine), kind, size, cell_rows)
        links = part if links is None else links.union(part)
    if links is None:
        placed = rows.select("vec_id", F.lit(None).cast("long").alias("rep"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component"))
    else:
        links = materialise(links, "links")
        component = connected_components(links.select(F.col("rep").alias("src"), F.col("to").alias("dst")))
        counts = links.groupBy("rep").agg(F.sum("n").alias("n"))
        of_rep = classes.groupBy("rep").agg(F.sum(F.col("copies") - 1).alias("copies")).join(counts, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left")
        of_rep = of_rep.select("rep", (F.col("copies") + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
        placed = rows.select("vec_id").join(of_class, "vec_id", "left").join(of_rep, "rep", "left")
    root = F.coalesce("component", "vec_id")
    return placed.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(False)).alias("kept"))


def _links_of(classes: DataFrame, cosine: float, reach: float, kind: str, size: int, cell_rows: int) -> DataFrame:
    """(rep, n, to): partial counts of links of each representative, and a representative it is connected with."""
    spark = classes.sparkSession
    total = classes.count()
    sample = classes.select("rep", "vector").orderBy(F.xxhash64("rep"), "vector").limit(min(SAMPLE_ROWS, max(64, SAMPLE_BYTES // size))).toArrow()  # bounded by SAMPLE_ROWS and SAMPLE_BYTES
    tree = CoverTree(_matrix(sample.column("vector"), kind), total, cell_rows)
    placed = materialise(classes.mapInArrow(_placed(spark.sparkContext.broadcast(tree), kind), "vector binary, copies long, rep long, cell long, distance double"), "placed")
    facts = placed.groupBy("cell").agg(F.max("distance").alias("r"), F.count("*").alias("n"), F.sum("copies").alias("w"), F.min("rep").alias("head")).collect()  # at most MAX_CELLS rows
    tree.measure({f["cell"]: f["r"] for f in facts}, {f["cell"]: f["n"] for f in facts})
    compare, within = tree.traverse(reach)
    of = {f["cell"]: f for f in facts}
    block_rows = max(256, BLOCK_BYTES // size)
    blocks = spark.createDataFrame([(f["cell"], max(1, -(-f["n"] // block_rows))) for f in facts], "cell long, blocks long")
    dealt = placed.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("rep", "vector"), F.col("blocks")))
    stored = dealt.select("cell", "block", "rep", "copies", "vector").groupBy("cell", "block").applyInArrow(_block, "cell long, block long, ids binary, weights binary, vectors binary")
    stored = materialise(stored, "blocks")
    pairs = F.broadcast(spark.createDataFrame(compare, "a long, b long"))  # at most MAX_CELLS squared
    keys = stored.select(F.col("cell").alias("a"), F.col("block").alias("a_block")).join(pairs, "a")
    keys = keys.join(stored.select(F.col("cell").alias("b"), F.col("block").alias("b_block")), "b").where("a <> b OR a_block <= b_block")
    own = (F.col("a") == F.col("b")) & (F.col("a_block") == F.col("b_block"))
    side = lambda k, c: F.struct(F.lit(k).alias("side"), F.col(c).alias("cell"), F.col(f"{c}_block").alias("block"))
    wanted = keys.select(F.struct("a", "a_block", "b", "b_block").alias("pair"), own.alias("own"), F.explode(F.when(own, F.array(side(0, "a"))).otherwise(F.array(side(0, "a"), side(1, "b")))).alias("s"))
    work = wanted.select("pair", "own", "s.*").join(stored, ["cell", "block"]).repartition("pair").sortWithinPartitions("pair", "side")
    with arrow_batches(spark, 1):  # a row holds a block of vectors
        links = materialise(work.select("side", "own", "ids", "weights", "vectors").mapInArrow(_compared(cosine, kind), "rep long, n long, to long"), "found")
    if within:
        whole = spark.createDataFrame([(i, of[j]["w"], of[j]["head"], i == j) for i, j in within] + [(j, of[i]["w"], of[i]["head"], False) for i, j in within if i != j], "cell long, w long, head long, own boolean")
        links = links.union(placed.join(F.broadcast(whole), "cell").select("rep", F.when(F.col("own"), F.col("w") - F.col("copies")).otherwise(F.col("w")).alias("n"), F.col("head").alias("to")))
    return links
