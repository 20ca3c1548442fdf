"""MinHash near-dedup: a chosen-path set similarity join over word shingles.

1. Every text becomes its set of distinct five-word shingles. Equal sets are one class, told by two independent hashes of all shingles and
   represented by the least doc_id, so copies are never compared.
2. Representatives walk down TREES independent trees. A node of a tree is a group of sets that agree
   on the minwise tokens chosen on the way; at every node one coordinate of the signature is chosen,
   and a second one with the chance that makes 1/threshold children the expectation, so that a pair at the
   threshold keeps an expected one common child at every depth.
3. Rows of the walk are a node and a set, nothing else; nodes of one set go at once. The members of a node are first compared with its pivot, its least set,
   so that a group has one pivot in most trees; whatever that links is one component and is never compared again. A node with few sets outside its largest component is then compared
   exhaustively between components; other nodes branch further, and what is left at MAX_DEPTH is compared exhaustively too.
   Nodes of at most NODE_ROWS sets are walked down to the end inside one task each; larger ones branch across the cluster until they are that small.
4. A comparison inside a node is a size bound and a sketch of 128 one-bit minwise hashes. What it finds is not a pair of sets but
   a set and the component it may join: a node gives at most SMALL + 1 rows for each of its sets outside the largest component, however large that is.
5. Such sets are then held against all members of that component on full sets, in blocks of about BLOCK_ROWS sets or BLOCK_SHINGLES on either side: every set
   travels once for each block of the other side, and only links leave a task, one for each set and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.hashing import Bloom, Windows, Words, mix, ragged, signed, slices, whole_groups
from loomspan.llm.repeats import identified
from loomspan.operators.graph import connected_components
from loomspan.session import arrow_batches, discard, materialise, scratch, small_arrow_batches

SHINGLE = 5
COORDINATES = 64
TREES = 12
SMALL = 24
MAX_DEPTH = 16
NODE_ROWS = 20_000
CHUNK_ROWS = 5000
SKETCH_SLACK = 4.5
BLOCK_ROWS = 2000
BLOCK_SHINGLES = 1_000_000
BATCH_ROWS = 200
VECTOR_NODE = 64
TILE = 64
PAIRS = 200_000

_RNG = np.random.default_rng(77003)
_FACTORS = _RNG.integers(0, 1 << 64, COORDINATES, dtype=np.uint64) | np.uint64(1)
_SKETCH_FACTORS = _RNG.integers(0, 1 << 64, 128, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE, other: bool = False) -> tuple[np.ndarray, ...]:
    """(hashes, sizes): the sorted distinct shingle hashes of each text, one text after the other; with `other` also an independent hash of each shingle.

    A text with fewer words than `width` has its whole word sequence as its one shingle, one without words has none.
    """
    words = Words(data, bounds, lower=True)
    n = np.diff(words.first)
    runs = Windows(words.hash)
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    at = ragged(words.first[:-1], count)
    short = np.repeat(n < width, count)
    ends = np.where(short, np.repeat(words.first[1:], count), at + width)
    h = runs.spans(at, ends)
    text = np.repeat(np.arange(len(n)), count)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    sizes = np.bincount(text[fresh], minlength=len(n))
    if not other:
        return h[fresh], sizes
    some = order[fresh]
    return h[fresh], sizes, Windows(words.second()).spans(at[some], ends[some])


def _minima(h: np.ndarray, starts: np.ndarray, factor: np.uint64) -> np.ndarray:
    return np.minimum.reduceat((h * factor) >> np.uint64(20), starts)


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, bounds in slices(batch.column("text")):
                h, sizes, again = shingle_sets(data, bounds, width, other=True)
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                k1, k2, s1, s2 = (np.zeros(end - row, dtype=np.uint64) for _ in range(4))
                sig = np.zeros((end - row, COORDINATES), dtype=np.uint32)
                if len(some):
                    k1[some] = np.add.reduceat(mix(h), starts)
                    k2[some] = np.add.reduceat(mix(again), starts)
                    for i, f in enumerate(_FACTORS):
                        sig[some, i] = _minima(h, starts, f).astype(np.uint32)
                    for i, f in enumerate(_SKETCH_FACTORS):
                        bit = mix(_minima(h, starts, f)) & np.uint64(1)
                        (s1 if i < 64 else s2)[some] |= bit << np.uint64(i % 64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row), batch.column("h").slice(row, end - row), pa.array(sizes.astype(np.int64)), *[pa.array(signed(x)) for x in (k1, k2, s1, s2)], pa.array([x.tobytes() for x in sig], pa.binary())],
                    ["doc_id", "h", "n", "k1", "k2", "s1", "s2", "sig"],
                )

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.value.might_hold(batch.column("key").to_numpy())))
            for row, end, data, bounds in slices(batch.column("text")):
                h, sizes = shingle_sets(data, bounds, width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(signed(h)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), batch.column("h").slice(row, end - row), lists], ["doc", "h", "shingles"])

    return run


def _branch(node: np.ndarray, sig: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, child): the children of each row's node that the row walks to. The node alone decides which coordinates are chosen."""
    pick = mix(node.copy())
    first = (pick % np.uint64(COORDINATES)).astype(np.int64)
    second = (first + 1 + ((pick >> np.uint64(8)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES
    both = (pick >> np.uint64(32)) < np.uint64(int((1 / threshold - 1) * (1 << 32)))
    rows = np.arange(len(node))
    out = np.concatenate([rows, rows[both]])
    chosen = np.concatenate([first, second[both]])
    return out, mix(node[out] * np.uint64(0x9E3779B97F4A7C15) + sig[out, chosen] * np.uint64(COORDINATES) + chosen.astype(np.uint64))


def _sig_matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, COORDINATES)


def _children(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, child = _branch(batch.column("node").to_numpy().view(np.uint64), _sig_matrix(batch.column("sig")), threshold)
            out = batch.drop_columns(["node", "sig"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(signed(child)), *out.columns], ["node", *out.schema.names])

    return run


def _at_each_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each of a set's nodes."""
    for batch in batches:
        nodes = batch.column("nodes")
        rest = batch.drop_columns(["nodes"]).take(pc.list_parent_indices(nodes))
        yield pa.RecordBatch.from_arrays([pc.list_flatten(nodes), *rest.columns], ["node", *rest.schema.names])


def _slack(percent: int) -> int:
    """Bits in which the sketches of a pair at the threshold differ at most, but for one pair in a hundred thousand."""
    expected = 128 * (1 - percent / 100) / 2
    return int(expected + SKETCH_SLACK * (expected * (1 - (1 - percent / 100) / 2)) ** 0.5)


def _alike(n, s1, s2, a, b, percent: int) -> np.ndarray:
    """The bounds that every pair at the threshold meets, of rows a against rows b: sizes surely, the sketch nearly so."""
    near = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
    return near & (np.bitwise_count(s1[a] ^ s1[b]).astype(np.int64) + np.bitwise_count(s2[a] ^ s2[b]) <= _slack(percent))


def _walked(percent: int, depth: int, last: int):
    """Distinct (c, rep, n): sets of n shingles that may be linked with a set of component c. Rows are whole nodes of bounded size, walked down from `depth`
    to `last` inside the task, all nodes of a chunk at once."""

    def within(row, part_size, edges, component, *sketch) -> Iterator[np.ndarray]:
        """All pairs of small nodes; row is sorted by node and component, part_size holds how many of the row's node are of its component."""
        node_end = np.repeat(edges[1:], np.diff(edges))
        at = np.arange(len(row))
        count = node_end - at - 1
        # a slice holds whole rows of about PAIRS pairs
        cuts = np.searchsorted(np.cumsum(count), np.arange(PAIRS, count.sum() + PAIRS, PAIRS), side="right") + 1
        begin = 0
        for end in np.unique(np.minimum(np.append(cuts, len(row)), len(row))).tolist():
            mine = slice(begin, end)
            begin = end
            left, right = np.repeat(at[mine], count[mine]), ragged(at[mine] + 1, count[mine])
            a, b = row[left], row[right]
            near = (component[a] != component[b]) & _alike(*sketch, a, b, percent)
            left, right = left[near], right[near]
            swap = (part_size[left] > part_size[right]) | ((part_size[left] == part_size[right]) & (component[row[left]] > component[row[right]]))
            yield np.stack([component[row[np.where(swap, left, right)]], row[np.where(swap, right, left)]], axis=1)

    def against(rows: np.ndarray, component, *sketch) -> Iterator[np.ndarray]:
        """The sets of one node outside its largest component against all others."""
        names, count = np.unique(component[rows], return_counts=True)
        main = names[np.argmax(count)]
        outside = rows[component[rows] != main]
        for k in range(0, len(outside), TILE):
            i = outside[k : k + TILE][:, None]
            near = (component[i] != component[rows]) & ((component[rows] == main) | (component[i] < component[rows])) & _alike(*sketch, i, rows[None, :], percent)
            left, right = np.nonzero(near)
            yield np.unique(np.stack([component[rows[right]], outside[k + left]], axis=1), axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "node", CHUNK_ROWS):
            rep, component, n = (chunk.column(c).to_numpy() for c in ("rep", "component", "n"))
            sketch = (n, *[chunk.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")])
            sig = _sig_matrix(chunk.column("sig")) if last > depth else None
            node, row = chunk.column("node").to_numpy().view(np.uint64), np.arange(chunk.num_rows)
            found = [np.zeros((0, 2), dtype=np.int64)]
            for level in range(depth, last + 1):
                order = np.lexsort((component[row], node))
                node, row = node[order], row[order]
                part = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (component[row[1:]] != component[row[:-1]])))
                most = np.diff(np.append(part, len(row)))
                first = np.flatnonzero(np.append(True, node[part][1:] != node[part][:-1]))
                edges = np.append(part[first], len(row))
                size = np.diff(edges)
                others = size - np.maximum.reduceat(most, first)
                done = (others > 0) & ((others <= SMALL) | (level == last))
                for g in np.flatnonzero(done & (size > VECTOR_NODE)).tolist():
                    found += against(row[edges[g] : edges[g + 1]], component, *sketch)
                small = done & (size <= VECTOR_NODE)
                if small.any():
                    take = np.repeat(small, size)
                    found += within(row[take], np.repeat(most, most)[take], np.append(0, np.cumsum(size[small])), component, *sketch)
                deeper = np.repeat((others > 0) & ~done, size)
                if not deeper.any():
                    break
                node, row = node[deeper], row[deeper]
                which, node = _branch(node, sig[row], percent / 100)
                row = row[which]
            pairs = np.concatenate(found)
            pairs = np.unique(np.stack([pairs[:, 0], rep[pairs[:, 1]], n[pairs[:, 1]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs.T], ["c", "rep", "n"])

    return run


def _linked_in_group(chunk: pa.Table, percent: int) -> Iterator[tuple[int, int]]:
    """(x, y) for every set of side 0 that is linked with a set of side 1, to the first such one. One group, sorted by side."""
    side = chunk.column("side").to_numpy()
    shingles = chunk.column("shingles").combine_chunks()
    shingles = shingles.chunk(0) if isinstance(shingles, pa.ChunkedArray) else shingles
    flat, length = pc.list_flatten(shingles).to_numpy(), pc.list_value_length(shingles).to_numpy().astype(np.int64)
    start = np.cumsum(length) - length
    rep, n = chunk.column("rep").to_numpy(), chunk.column("n").to_numpy()
    s1, s2 = (chunk.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2"))
    xs, ys = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(xs) or not len(ys):
        return
    known, place = np.unique(flat[start[ys[0]] :], return_inverse=True)
    base = start[ys[0]]
    mark = np.zeros(len(known), dtype=bool)
    for x in xs.tolist():
        near = ys[(rep[ys] != rep[x]) & _alike(n, s1, s2, x, ys, percent)]
        if not len(near):
            continue
        mine = flat[start[x] : start[x] + length[x]]
        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        at = at[known[at] == mine]
        mark[at] = True
        held = mark[place[ragged(start[near] - base, length[near])]]
        both = np.add.reduceat(held, np.cumsum(length[near]) - length[near], dtype=np.int64)
        mark[at] = False
        linked = np.flatnonzero(100 * both >= percent * (length[x] + length[near] - both))
        if len(linked):
            yield int(rep[x]), int(rep[near[linked[0]]])


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "key", BATCH_ROWS):
            keys = chunk.column("key").to_numpy()
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])).tolist() + [len(keys)]
            found = [x for a, b in zip(edges[:-1], edges[1:], strict=True) for x in _linked_in_group(chunk.slice(a, b - a), percent)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _confirm(docs: DataFrame, reps: DataFrame, candidates: DataFrame, members: DataFrame, percent: int, width: int) -> DataFrame:
    """(a, b): one link on full sets for every candidate (c, rep, n) that is linked with one of the members (c, rep) of its group c.

    Blocks are counted by sets and, as only sets of like size are compared, by the largest size n of a group's candidates.
    """
    spark = docs.sparkSession
    members = members.join(candidates.select("c").distinct(), "c", "left_semi")
    sides = candidates.select("c", "rep", F.lit(0).alias("side"), "n").union(members.select("c", "rep", F.lit(1), F.lit(0).cast("long")))
    sides = materialise(sides.distinct(), "sides")
    used = materialise(sides.select("rep").distinct().join(reps.select("rep", "doc", "h", "n", "s1", "s2"), "rep"), "used")

    def blocks(side: int) -> F.Column:
        sets = F.count_if(F.col("side") == side)
        return F.greatest(F.lit(1), F.ceil(sets / BLOCK_ROWS), F.ceil(sets * F.max("n") / BLOCK_SHINGLES)).cast("int").alias(f"b{side}")

    counts = sides.groupBy("c").agg(blocks(0), blocks(1)).where("b0 * b1 > 1")
    dealt = sides.join(counts, "c", "left").withColumns({"b0": F.coalesce("b0", F.lit(1)), "b1": F.coalesce("b1", F.lit(1))})
    own, other = F.when(F.col("side") == 0, F.col("b0")).otherwise(F.col("b1")), F.when(F.col("side") == 0, F.col("b1")).otherwise(F.col("b0"))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("rep"), own)).withColumn("theirs", F.explode(F.sequence(F.lit(0), other - 1)))
    block = F.when(F.col("side") == 0, F.struct(F.col("mine").cast("long").alias("x"), F.col("theirs").cast("long").alias("y")))
    block = block.otherwise(F.struct(F.col("theirs").cast("long").alias("x"), F.col("mine").cast("long").alias("y")))
    dealt = dealt.select(F.xxhash64("c", block).alias("key"), "side", "rep")

    wanted = spark.sparkContext.broadcast(Bloom.of(used.select(F.xxhash64("doc", "h").alias("key")), "key"))
    sets = docs.select("doc_id", "h", "text", F.xxhash64("doc_id", "h").alias("key")).mapInArrow(_sets(width, wanted), "doc long, h long, shingles array<long>")
    sets = materialise(sets.join(used, ["doc", "h"]).drop("doc", "h"), "sets")
    work = dealt.join(sets, "rep").repartition("key").sortWithinPartitions("key", "side")
    with arrow_batches(spark, BATCH_ROWS):
        return materialise(work.select("key", "side", "rep", "n", "s1", "s2", "shingles").mapInArrow(_linked(percent), "a long, b long").distinct(), "links")


def _shared(rows: DataFrame) -> DataFrame:
    """(node, rep, c): the rows of nodes that hold several sets, c is the node's least one. The rows' own table goes."""
    # written, so that adaptive execution may split a node of very many rows in the join
    nodes = materialise(rows.groupBy("node").agg(F.count("*").alias("k"), F.min("rep").alias("c")).where("k > 1").drop("k"), "nodes")
    shared = materialise(rows.join(nodes, "node"), "shared")
    for gone in (rows, nodes):
        discard(gone)
    return shared


def _live(rows: DataFrame, component: DataFrame) -> DataFrame:
    """rows of all nodes that hold sets of two components, with their node's size, and how many of its sets lie outside its largest component."""
    rows = rows.select("node", "rep").join(component, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = rows.groupBy("node", "component").agg(F.count("*").alias("k"))
    nodes = parts.groupBy("node").agg(F.sum("k").alias("size"), (F.sum("k") - F.max("k")).alias("others"), F.max_by("component", F.struct("k", "component")).alias("main")).where("others > 0")
    return materialise(rows.join(nodes, "node"), "live")


def _pivots(rows: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """(c, rep, n): the sets that may be linked with the pivot c of one of their nodes."""
    pairs = rows.where("rep <> c").select("c", "rep").distinct()
    pivots = reps.select(F.col("rep").alias("c"), F.col("n").alias("pn"), F.col("s1").alias("p1"), F.col("s2").alias("p2"))
    sizes = F.lit(100) * F.least("n", "pn") >= F.lit(percent) * F.greatest("n", "pn")
    bits = F.bit_count(F.col("s1").bitwiseXOR(F.col("p1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("p2")))
    return pairs.join(reps.select("rep", "n", "s1", "s2"), "rep").join(pivots, "c").where(sizes & (bits <= _slack(percent))).select("c", "rep", "n")


def _in_pieces(rows: DataFrame) -> DataFrame:
    """Nodes of more than NODE_ROWS sets in pieces of that many; the sets outside the largest component stand in every piece."""
    pieces = F.ceil(F.col("size") / NODE_ROWS).cast("int")
    piece = F.when(F.col("component") == F.col("main"), F.array(F.pmod(F.xxhash64("rep"), pieces).cast("int"))).otherwise(F.sequence(F.lit(0), pieces - 1))
    cut = rows.withColumn("piece", F.explode(piece))
    return cut.withColumn("node", F.when(F.col("size") > NODE_ROWS, F.xxhash64("node", "piece")).otherwise(F.col("node")))


def _with_sets(rows: DataFrame, reps: DataFrame, *more: str) -> DataFrame:
    """rows (node, rep, component) with n, s1, s2 and `more` columns of reps; these are joined once for each set, whatever its nodes."""
    sets = rows.groupBy("rep").agg(F.first("component").alias("component"), F.collect_list("node").alias("nodes"))
    joined = sets.join(reps, "rep").select("nodes", "rep", "component", "n", "s1", "s2", *more)
    types = {f.name: f.dataType.simpleString() for f in joined.schema}
    return joined.mapInArrow(_at_each_node, ", ".join(["node long", *[f"{c} {types[c]}" for c in joined.columns[1:]]]))


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = SHINGLE, trees: int = TREES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text; others are not read).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets;
    component_id is the least doc_id reachable over links. Texts without words, null and empty
    texts have no shingles and are linked with nothing. Rows that repeat a doc_id are the same document, which is
    linked with whatever the set of any of its rows is linked with. A null doc_id stays alone,
    with a null component_id and kept false. An empty table gives no rows.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(_components(docs, percent, width, trees), "near-duplicates")


def _components(docs: DataFrame, percent: int, width: int, trees: int) -> DataFrame:
    spark = docs.sparkSession
    small_arrow_batches(spark)
    docs = identified(docs)
    found = materialise(docs.mapInArrow(_signatures(width), "doc_id long, h long, n long, k1 long, k2 long, s1 long, s2 long, sig binary"), "signatures")
    sets = found.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialise(sets.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "h")).alias("rep")), "classes")
    # a class is named by its least doc_id; further classes of one doc_id have names above all ids in use, and are linked with it
    least = classes.groupBy(F.col("rep.doc_id").alias("doc_id")).agg(F.min(F.struct("k1", "k2", "n")).alias("least"))
    other = F.shiftrightunsigned(F.xxhash64("k1", "k2", "n"), 2).bitwiseOR(F.lit(1 << 62))
    own = F.when(F.struct("k1", "k2", "n") == F.col("least"), F.col("doc_id")).otherwise(other).alias("name")
    names = classes.select("k1", "k2", "n", F.col("rep.doc_id").alias("doc_id"), F.col("rep.h").alias("h")).join(least, "doc_id")
    names = materialise(names.select("k1", "k2", "n", "doc_id", "h", own), "names")
    of_class = materialise(sets.select("doc_id", "k1", "k2", "n").join(names.drop("doc_id", "h"), ["k1", "k2", "n"]).select("doc_id", F.col("name").alias("rep")), "of-class")
    several = of_class.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").drop("z")
    twins = materialise(of_class.join(several, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "twins")
    reps = sets.join(names, ["doc_id", "h", "k1", "k2", "n"]).select(F.col("name").alias("rep"), F.col("doc_id").alias("doc"), "h", "n", "s1", "s2", "sig")
    reps = materialise(reps.dropDuplicates(["rep"]), "reps")
    sizes = materialise(found.select("doc_id", "n"), "sizes")
    discard(found)  # the signatures of all documents; those of distinct sets are kept

    walk = "node long, rep long"
    roots = reps.withColumn("node", F.explode(F.array(*[F.lit(t + 1).cast("long") for t in range(trees)]))).select("node", "rep", "sig")
    rows = _shared(materialise(roots.mapInArrow(_children(percent / 100), walk), "walk"))
    star = materialise(_pivots(rows, reps, percent), "star")
    links = _confirm(docs, reps, star, star.select("c", F.col("c").alias("rep")), percent, width).union(twins)
    component = connected_components(links, "a", "b").select(F.col("node").alias("rep"), "component")

    may = "c long, rep long, n long"
    joining = None
    for depth in range(1, MAX_DEPTH + 1):
        live = _live(rows, component)
        discard(rows)
        settled = live.where((F.col("others") <= SMALL) | F.lit(depth == MAX_DEPTH))
        whole = _with_sets(_in_pieces(settled), reps).repartition("node").sortWithinPartitions("node")
        fresh = whole.mapInArrow(_walked(percent, depth, depth), may)
        if depth < MAX_DEPTH:
            open_ = live.where(F.col("others") > SMALL)
            inside = _with_sets(open_.where(F.col("size") <= NODE_ROWS), reps, "sig").repartition("node").sortWithinPartitions("node")
            fresh = fresh.union(inside.mapInArrow(_walked(percent, depth, MAX_DEPTH), may))
        fresh = materialise(fresh.distinct(), "candidates")
        joining = fresh if joining is None else joining.union(fresh)
        if depth == MAX_DEPTH:
            break
        large = open_.where(F.col("size") > NODE_ROWS)
        if not large.limit(1).count():
            break
        deeper = _with_sets(large, reps, "sig").select("node", "rep", "sig")
        rows = _shared(materialise(deeper.mapInArrow(_children(percent / 100), walk), "walk"))
        discard(live)
    component = materialise(component, "component")
    # a candidate names its group by a component; sets without links are components of their own
    members = component.select(F.col("component").alias("c"), "rep").union(joining.select("c", F.col("c").alias("rep")))
    late = _confirm(docs, reps, joining, members, percent, width)
    if late.limit(1).count():
        component = connected_components(links.union(late), "a", "b").select(F.col("node").alias("rep"), "component")
    placed = of_class.join(component, "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component"))
    out = sizes.join(placed, "doc_id", "left")
    root = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), root.alias("component_id"), F.coalesce(root == F.col("doc_id"), F.lit(False)).alias("kept"))


def one_of_each_group(docs: DataFrame, percent: int = 80, width: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, without near duplicates: of each component the document of least doc_id stays.

    Documents that are linked with nothing, null and empty texts stay. A null doc_id stands for a document of its own, named by its text and
    behind all others; of rows that repeat a doc_id and a text, one stays.
    """
    text = F.col("text").cast("string")
    # names of texts without an id are above all ids in use: a hash in the upper quarter of the 64-bit numbers
    name = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(1 << 62)))
    found = near_duplicates(docs.select(name.alias("doc_id"), text.alias("text")), percent, width).select("doc_id", "kept")
    gone = found.where("NOT kept").select("doc_id").distinct()
    left = docs.withColumn("name of this row", name).join(gone.withColumnRenamed("doc_id", "name of this row"), "name of this row", "left_anti")
    again = materialise(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("name of this row")), "repeated")
    if again.limit(1).count():
        once = left.join(again, "name of this row", "left_semi").withColumn("text of this row", F.coalesce(F.sha2(text, 256), F.lit("")))
        once = once.dropDuplicates(["name of this row", "text of this row"]).drop("text of this row")
        left = left.join(again, "name of this row", "left_anti").unionByName(once)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])
