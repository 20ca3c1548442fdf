"""Prefix trie of conversations: which beginnings they share, and what sharing saves.

A turn is the SHA-256 of its role and text, so texts travel no further than the first projection. Exact copies become one weighted sequence before anything else is
shuffled. Sequences are dealt out by the digest of their first turn; the subtries of a bucket are built inside one task as pointer
dictionaries and summed in an iterative postorder. A first turn with more than SUBTRIE_TURNS turns below it is a node of the *spine*: its sequences are dealt out again by their
next turn, as often as needed, and turns that all of them share are passed over in one step. Spine nodes are summed from the deepest level up, by grouped sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import materialise, scratch, small_arrow_batches

SUBTRIE_TURNS = 512
ID_BUCKET_BITS = 10
NOTHING = hashlib.sha256(b"").hexdigest()
PATH = "array<struct<t:binary,chars:long>>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of conversations (conv_id, turn, role, text; others are not read): each conversation's turns in order as digests with their code points.

    Turns are ordered by turn, nulls first; equal ones by digest. A null role or text is empty; repeated rows are turns of their own; rows without a conv_id
    belong to no conversation and are left out. A task holds the digests of one conversation at a time, some 50 bytes a turn.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = empty("role"), empty("text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct(F.col("turn").cast("long").alias("turn"), digest.alias("t"), F.char_length(text).cast("long").alias("chars"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("x")).where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", F.transform("x", lambda x: F.struct(x["t"].alias("t"), x["chars"].alias("chars"))).alias("path"))


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal `seq`; the ids of a sequence come in ascending chunks and pass through its digest."""
    seq, held, total, digest = None, None, 0, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([held.column("conv_id"), held.column("path"), pa.array([total], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "path", "w", "ends"])

    for batch in batches:
        out = []
        for k, (key, ids, w) in enumerate(zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist(), batch.column("w").to_pylist(), strict=True)):
            if key != seq:
                if held is not None:
                    out.append(row())
                seq, held, total, digest = key, batch.slice(k, 1), 0, hashlib.sha256()
            digest.update((("," if total else "") + ids).encode())
            total += w
        yield from out
    if held is not None:
        yield row()


def _distinct(paths: DataFrame) -> DataFrame:
    """(conv_id, path, w, ends): every distinct sequence with its least conversation, their number and the digest of their ids."""
    seq = F.sha2(F.array_join(F.transform("path", lambda x: F.hex(x["t"])), ","), 256)
    chunks = paths.select("conv_id", "path", seq.alias("seq"), F.shiftright("conv_id", ID_BUCKET_BITS).alias("bucket"))
    chunks = chunks.groupBy("seq", "bucket").agg(F.first("path").alias("path"), F.count("*").alias("w"), F.min("conv_id").alias("conv_id"), F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return chunks.repartition("seq").sortWithinPartitions("seq", "bucket").mapInArrow(_copies, f"conv_id long, path {PATH}, w long, ends string")


class _Forest:
    """Subtries as parallel lists; a node's dictionary points from the next turn's digest to a child, which is always later in the lists."""

    def __init__(self) -> None:
        self.children: list[dict[bytes, int]] = []
        self.up: list[int] = []
        self.columns: dict[str, list] = {c: [] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "chars", "ends", "top")}
        self.roots: dict[bytes, int] = {}

    def _node(self, up: int, depth: int, chars: int, top: str | None, parent: int | None) -> int:
        for column, value in zip(self.columns.values(), (None, depth, parent, 0, chars, NOTHING, top), strict=True):
            column.append(value)
        self.children.append({})
        self.up.append(up)
        return len(self.up) - 1

    def add(self, gid: str, over: str, depth: int, path: list[dict], conv: int, w: int, ends: str, parent: int) -> None:
        least, count, node = self.columns["conv_id"], self.columns["n_convs"], -1
        for k in range(depth, len(path)):
            known = self.children[node] if node >= 0 else self.roots
            key = path[k]["t"] if node >= 0 else gid
            below = known.get(key)
            if below is None:
                below = known[key] = self._node(node, k + 1, path[k]["chars"], over if node < 0 else None, parent)
            node = below
            count[node] += w
            least[node] = conv if least[node] is None else min(least[node], conv)
        self.columns["ends"][node] = ends

    def summed(self) -> tuple[list[int], list[int]]:
        """(leaves, saved) of every node's subtree: an iterative postorder, as children stand behind their parents."""
        leaves = [0] * len(self.up)
        saved = [(n - 1) * c for n, c in zip(self.columns["n_convs"], self.columns["chars"], strict=True)]
        for node in range(len(self.up) - 1, -1, -1):
            leaves[node] = leaves[node] or 1
            if (up := self.up[node]) >= 0:
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return leaves, saved


def _subtries(table: pa.Table) -> pa.Table:
    forest = _Forest()
    for r in table.to_pylist():
        forest.add(r["gid"], r["over"], r["depth"], r["path"], r["conv_id"], r["w"], r["ends"], r["parent"])
    leaves, saved = forest.summed()
    c = forest.columns
    parents = [p if up < 0 else c["conv_id"][up] for p, up in zip(c["parent_conv_id"], forest.up, strict=True)]
    longs = (c["conv_id"], c["depth"], parents, c["n_convs"], [len(x) for x in forest.children], leaves, saved)
    return pa.Table.from_arrays([*[pa.array(x, pa.int64()) for x in longs], pa.array(c["ends"], pa.string()), pa.array(c["top"], pa.string())], [*[x.split()[0] for x in NODE.split(", ")], "top"])


def _shared(lo: str, hi: str) -> F.Column:
    """How many turns two sequences begin with alike."""
    differs = F.array_position(F.zip_with(lo, hi, lambda a, b: a["t"].eqNullSafe(b["t"])), F.lit(False))
    return F.when(differs > 0, differs - 1).otherwise(F.size(lo)).cast("long")


def prefix_trie(paths: DataFrame, subtrie_turns: int = SUBTRIE_TURNS) -> DataFrame:
    """Every node of the trie of paths (conv_id, path), one row for each conversation with a conv_id of its own; an empty path is a member of the root.

    conv_id is the smallest member, parent_conv_id that of the parent (null for the root, depth 0); n_convs counts members, n_children children, n_leaves the childless nodes of the
    subtree; saved_tokens sums (n_convs - 1) times the code points of the last turn over the subtree; ends_sha256 is the SHA-256 of the ids, ascending and comma-joined, that
    end at the node. Without any conversation there is no node.
    """
    with scratch(paths.sparkSession) as keep:
        return keep(_nodes(paths, subtrie_turns), "trie")


def _nodes(paths: DataFrame, limit: int) -> DataFrame:
    spark = paths.sparkSession
    small_arrow_batches(spark)
    reps = materialise(_distinct(paths), "sequences")
    turns = reps.agg(F.coalesce(F.sum(F.size("path").cast("long")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // limit))

    # a spine node stands for the turns `first` to `last` that all of its sequences share; the root for none
    ends_here = F.max(F.when(F.size("path") == F.col("last"), F.col("ends")))
    root = reps.withColumn("last", F.lit(0)).agg(F.min("conv_id").alias("conv_id"), F.sum("w").alias("w"), ends_here.alias("ends"))
    root = root.where("w IS NOT NULL").select(F.lit("").alias("gid"), F.lit(None).cast("string").alias("over"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "conv_id", F.lit(None).cast("long").alias("parent"), "w", "ends", F.array(F.lit(0).cast("long")).alias("chars"))
    spine, nodes = [materialise(root, "spine")], []
    rows = reps.withColumns({"over": F.lit(""), "depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("long")})
    least = spine[0].select(F.col("gid").alias("over"), F.col("conv_id").alias("parent"))
    rows = rows.drop("parent").join(F.broadcast(least), "over")  # one row
    while True:
        rows = rows.where(F.size("path") > F.col("depth")).withColumn("gid", F.sha2(F.concat("over", F.hex(F.element_at("path", (F.col("depth") + 1).cast("int"))["t"])), 256))
        rows = materialise(rows, "rows")
        sizes = rows.groupBy("gid").agg(F.sum(F.size("path") - F.col("depth")).alias("turns"))
        large = materialise(sizes.where(F.col("turns") > limit).select("gid", F.lit(True).alias("large")), "large")
        some = large.limit(1).count() > 0
        tagged = rows.join(large, "gid", "left") if some else rows.withColumn("large", F.lit(None).cast("boolean"))
        small = tagged.where("large IS NULL").select(F.pmod(F.xxhash64("gid"), F.lit(buckets)).alias("bucket"), "gid", "over", "depth", "path", "conv_id", "w", "ends", "parent")
        nodes.append(materialise(small.groupBy("bucket").applyInArrow(_subtries, f"{NODE}, top string"), "nodes"))
        if not some:
            break
        hot = tagged.where("large").drop("large")
        groups = hot.groupBy("gid").agg(F.first("over").alias("over"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.min("path").alias("lo"), F.max("path").alias("hi"), F.min("conv_id").alias("conv_id"), F.sum("w").alias("w"))
        groups = materialise(groups.withColumn("last", _shared("lo", "hi")).drop("hi"), "groups")
        # only the least sequence can end where all others still share
        ends = hot.join(groups.select("gid", "last"), "gid").where(F.size("path") == F.col("last")).select("gid", "ends")
        chars = F.transform(F.slice("lo", (F.col("depth") + 1).cast("int"), (F.col("last") - F.col("depth")).cast("int")), lambda x: x["chars"])
        fresh = groups.join(ends, "gid", "left").select("gid", "over", (F.col("depth") + 1).alias("first"), "last", "conv_id", "parent", "w", "ends", chars.alias("chars"))
        spine.append(materialise(fresh, "spine"))
        lead = spine[-1].select("gid", F.col("last").alias("depth"), F.col("conv_id").alias("parent"))
        rows = hot.drop("over", "depth", "parent").join(lead, "gid").withColumnRenamed("gid", "over")
    below = nodes[-1].where("top IS NOT NULL").select(F.col("top").alias("gid"), "n_leaves", "saved_tokens")
    for level in range(len(spine) - 1, -1, -1):
        sums = below.groupBy("gid").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.count("*").alias("n_children"))
        chain = spine[level].join(sums, "gid", "left").withColumns({"n_leaves": F.coalesce("n_leaves", F.lit(1)), "below": F.coalesce("below", F.lit(0)), "n_children": F.coalesce("n_children", F.lit(0))})
        chain = materialise(chain, "chain")
        each = chain.select("*", F.posexplode("chars").alias("k", "c")).withColumn("saved", (F.col("w") - 1) * F.col("c"))
        lower = F.sum("saved").over(Window.partitionBy("gid").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        at_end = F.col("first") + F.col("k") == F.col("last")
        nodes.append(each.select(
            "conv_id", (F.col("first") + F.col("k")).alias("depth"), F.when(F.col("k") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
            F.col("w").alias("n_convs"), F.when(at_end, F.col("n_children")).otherwise(1).alias("n_children"), "n_leaves", (F.col("below") + lower).alias("saved_tokens"),
            F.when(at_end & F.col("ends").isNotNull(), F.col("ends")).otherwise(NOTHING).alias("ends_sha256"), F.lit(None).cast("string").alias("top"),
        ))
        if level:
            own = (F.col("w") - 1) * F.aggregate("chars", F.lit(0).cast("long"), lambda a, x: a + x)
            tops = chain.select(F.col("over").alias("gid"), "n_leaves", (F.col("below") + own).alias("saved_tokens"))
            below = nodes[level - 1].where("top IS NOT NULL").select(F.col("top").alias("gid"), "n_leaves", "saved_tokens").union(tops)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out.drop("top")
