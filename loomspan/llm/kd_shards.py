"""K-d tree partitioning into shards of near-equal bytes, in DataFrame operations only.

Every document is a point in four metadata dimensions (source, language, size, position in the
corpus). The tree starts with one node that owes all shards; each level splits a node that owes m
shards at the weighted quantile floor(m/2)/m along its widest dimension, until every leaf owes one.

A quantile is found without sorting a node: bytes are summed in histogram bins (combined before
their shuffle), the bin that holds the quantile is cut into finer bins, and so on until the bin
holds a negligible share of the node or one coordinate. Coordinates are 62-bit integers whose low
half hashes the document id, so that equal metadata never makes an unsplittable tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import discard, materialise

DIMS = 4
BIN_BITS = 10
KEY_BITS = 60
LOW_BITS = 30
TOLERANCE = 2e-4
SLOT_ROWS = 1000


def _unit(column: F.Column, low: float, high: float) -> F.Column:
    return F.least(F.greatest((column - F.lit(low)) / F.lit(max(high - low, 1e-9)), F.lit(0.0)), F.lit(1.0))


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, k0..k3) of every document; text is read here and never again.

    A null text has size 16 and the checksum of the empty string. Null or absent source and
    language stand at the low end of their dimension; repeated ids are separate rows. Rows that repeat an id and its text
    are numbered as they are written, so that their coordinates differ in the hashed half like those of others.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    name = lambda c: (F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")) / F.lit(2.0**32)) if c in docs.columns else F.lit(0.0)
    flat = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        name("source").alias("d0"),
        name("lang").alias("d1"),
        F.monotonically_increasing_id().alias("row"),
    )
    flat = materialise(flat, "kd-points")
    again = materialise(flat.groupBy("doc_id", "text_crc32").count().where("count > 1").select(F.col("doc_id").alias("id"), F.col("text_crc32").alias("crc")), "kd-repeats")
    if again.limit(1).count():
        repeated = flat["doc_id"].eqNullSafe(again["id"]) & (flat["text_crc32"] == again["crc"])
        flat = flat.join(again, repeated, "left").withColumn("row", F.when(F.col("crc").isNotNull(), F.col("row"))).drop("id", "crc")
    else:
        flat = flat.withColumn("row", F.lit(None).cast("long"))
    low, high, big = flat.agg(F.min("doc_id"), F.max("doc_id"), F.max("size")).first()
    jitter = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "text_crc32", "row"), 64 - LOW_BITS)
    dims = [
        F.col("d0"),
        F.col("d1"),
        F.log2(F.col("size").cast("double")) / F.lit(float(max(4, int(big or 16).bit_length()))),
        F.coalesce(_unit(F.col("doc_id").cast("double"), float(low or 0), float(high or 0)), F.lit(0.0)),
    ]
    keys = [(F.least(F.floor(F.greatest(d, F.lit(0.0)) * F.lit(2.0**LOW_BITS)).cast("long"), F.lit(2**LOW_BITS - 1)) * F.lit(2**LOW_BITS) + jitter).alias(f"k{i}") for i, d in enumerate(dims)]
    return flat.select("doc_id", "size", "text_crc32", *keys)


def _table(values: list, index: F.Column) -> F.Column:
    """values[index] as a literal array: at most one entry per node, so at most one per shard."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), index + F.lit(1))


def _key(dim: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.col(f"k{i}") for i in range(DIMS)]), dim + F.lit(1))


def _cuts(rows: DataFrame, owed: list[int], widest: list[int], totals: list[int]) -> list[int]:
    """The least coordinate of each node's right part. Each round is one grouped sum, refined by BIN_BITS."""
    n = len(owed)
    base, below, bits = [0] * n, [0] * n, [KEY_BITS] * n
    want = [t * (m // 2) / m for t, m in zip(totals, owed, strict=True)]
    live = [m > 1 and t > 0 for m, t in zip(owed, totals, strict=True)]
    while any(live):
        step = [max(0, b - BIN_BITS) for b in bits]
        node = F.col("node")
        at = _key(_table(widest, node)) - _table(base, node)
        inside = F.array(*[F.lit(bool(x)) for x in live])
        binned = (
            rows.where(F.element_at(inside, node + F.lit(1)) & (at >= 0) & (at < _table([1 << b for b in bits], node)))
            .withColumn("bin", F.floor(at / _table([1 << s for s in step], node).cast("double")).cast("int"))
            .groupBy("node", "bin")
            .agg(F.sum("size").alias("w"), F.count("*").alias("n"))
        )
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin"))
        goal = F.element_at(F.array(*[F.lit(float(w - b)) for w, b in zip(want, below, strict=True)]), node + F.lit(1))
        found = binned.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("node").agg(F.min_by(F.struct("bin", "w", "n", "upto"), "bin").alias("x"))
        for r in found.collect():  # one row for each node
            k, x = r["node"], r["x"]
            base[k] += x["bin"] << step[k]
            below[k] += x["upto"] - x["w"]
            bits[k] = step[k]
            if x["n"] == 1 or bits[k] == 0 or x["w"] <= TOLERANCE * totals[k] / owed[k]:
                live[k] = False
                if want[k] - below[k] > x["w"] / 2:
                    base[k] += 1 << bits[k]
    return base


def kd_shards(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Every document with its shard in 0..shards-1 and a gapless slot inside it.

    Returns (doc_id, size, text_crc32, shard, slot). Of every split the left side's bytes differ from its share by at most half of
    one document and TOLERANCE of a shard, so a shard of s bytes on average is off by at most a document for each
    level of the tree. Equal texts and repeated rows, however many, differ in the hashed low half of their coordinates and are dealt like
    others, so no shard stays empty while there are rows for it. Repeated and null ids are rows of their own. An
    empty table gives no rows; columns of docs other than doc_id, text, source and lang are not read, whatever their names.
    """
    rows = materialise(points(docs).withColumn("node", F.lit(0)), "kd-level")
    owed, first = [shards], [0]
    while max(owed) > 1:
        stats = rows.groupBy("node").agg(F.sum("size").alias("total"), *[(F.max(f"k{i}") - F.min(f"k{i}")).alias(f"w{i}") for i in range(DIMS)])
        totals, widest = [0] * len(owed), [0] * len(owed)
        for r in stats.collect():  # one row for each node, at most one for each shard
            totals[r["node"]] = r["total"]
            widest[r["node"]] = max(range(DIMS), key=lambda i, r=r: r[f"w{i}"])
        cut = _cuts(rows, owed, widest, totals)
        child, next_owed, next_first = [], [], []
        for m, f in zip(owed, first, strict=True):
            child.append(len(next_owed))
            parts = [m] if m == 1 else [m // 2, m - m // 2]
            for p in parts:
                next_owed.append(p)
                next_first.append(f)
                f += p
        node = F.col("node")
        right = (_table(owed, node) > 1) & (_key(_table(widest, node)) >= _table(cut, node))
        deeper = materialise(rows.withColumn("node", (_table(child, node) + right.cast("int")).cast("int")), "kd-level")
        discard(rows)
        rows = deeper
        owed, first = next_owed, next_first
    shard = _table(first, F.col("node")).cast("int")
    return with_slots(rows.select("doc_id", "size", "text_crc32", "k0", shard.alias("shard")), shards)


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """Number the rows (k0 tells repeated ones apart) of each shard from 0 in groups of about SLOT_ROWS, so that no task orders a whole shard."""
    count = rows.count()
    per = max(1, count // (SLOT_ROWS * shards))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32", "k0"), F.lit(per)).cast("int"))
    offsets = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("rank", F.row_number().over(inner) - 1)
    return numbered.join(offsets, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
