"""Repeated windows of a corpus without a row for every window.

Of all short grams inside a window, the one with the least hash is its anchor. Equal windows have equal
anchors at equal offsets, so it is enough to compare windows whose anchors repeat. Neighbouring windows
mostly share an anchor: all windows of one anchor form an *extent*, and one row stands for them.

A document is told by its doc_id and the hash `h` of its text, so that rows that repeat an id with another text stay apart.

Extents with one anchor gram are sorted into classes of equal content. All windows of a class with
several members repeat. Windows can also repeat between classes of one gram (at the edges of copied
passages); for these, one member of each class is compared in detail.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.llm.hashing import Bloom, Windows, mix, signed, slices
from loomspan.session import materialise

LOW = np.uint64(0xFFFFFFFF)


@dataclass
class Extents:
    """Per extent: text, anchor position, first and last window start; positions count units of the slice."""

    text: np.ndarray
    anchor: np.ndarray
    first: np.ndarray
    last: np.ndarray
    gram: np.ndarray


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    rest = width - span
    return np.minimum(key[:-rest], key[rest:]) if rest else key


def extents(units: Windows, bounds: np.ndarray, gram: int, window: int) -> Extents:
    """The extents of texts [bounds[d], bounds[d + 1]); no window crosses a bound."""
    if units.n < window:
        none = np.zeros(0, dtype=np.int64)
        return Extents(none, none, none, none, none.view(np.uint64))
    grams = units.each(gram)
    key = (mix(grams ^ LOW) & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_least(key, window - gram + 1) & LOW).astype(np.int64)
    valid = np.zeros(units.n + 1, dtype=np.int8)
    long = np.flatnonzero(np.diff(bounds) >= window)
    valid[bounds[long]] += 1
    valid[bounds[long + 1] - window + 1] -= 1
    live = np.cumsum(valid[: len(anchor)]).astype(bool)
    fresh = live.copy()
    fresh[1:] &= (anchor[1:] != anchor[:-1]) | ~live[:-1]
    fresh[bounds[long]] = True
    ends = live.copy()
    ends[:-1] = live[:-1] & (fresh[1:] | ~live[1:])
    first, last = np.flatnonzero(fresh), np.flatnonzero(ends)
    at = anchor[first]
    return Extents(np.searchsorted(bounds, first, side="right") - 1, at, first, last, grams[at])


def gram_keys(texts: DataFrame, read: Callable, gram: int, window: int, length: int, seen) -> DataFrame:
    """One row (key long) for the gram of `length` units around every anchor that `seen` lets through, on either side.

    seen: broadcast list of (length, Bloom) of the shorter levels. At the first level both sides are the anchor gram itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, bounds in slices(batch.column("text")):
                units, edges = read(data, bounds)
                found = surviving(units, edges, gram, window, seen.value)
                keys = [units.spans(found.anchor, found.anchor + gram)] if length == gram else [side for side, _ in flanks(units, edges, found, gram, length)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys)))], ["key"])

    return texts.mapInArrow(run, "key long")


def flanks(units: Windows, bounds: np.ndarray, found: Extents, gram: int, length: int):
    """((keys, which extents) to the right of the anchor, then to its left), where the text has room."""
    low, high = bounds[found.text], bounds[found.text + 1]
    right = np.flatnonzero(found.anchor + length <= high)
    start = found.anchor + gram - length
    left = np.flatnonzero(start >= low)
    yield units.spans(found.anchor[right], found.anchor[right] + length), right
    yield units.spans(start[left], start[left] + length), left


def surviving(units: Windows, bounds: np.ndarray, gram: int, window: int, seen: list[tuple[int, Bloom]]) -> Extents:
    """The extents whose anchors repeat at every level so far, cut to the windows that hold a repeated flank."""
    found = extents(units, bounds, gram, window)
    for length, bloom in seen:
        if length == gram:
            keep = bloom.might_hold(units.spans(found.anchor, found.anchor + gram))
        else:
            ok = [np.zeros(len(found.anchor), dtype=bool) for _ in range(2)]
            for side, (keys, which) in zip(ok, flanks(units, bounds, found, gram, length), strict=True):
                side[which] = bloom.might_hold(keys)
            right, left = ok
            # a window from s holds the right flank if s >= anchor + length - window, the left one if s <= anchor + gram - length
            found.first = np.where(left, found.first, np.maximum(found.first, found.anchor + gram - length + 1))
            found.last = np.where(right, found.last, np.minimum(found.last, found.anchor + length - window - 1))
            keep = found.first <= found.last
        found = Extents(*[x[keep] for x in (found.text, found.anchor, found.first, found.last, found.gram)])
    return found


def repeated_keys(keys: DataFrame) -> DataFrame:
    return materialise(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")


@dataclass
class Repeats:
    members: DataFrame
    heads: DataFrame


PLACE = ("doc_id", "h", "first")
#: content and check are both halves of a digest of an extent's units, with the anchor's place in it.
CONTENT = ("gram", "content", "check")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, h, text): texts with the hash that tells apart rows which repeat a doc_id."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def classes(rows: DataFrame) -> Repeats:
    """Sort extents (gram, content, check, doc_id, h, first, ...) into classes; null doc_ids stand before all others.

    members: the extents of classes with several members, with the class's `head`, its earliest place (doc_id, h, first).
    heads: (gram, content, check, n, head) of every class of a gram that has several classes.
    """
    groups = rows.groupBy(*CONTENT).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("head"))
    groups = materialise(groups, "classes")
    several = groups.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    members = rows.join(groups.where("n > 1").drop("n"), list(CONTENT))
    return Repeats(members, groups.join(several, "gram", "left_semi"))


def only_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """The extents among rows that are the heads of their classes, with n."""
    return rows.join(heads, list(CONTENT)).where(F.struct(*PLACE).eqNullSafe(F.col("head")))


def merged_spans(spans: DataFrame) -> DataFrame:
    """(doc_id, h, spans) of documents with spans (doc_id, h, start, end): overlapping and touching spans are made one."""
    order = Window.partitionBy("doc_id", "h").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(order)).groupBy("doc_id", "h", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


@dataclass
class Marked:
    """Documents with spans, and a filter of their keys that may take a few others for one of them."""

    spans: DataFrame
    some: object

    @classmethod
    def of(cls, spans: DataFrame, keep=materialise) -> Marked:
        """spans: (doc_id, h, start, end), overlapping or not; they are written by `keep`."""
        found = keep(merged_spans(spans), "spans")
        return cls(found, spans.sparkSession.sparkContext.broadcast(Bloom.of(found.select(F.xxhash64("doc_id", "h").alias("key")), "key")))

    @staticmethod
    def key(docs: DataFrame) -> F.Column:
        return F.xxhash64(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")))

    def touched(self, docs: DataFrame) -> F.Column:
        some = self.some

        @F.arrow_udf("boolean")
        def touched(keys: pa.Array) -> pa.Array:
            return pa.array(some.value.might_hold(keys.to_numpy(zero_copy_only=False)))

        return touched(self.key(docs))

    def beside(self, docs: DataFrame) -> DataFrame:
        """The documents that may have spans, all columns, with these in column SPANS: null where there are none. Only they are shuffled."""
        d = docs.where(self.touched(docs)).alias("d")
        on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("s.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("s.h"))
        return d.join(self.spans.alias("s"), on, "left").select("d.*", F.col("s.spans").alias(SPANS))


SPANS = "spans of this row"
