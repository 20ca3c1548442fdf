"""Suffix-array dedup on bytes by common-prefix intervals.

Windows are first narrowed down to extents whose anchors repeat (see repeats.py). Extents of equal content
need no sorting: all but the earliest are repeats as a whole. What is left, one extent of each class of a gram
with several classes, is dealt out by gram; each task sorts the suffixes of its extents into an enhanced
suffix array (order and adjacent common prefixes) and scans it with a stack. Every interval of
common prefixes of at least `length` bytes whose occurrences differ in the byte to their left is a maximal
repeat, and is output with all its occurrences.

A gram with more than HOT classes would make one task's array too long. Its extents are taken apart by longer context: each is cut into PARTS
by where its windows start, and a part belongs to the gram of all bytes that its windows share, which is longer than the gram before. Parts are
sorted into classes again, so that copied middles leave at once, and are cut on until every gram has few classes. A single
window is its own context, so this ends; rows follow the logarithm of a window's length, not its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.hashing import _UNITS, Bloom, Windows, digests, mix, signed, slices, whole_groups
from loomspan.llm.repeats import SPANS, Extents, Marked, classes, gram_keys, identified, only_heads, repeated_keys, surviving
from loomspan.session import materialise, scratch, small_arrow_batches

LENGTH = 100
GRAM = 32
HOT = 400
PARTS = 4
CHUNK_ROWS = 1500


def _read(data: np.ndarray, bounds: np.ndarray) -> tuple[Windows, np.ndarray]:
    return Windows(_UNITS[data]), bounds


EXTENT = "gram long, content long, check long, doc_id long, h long, first long, last long"
DETAIL = f"{EXTENT}, at int, bytes binary"


def _extents(window: int, gram: int, seen, only=None):
    """The extents of every text; with `only`, a broadcast filter of grams, just theirs, with their bytes and the place `at` of the gram in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, bounds in slices(batch.column("text")):
                units, edges = _read(data, bounds)
                found = surviving(units, edges, gram, window, seen.value)
                if only:
                    keep = only.value.might_hold(found.gram)
                    found = Extents(*[x[keep] for x in (found.text, found.anchor, found.first, found.last, found.gram)])
                end, rows, raw = found.last + window, pa.array(row + found.text), data.tobytes()
                content = digests(raw, found.first, end)
                columns = {
                    "gram": pa.array(signed(found.gram)),
                    "content": pa.array(content[:, 0] + (found.anchor - found.first)),
                    "check": pa.array(content[:, 1]),
                    "doc_id": batch.column("doc_id").take(rows),
                    "h": batch.column("h").take(rows),
                    "first": pa.array((found.first - edges[found.text]).astype(np.int64)),
                    "last": pa.array((found.last - edges[found.text]).astype(np.int64)),
                }
                if only:
                    columns["at"] = pa.array((found.anchor - found.first).astype(np.int32))
                    columns["bytes"] = pa.array([raw[a:b] for a, b in zip(found.first.tolist(), end.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def prefix_intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(left, right, length) of every interval [left, right] of the suffix order whose members share `length` >= least bytes.

    lcp[i] is the common prefix of suffixes i - 1 and i. The open intervals form the stack; one closes where the
    common prefix drops below its length.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*lcp[1:], 0], start=1):
        left = i - 1
        while stack and stack[-1][1] > value:
            left, length = stack.pop()
            yield left, i - 1, length
        if value >= least and (not stack or stack[-1][1] < value):
            stack.append((left, value))


def maximal_repeats(texts: list[bytes], starts: list[int], least: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, position), ...]) of the maximal repeats of at least `least` bytes in texts.

    starts[r]: how many positions of text r may begin a repeat. A repeat is maximal if its occurrences do not all
    follow the same byte and do not all continue alike.
    """
    count = np.array([min(s, max(0, len(t) - least + 1)) for s, t in zip(starts, texts, strict=True)], dtype=np.int64)
    n = int(count.sum())
    if n < 2:
        return
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    width = int(sizes.max())
    flat = np.frombuffer(b"".join(texts) + bytes(width), dtype=np.uint8)
    offsets = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), count)
    position = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    length = sizes[text] - position
    table = np.lib.stride_tricks.sliding_window_view(flat, width)[offsets[text] + position].copy()
    table[np.arange(width)[None, :] >= length[:, None]] = 0
    order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
    table, text, position, length = table[order], text[order], position[order], length[order]
    same = table[1:] == table[:-1]
    lcp = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
    lcp = np.minimum(lcp, np.minimum(length[1:], length[:-1]))
    before = np.where(position > 0, flat[offsets[text] + position - 1].astype(np.int64), -1)
    runs = np.flatnonzero(lcp >= least)
    if not len(runs):
        return
    for left, right, shared in prefix_intervals([0, *lcp.tolist()], least):
        preceding = before[left : right + 1]
        if preceding[0] >= 0 and (preceding == preceding[0]).all():
            continue
        yield shared, list(zip(text[left : right + 1].tolist(), position[left : right + 1].tolist(), strict=True))


REPEAT = "gram long, length long, doc_id long, h long, start long, earliest boolean"


def _repeats_in(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in whole_groups(batches, "gram", CHUNK_ROWS):
            gram, ids, h, first = (chunk.column(c).to_pylist() for c in ("gram", "doc_id", "h", "first"))
            starts = (chunk.column("last").to_numpy() - chunk.column("first").to_numpy() + 1).tolist()
            out: list[tuple] = []
            for length, places in maximal_repeats(chunk.column("bytes").to_pylist(), starts, least):
                found = [(gram[t], length, ids[t], h[t], first[t] + p) for t, p in places]
                head = min((d is not None, d or 0, k, s) for _, _, d, k, s in found)
                out += [(*x, (x[2] is not None, x[2] or 0, *x[3:]) == head) for x in found]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(),) * 5 + (pa.bool_(),), strict=True)], ["gram", "length", "doc_id", "h", "start", "earliest"])

    return run


def _parts(window: int, low: int, width: int):
    """Extents whose windows start at `low` to low + width - 1, counted from their gram, cut into PARTS with longer grams."""
    step = -(-width // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, first, last, at = (batch.column(c).to_numpy() for c in ("gram", "first", "last", "at"))
            for row, end, data, bounds in slices_of_bytes(batch.column("bytes")):
                units, raw = Windows(_UNITS[data]), data.tobytes()
                mine = slice(row, end)
                anchor = bounds[:-1] + at[mine]
                for begin in range(low, low + width, step):
                    stop = min(begin + step, low + width) - 1
                    a, b = np.maximum(bounds[:-1], anchor + begin), np.minimum(bounds[1:] - window, anchor + stop)
                    some = np.flatnonzero(a <= b)
                    rows, place, a, b = pa.array(row + some), anchor[some], a[some], b[some]
                    shift = a - bounds[:-1][some]
                    core = mix(units.spans(place + stop, place + begin + window) ^ mix(gram[mine][some].view(np.uint64) + np.uint64(begin - low)))
                    content = digests(raw, a, b + window)
                    columns = {
                        "gram": pa.array(signed(core)),
                        "content": pa.array(content[:, 0] + (place - a)),
                        "check": pa.array(content[:, 1]),
                        "doc_id": batch.column("doc_id").take(rows),
                        "h": batch.column("h").take(rows),
                        "first": pa.array(first[mine][some] + shift),
                        "last": pa.array(first[mine][some] + shift + b - a),
                        # counted from where the next parts' windows may start
                        "at": pa.array((place + begin - low - a).astype(np.int32)),
                        "bytes": pa.array([raw[x:y] for x, y in zip(a.tolist(), (b + window).tolist(), strict=True)], pa.binary()),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run, step


def slices_of_bytes(column: pa.Array):
    flat = column.cast(pa.large_binary())
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    for row in range(0, len(flat), 4000):
        end = min(row + 4000, len(flat))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(copies, groups): the repeats of at least `length` bytes in two forms.

    copies: extents (doc_id, h, first, last, head) of equal content with their earliest place. groups: the maximal
    repeats among what is left, one row for each occurrence; a copied extent stands there by its head alone.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    texts = identified(docs)
    gram = min(gram, length)
    keys = repeated_keys(gram_keys(texts, _read, gram, length, gram, spark.sparkContext.broadcast([])))
    seen = spark.sparkContext.broadcast([(gram, Bloom.of(keys, "key"))])
    rows = materialise(texts.mapInArrow(_extents(length, gram, seen), EXTENT), "extents")
    sorted_ = classes(rows)
    copy = ("doc_id", "h", "first", "last", "head")
    copies = sorted_.members.select(*copy)
    heads = materialise(sorted_.heads, "heads")
    only = spark.sparkContext.broadcast(Bloom.of(heads.select("gram").distinct(), "gram"))
    detail = only_heads(texts.mapInArrow(_extents(length, gram, seen, only), DETAIL), heads)
    columns = ("gram", "doc_id", "h", "first", "last", "at", "bytes")
    level, groups, low, width = materialise(detail.select(*columns), "detail"), None, gram - length, length - gram + 1
    while True:
        hot = materialise(level.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > HOT).select("gram"), "hot")
        some_hot = width > 1 and hot.limit(1).count() > 0
        cold = level.join(hot, "gram", "left_anti") if some_hot else level
        found = cold.repartition("gram").sortWithinPartitions("gram").mapInArrow(_repeats_in(length), REPEAT)
        groups = found if groups is None else groups.unionByName(found)
        if not some_hot:
            return copies, groups
        cut, step = _parts(length, low, width)
        parts = materialise(level.join(hot, "gram", "left_semi").mapInArrow(cut, DETAIL), "parts")
        of_parts = classes(parts)
        copies = copies.unionByName(of_parts.members.select(*copy))
        level, width = materialise(only_heads(parts, of_parts.heads).select(*columns), "detail"), step


def _cut(some=None):
    """The digests of documents beside their spans; with `some`, a broadcast filter, those of the documents of (doc_id, key, text) that it doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if some:
                batch = batch.filter(pa.array(~some.value.might_hold(batch.column("key").to_numpy())))
            spans = None if some else batch.column(SPANS)
            out: list[list] = [[], [], [], [], []]
            for row, end, data, bounds in slices(batch.column("text")):
                for d in range(end - row):
                    raw = data[bounds[d] : bounds[d + 1]]
                    mine = spans[row + d].as_py() if spans else None
                    n, removed, runs, kept = len(raw), 0, 0, raw
                    if mine:
                        both = np.array([(s["start"], s["end"]) for s in mine], dtype=np.int64)
                        gone = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(gone, both[:, 0], 1)
                        np.add.at(gone, both[:, 1], -1)
                        cut = np.cumsum(gone)[:-1] > 0
                        removed, runs, kept = int(cut.sum()), int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()), raw[~cut]
                    for column, value in zip(out, (n, removed, runs, hashlib.sha256(kept.tobytes()).hexdigest(), kept.tobytes() if removed else None), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def without_earlier_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of docs (doc_id, text; others are not read).

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a document of
    smaller doc_id (null is smallest), or before it in the same one. kept holds the bytes that stay, or null where all do. A null text
    is empty. Rows of one doc_id with different texts are documents of their own, ordered by a hash of the text; rows that
    repeat both (null ids too) are one document, given once for each row. An empty table gives no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    place = F.struct("doc_id", "h", "first")
    with scratch(docs.sparkSession) as keep:
        copies, groups = repeat_groups(docs, length, gram)
        spans = copies.where(~place.eqNullSafe(F.col("head"))).select("doc_id", "h", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
        spans = spans.unionByName(groups.where(~F.col("earliest")).select("doc_id", "h", "start", (F.col("start") + F.col("length")).alias("end")))
        marked = Marked.of(spans, keep)
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    whole = texts.select("doc_id", Marked.key(texts).alias("key"), "text").mapInArrow(_cut(marked.some), out)
    return whole.unionByName(marked.beside(texts).mapInArrow(_cut(), out))
