"""Substring dedup on words by level-wise doubling.

Level 1 counts short grams at the anchors of all windows, level 2 grams of twice that length on either
side of the anchors that repeat, and so on up to the window's length: only what repeats at one
length is extended to the next, until nothing survives or the windows themselves are compared. Every
level is one grouped count, and the next one reads it as a Bloom filter of bounded size, which can only
let too much through; the last level, on whole windows, is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomspan.llm.hashing import Bloom, Windows, Words, digests, folded, ragged, signed, slices
from loomspan.llm.repeats import SPANS, Marked, classes, gram_keys, identified, only_heads, repeated_keys, surviving
from loomspan.session import materialise, scratch, small_arrow_batches

WINDOW = 35
GRAM = 9


def _read(data: np.ndarray, bounds: np.ndarray) -> tuple[Windows, np.ndarray]:
    words = Words(data, bounds)
    return Windows(words.hash), words.first


def _extents(window: int, gram: int, seen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                units, edges = Windows(words.hash), words.first
                found = surviving(units, edges, gram, window, seen.value)
                count = found.last - found.first + 1
                offsets, at = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), ragged(found.first, count)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(signed(each[at]) if len(at) else np.zeros(0, np.int64))) for each in (units.each(window), folded(words.second(), window))]
                content = digests(words.hash.tobytes(), 8 * found.first, 8 * (found.last + window))
                base, rows = edges[found.text], pa.array(row + found.text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(found.gram)),
                        pa.array(content[:, 0] + (found.anchor - found.first)),
                        pa.array(content[:, 1]),
                        batch.column("doc_id").take(rows),
                        batch.column("h").take(rows),
                        pa.array((found.first - base).astype(np.int64)),
                        pa.array((found.last - base).astype(np.int64)),
                        *lists,
                    ],
                    ["gram", "content", "check", "doc_id", "h", "first", "last", "windows", "again"],
                )

    return run


def repeated_word_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, h, start, end) word spans, in no order and maybe overlapping, that together are all windows of `window`
    words whose word sequence also starts anywhere else; h is the hash of the document's text."""
    spark = docs.sparkSession
    small_arrow_batches(spark)
    texts = identified(docs)
    gram = min(gram, window)
    seen, length = [], gram
    while True:
        repeated = repeated_keys(gram_keys(texts, _read, gram, window, length, spark.sparkContext.broadcast(seen)))
        seen = [*seen, (length, Bloom.of(repeated, "key"))]
        if 2 * length > window:
            break
        length *= 2
    rows = texts.mapInArrow(_extents(window, gram, spark.sparkContext.broadcast(seen)), "gram long, content long, check long, doc_id long, h long, first long, last long, windows array<long>, again array<long>")
    rows = materialise(rows, "extents")
    sorted_ = classes(rows)
    whole = sorted_.members.select("doc_id", "h", F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    each = only_heads(rows, sorted_.heads).select("n", "doc_id", "h", "first", F.posexplode(F.arrays_zip(F.col("windows").alias("w"), F.col("again").alias("w2"))).alias("k", "hashes"))
    each = materialise(each.select("n", "doc_id", "h", "first", "k", "hashes.w", "hashes.w2"), "windows")
    again = each.groupBy("w", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w", "w2")
    at = F.col("first") + F.col("k")
    single = each.where("n = 1").join(again, ["w", "w2"], "left_semi").select("doc_id", "h", at.alias("start"), (at + window).alias("end"))
    return whole.unionByName(single)


def _kept(raw: bytes, start: np.ndarray, end: np.ndarray, spans: list[dict]) -> tuple[bytes, int]:
    """(the words that no span covers, joined by one space, how many are covered) of a text with words [start, end)."""
    both = np.array([(s["start"], s["end"]) for s in spans], dtype=np.int64).reshape(-1, 2)
    gone = np.zeros(len(start) + 1, dtype=np.int64)
    np.add.at(gone, both[:, 0], 1)
    np.add.at(gone, both[:, 1], -1)
    keep = np.cumsum(gone)[:-1] == 0
    return b" ".join(raw[a:b] for a, b in zip(start[keep].tolist(), end[keep].tolist(), strict=True)), int((~keep).sum())


def _cut(some=None):
    """The digests of documents beside their spans; with `some`, a broadcast filter, those of the documents of (doc_id, key, text) that it doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if some:
                batch = batch.filter(pa.array(~some.value.might_hold(batch.column("key").to_numpy())))
            spans = None if some else batch.column(SPANS)
            counts, removed, digests = [], [], []
            for row, end, data, bounds in slices(batch.column("text")):
                words = Words(data, bounds)
                for d in range(end - row):
                    a, b = words.first[d], words.first[d + 1]
                    mine = spans[row + d].as_py() if spans else None
                    raw = data[bounds[d] : bounds[d + 1]].tobytes()
                    kept, cut = _kept(raw, words.start[a:b] - bounds[d], words.end[a:b] - bounds[d], mine) if mine else (b" ".join(raw.split()), 0)
                    counts.append(int(b - a))
                    removed.append(cut)
                    digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return run


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs (doc_id, text; others are not read).

    Every word covered by a window that also starts anywhere else is removed, in all its places; the digest is that of
    the words that stay, joined by one space. Null, empty and blank texts have no words. Every row is a text of its own: rows
    that repeat a doc_id (null too) are compared like any others, so a repeated row is a copy. An empty table gives no rows.
    """
    small_arrow_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with scratch(docs.sparkSession) as keep:
        marked = Marked.of(repeated_word_spans(texts, window, gram), keep)
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    whole = texts.select("doc_id", Marked.key(texts).alias("key"), "text").mapInArrow(_cut(marked.some), out)
    return whole.unionByName(marked.beside(texts).mapInArrow(_cut(), out))


@F.arrow_udf(StringType())
def _rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for row, end, data, bounds in slices(texts):
        words = Words(data, bounds)
        for d in range(end - row):
            a, b, at = words.first[d], words.first[d + 1], bounds[d]
            mine = spans[row + d].as_py()
            out.append(_kept(data[at : bounds[d + 1]].tobytes(), words.start[a:b] - at, words.end[a:b] - at, mine)[0].decode("utf-8", "replace") if mine else texts[row + d].as_py())
    return pa.array(out, pa.string())


def cut_repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs, all columns, whose text has lost its repeated windows; a text without any stays as it is, white space included.

    Every row is a text of its own, as in without_repeated_windows; null and empty texts and null doc_ids stay as they are.
    """
    with scratch(docs.sparkSession) as keep:
        marked = Marked.of(repeated_word_spans(docs, window, gram), keep)
    near = marked.beside(docs)
    cut = near.withColumn("text", F.when(F.col(SPANS).isNull(), F.col("text")).otherwise(_rest(F.col("text"), F.col(SPANS))))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.where(~marked.touched(docs)).select(*columns).union(cut.select(*columns))
