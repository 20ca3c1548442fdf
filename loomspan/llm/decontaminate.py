"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and the units that follow numbers are replaced by typed placeholders, other
words are lower-cased. A capitalised word is a name wherever it stands; adjoining names are one placeholder, and so are the
groups of a number such as 1,000 or 3.5. Windows of template words are hash-joined with those of the benchmark items. A document
holds an item if its windows cover at least the threshold's share of the item's template words in one alignment and the slots
agree: fillers of the item and of the document answer each other one to one, within their kind, so that
a question with other numbers and names is still caught, and one with the same phrasing only by chance is not.

The benchmark is a stated query set: its windows come in blocks of at most BLOCK_WINDOWS, each broadcast
to a narrow map over the documents. No document leaves its task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.hashing import Windows, Words, slices
from loomspan.session import materialise, small_arrow_batches

WIDTH = 5
SHARE = 80
CONSISTENT = 80
BLOCK_WINDOWS = 1 << 20
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles g kg mg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons "
    "l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degree degrees mph kph km2 m2 m3"
).split()

_CLASSES = np.zeros(256, dtype=np.uint8)
_CLASSES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_GLYPH = np.ones(256, dtype=bool)
_GLYPH[list(b" \t\n\r\f\v")] = False
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0xA11CE0000000001D, 0xA11CE0000000002D, 0xA11CE0000000003D))


@dataclass
class Template:
    """Template words of a slice: `code` with placeholders, `filler` as written, `slot` where they differ, the first `word` of each, and the bounds of each text; and
    the hashes of all words as written with their bounds."""

    code: np.ndarray
    filler: np.ndarray
    slot: np.ndarray
    word: np.ndarray
    first: np.ndarray
    raw: np.ndarray
    raw_first: np.ndarray


_unit_hashes: list[np.ndarray] = []


def _units() -> np.ndarray:
    if not _unit_hashes:
        raw = " ".join(UNITS).encode()
        _unit_hashes.append(np.sort(Words(np.frombuffer(raw, dtype=np.uint8), np.array([0, len(raw)]), lower=True, classes=_CLASSES).hash))
    return _unit_hashes[0]


def templates(data: np.ndarray, bounds: np.ndarray) -> Template:
    words = Words(data, bounds, lower=True, classes=_CLASSES)
    if not len(words.hash):
        return Template(words.hash, words.hash, np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64), words.first, words.hash, words.first)
    first = data[words.start]
    number = _DIGIT[first]
    name = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (data[np.minimum(words.start + 1, len(data) - 1)] <= 0x9E))
    unit = np.zeros(len(number), dtype=bool)
    unit[1:] = number[:-1]
    unit &= np.isin(words.hash, _units()) & ~number
    code = np.where(number, NUMBER, np.where(name, NAME, np.where(unit, UNIT, words.hash)))
    glyphs = np.concatenate([[0], np.cumsum(_GLYPH[data])])
    before, after = words.end[:-1], words.start[1:]
    spaced = glyphs[before] == glyphs[after]
    grouped = (after - before == 1) & np.isin(data[before], list(b".,"))
    joined = np.zeros(len(number), dtype=bool)
    joined[1:] = name[1:] & name[:-1] & spaced | number[1:] & number[:-1] & grouped
    joined[words.first[:-1][np.diff(words.first) > 0]] = False
    word = np.flatnonzero(~joined)
    nth = np.arange(len(joined)) - np.repeat(word, np.diff(np.append(word, len(joined))))
    filler = np.add.reduceat(words.hash * (2 * nth + 1).astype(np.uint64), word)
    kept = np.concatenate([[0], np.cumsum(~joined)])
    return Template(code[word], filler, (number | name | unit)[word], word, kept[words.first], words.hash, words.first)


def windows(t: Template, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of every window of `width` template words that lies in one text; one of placeholders alone is taken as written."""
    h = Windows(t.code).each(width)
    slots = np.concatenate([[0], np.cumsum(t.slot)])
    bare = slots[width:] - slots[:-width] == width
    if bare.any():
        h = np.where(bare, Windows(t.filler).each(width), h)
    start = np.arange(len(h))
    text_end = np.repeat(t.first[1:], np.diff(t.first))[: len(h)]
    inside = start + width <= text_end
    return start[inside], h[inside]


@dataclass
class Block:
    """Windows of some benchmark items, sorted by hash, with their item and place, and the items' templates."""

    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    mask: np.ndarray
    ids: list[int]
    fillers: list[np.ndarray]
    kinds: list[np.ndarray]
    slots: list[np.ndarray]
    sizes: np.ndarray
    #: items of fewer template words than a window: length in words -> words -> items
    short: dict[int, dict[bytes, list[int]]]

    @classmethod
    def of(cls, items: pa.Table, width: int) -> Block:
        ids, fillers, kinds, slots, sizes, hashes, owner, place = [], [], [], [], [], [], [], []
        short: dict[int, dict[bytes, list[int]]] = {}
        for row, end, data, bounds in slices(items.column("text")):
            t = templates(data, bounds)
            start, h = windows(t, width)
            text = np.searchsorted(t.first, start, side="right") - 1
            base = len(ids)
            for k in range(end - row):
                ids.append(items.column("item_id")[row + k].as_py())
                fillers.append(t.filler[t.first[k] : t.first[k + 1]].copy())
                kinds.append(t.code[t.first[k] : t.first[k + 1]].copy())
                if 0 < len(fillers[-1]) < width:
                    words = t.raw[t.raw_first[k] : t.raw_first[k + 1]]
                    short.setdefault(len(words), {}).setdefault(words.tobytes(), []).append(len(ids) - 1)
                slots.append(t.slot[t.first[k] : t.first[k + 1]].copy())
            sizes.append(np.bincount(text, minlength=end - row))
            hashes.append(h)
            owner.append(base + text)
            place.append(start - t.first[text])
        flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
        h = flat(hashes, np.uint64)
        order = np.argsort(h, kind="stable")
        mask = np.zeros(1 << 22, dtype=bool)
        mask[h >> np.uint64(42)] = True
        return cls(h[order], flat(owner, np.int64)[order], flat(place, np.int64)[order], mask, ids, fillers, kinds, slots, flat(sizes, np.int64), short)


def _agreement(item_filler: np.ndarray, doc_filler: np.ndarray, kind: np.ndarray) -> tuple[int, int]:
    """(slots, those that agree) of an aligned item and document: pairs of fillers count, the most frequent first, whose
    two sides answer no other filler of their kind; on a tie equal ones go first."""
    pairs: dict[tuple[int, int, int], int] = defaultdict(int)
    for k, a, b in zip(kind.tolist(), item_filler.tolist(), doc_filler.tolist(), strict=True):
        pairs[k, a, b] += 1
    left, right, agreeing = set(), set(), 0
    for (k, a, b), n in sorted(pairs.items(), key=lambda x: (-x[1], x[0][1] != x[0][2], x[0])):
        if (k, a) not in left and (k, b) not in right:
            left.add((k, a))
            right.add((k, b))
            agreeing += n
    return len(item_filler), agreeing


def held_items(data: np.ndarray, bounds: np.ndarray, block: Block, width: int, share: int, consistent: int) -> Iterator[tuple]:
    """(text, item, word, windows, matched, slots, agreeing) of the items that the texts of a slice hold."""
    t = templates(data, bounds)
    for n, items in block.short.items():
        if len(t.raw) < n:
            continue
        runs = np.sort([Windows(np.frombuffer(words, dtype=np.uint64)).each(n)[0] for words in items])
        h = Windows(t.raw).each(n)
        for at in np.flatnonzero(runs[np.minimum(np.searchsorted(runs, h), len(runs) - 1)] == h).tolist():
            d = int(np.searchsorted(t.raw_first, at, side="right")) - 1
            if at + n <= t.raw_first[d + 1]:
                for k in items.get(t.raw[at : at + n].tobytes(), ()):
                    yield d, k, at - int(t.raw_first[d]), 0, 0, 0, 0
    start, h = windows(t, width)
    likely = np.flatnonzero(block.mask[h >> np.uint64(42)])
    low = np.searchsorted(block.hash, h[likely], side="left")
    count = np.searchsorted(block.hash, h[likely], side="right") - low
    at = np.repeat(likely, count)
    if not len(at):
        return
    hit = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    text = np.searchsorted(t.first, start[at], side="right") - 1
    item, shift = block.item[hit], start[at] - block.place[hit]
    # shifts within one item's length of each other belong to one copy, whose words may have moved by an insertion
    order = np.lexsort((shift, item, text))
    text, item, shift, place = text[order], item[order], shift[order], block.place[hit][order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (np.diff(shift) > width)
    edges = np.append(np.flatnonzero(fresh), len(text))
    length = np.array([len(x) for x in block.fillers])
    many = (np.diff(edges) * width * 100 >= share * length[item[edges[:-1]]]).nonzero()[0]
    for g in many.tolist():
        a, b = edges[g], edges[g + 1]
        k, d = int(item[a]), int(text[a])
        values, counts = np.unique(shift[a:b], return_counts=True)
        best = int(values[np.argmax(counts)])
        # every covered word of the item answers to the document's word in the most usual shift of those that cover it
        answer = np.full(length[k], -1)
        for v in values[np.argsort(counts, kind="stable")].tolist():
            covered = (place[a:b][shift[a:b] == v][:, None] + np.arange(width)).ravel()
            answer[covered] = covered + v
        at_item = np.flatnonzero(answer >= 0)
        if len(at_item) * 100 < share * length[k]:
            continue
        at_item = at_item[block.slots[k][at_item]]
        slots, agreeing = _agreement(block.fillers[k][at_item], t.filler[answer[at_item]], block.kinds[k][at_item])
        if agreeing * 100 >= consistent * slots:
            low_word, begin = max(best, int(t.first[d])), int(t.first[d])
            yield d, k, int(t.word[low_word] - t.word[begin]), int(block.sizes[k]), len(np.unique(place[a:b])), slots, agreeing


HIT = "doc_id long, item_id long, word long, windows long, matched long, slots long, agreeing long"


def _blocks(benchmark: DataFrame, width: int) -> Iterator[Block]:
    """The items in blocks of about BLOCK_WINDOWS windows, by their hash."""
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (2 * BLOCK_WINDOWS)))
    for b in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Block.of(mine.orderBy("item_id", "text").toArrow(), width)  # bounded by BLOCK_WINDOWS


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, consistent: int = CONSISTENT) -> DataFrame:
    """One row (doc_id, item_id, word, windows, matched, slots, agreeing) for each document and benchmark item it holds.

    docs needs doc_id and text, benchmark item_id and text; other columns are not read. Items of fewer than `width`
    template words are held by the texts in which all their words, as written, stand in a row; such rows count no windows. Null, empty and wordless texts
    on either side match nothing. Repeated items and documents (null ids too) are separate rows; a document that
    holds an item twice gives one row, its first place. Either table may be empty. A benchmark of several blocks takes one pass for each.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts: list[DataFrame] = []
    last = None
    for block in _blocks(benchmark, width):
        if last:  # one block is broadcast at a time
            parts[-1] = materialise(parts[-1], "contaminated")
            last.unpersist()
        last = spark.sparkContext.broadcast(block)
        parts.append(texts.mapInArrow(_search(last, width, share, consistent), HIT))
    return reduce(DataFrame.union, parts)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = SHARE, consistent: int = CONSISTENT) -> DataFrame:
    """The rows of docs, all columns, that hold no item as contaminated() finds them; ids are not read, so null and repeated ones don't matter.

    One block of the benchmark is broadcast at a time; between two blocks the rows left are written. No row leaves its task.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    last = None
    for block in _blocks(benchmark, width):
        if last:
            docs = materialise(docs, "uncontaminated")
            last.unpersist()
        last = spark.sparkContext.broadcast(block)
        docs = docs.where(~_holds(last, width, share, consistent)(F.col("text").cast("string")))
    return docs


def _holds(sent, width: int, share: int, consistent: int):
    @F.arrow_udf("boolean")
    def holds(texts: pa.Array) -> pa.Array:
        found = np.zeros(len(texts), dtype=bool)
        for row, _, data, bounds in slices(texts):
            for d, *_ in held_items(data, bounds, sent.value, width, share, consistent):
                found[row + d] = True
        return pa.array(found)

    return holds


def _search(sent, width: int, share: int, consistent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, _, data, bounds in slices(batch.column("text")):
                seen = set()
                for d, k, *rest in held_items(data, bounds, sent.value, width, share, consistent):
                    if (d, k) not in seen:
                        seen.add((d, k))
                        out.append((batch.column("doc_id")[row + d].as_py(), sent.value.ids[k], *rest))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "word", "windows", "matched", "slots", "agreeing"])

    return run
