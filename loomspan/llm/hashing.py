"""Word and window hashes of whole Arrow batches with numpy, and bounded Bloom filters of such hashes.

A slice of a batch is one run of bytes; nothing here loops over words. A word's hash is the sum of a random value for
each of its bytes and their places. Runs of units have polynomials modulo 2**64 over random unit values, read off prefix sums: the hash of
units [i, j) costs a subtraction and a product whatever its length. A mixer spreads the result over all bits.

Such a polynomial loses bits on long runs of two alternating units, so runs that it calls equal are only candidates: what decides an
answer is also held against a second hash of another kind, `folded` or `digests`.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 19
MAX_BLOOM_BITS = 1 << 26
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UNITS = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that makes every bit depend on every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Windows:
    """Prefix sums over hashed units, from which any window's hash is read."""

    def __init__(self, units: np.ndarray):
        self.n = len(units)
        up, self.down = _powers(1 << max(19, self.n.bit_length()))
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(units * up[: self.n], out=self.sums[1:])

    def each(self, length: int) -> np.ndarray:
        """The hash of every window of `length` units, by its start."""
        if self.n < length:
            return np.zeros(0, dtype=np.uint64)
        out = self.sums[length:] - self.sums[:-length]
        out *= self.down[: len(out)]
        return mix(out)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of units [start, end); different lengths give different hashes."""
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * _UNITS[7])


def folded(units: np.ndarray, length: int) -> np.ndarray:
    """A second hash of every window of `length` units: halves are mixed at every doubling, so that no sum over the window is involved."""
    if len(units) < length:
        return np.zeros(0, dtype=np.uint64)
    out, span = mix(units ^ _UNITS[11]), 1
    while span < length:
        step = min(span, length - span)
        left, right = out[: len(out) - step], out[step:]
        out = mix(left * _UNITS[13] + (right ^ (right >> np.uint64(32))))
        span += step
    return out


def digests(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two columns of 64 bits each: a cryptographic digest of the bytes [start, end) of raw, for each of the (few) runs."""
    found = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(found, dtype=np.int64).reshape(-1, 2)


class Words:
    """The words of a slice of texts: byte bounds, 64-bit hashes, and the words [first[d], first[d + 1]) of text d.

    A word is a run of bytes of one class; class 0 separates. Without `classes` all bytes but white space are of one class.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False, classes: np.ndarray | None = None):
        word = ~_IS_SEPARATOR[data] if classes is None else classes[data]
        edge = np.empty(len(data) + 1, dtype=bool)
        edge[1:-1] = word[1:] != word[:-1]
        edge[0] = edge[-1] = True
        edge[bounds] = True
        cuts = np.flatnonzero(edge)
        inside = word[cuts[:-1]].astype(bool) if len(data) else np.zeros(0, dtype=bool)
        self.start, self.end = cuts[:-1][inside], cuts[1:][inside]
        place = np.arange(len(data)) - np.repeat(cuts[:-1], np.diff(cuts))
        self._values = mix((place.astype(np.uint64) << np.uint64(8)) | (_LOWER[data] if lower else data))
        self.hash = self._sums(self._values)
        self.first = np.searchsorted(self.start, bounds)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        upto = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values, out=upto[1:])
        return mix(upto[self.end] - upto[self.start])

    def second(self) -> np.ndarray:
        """Another hash of every word, independent of the first."""
        return self._sums(mix(self._values ^ _UNITS[17]))


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of whole texts of about `limit` bytes; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    if not len(flat):
        return
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1]
    data = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(flat):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """The C library's own call for it, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker lives for many stages, and would else hold the most that any batch took."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Runs of whole groups of `key`, of about `least` rows, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        all_ = pa.Table.from_batches(held)
        keys = all_.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield all_.slice(0, cut)
            held, rows = all_.slice(cut).to_batches(), all_.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held)
    give_back()


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(count) - count
    return np.arange(total, dtype=np.int64) + np.repeat(start - before, count)


class Bloom:
    """A Bloom filter of 64-bit hashes with at most MAX_BLOOM_BITS bits, whatever the number of keys.

    Beyond its size it only lets more keys through, which later exact steps drop.
    """

    PROBES = 3

    def __init__(self, words: np.ndarray):
        self.words = words

    def might_hold(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), dtype=bool)
        h = h.view(np.uint64)
        mask = np.uint64(len(self.words) * 64 - 1)
        for i in range(self.PROBES):
            p = (h >> np.uint64(19 * i)) & mask
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Bloom:
        """Bits are set by a grouped bit_or, so that only the filter itself comes to the driver."""
        bits = 1 << min(MAX_BLOOM_BITS.bit_length() - 1, max(12, (16 * keys.count()).bit_length()))
        spots = keys.select(F.explode(F.array(*[F.shiftrightunsigned(key, 19 * i).bitwiseAND(F.lit(bits - 1)) for i in range(cls.PROBES)])).alias("p"))
        got = spots.groupBy(F.shiftright("p", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
        words = np.zeros(bits // 64, dtype=np.uint64)
        words[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
        return cls(words)
