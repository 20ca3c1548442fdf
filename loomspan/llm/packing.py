"""Lexical retrieval packing into sequences of a fixed number of tokens.

One narrow pass tokenises every document. Whole runs of `size` tokens from its start are sequences of their
own; what is left, the tail, is packed with other tails. Tails are ordered by the rarest token ids that they share with any other
document, the terms that weigh most in BM25, and dealt to ranges of that order, which become shards of SHARD_ROWS: tails with
a rare term in common meet, whatever the number of shards, and a large group of copies fills shards of its own. Every shard holds a BM25
inverted index over token ids, with document frequencies and lengths of all documents. The next unused tail seeds a sequence; the index returns
its unused neighbours by score, which fill the window greedily; the last one is cut and the rest of it stays
unused. Only the last sequence of a shard has padding.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.hashing import give_back, ragged
from loomspan.session import materialise, small_arrow_batches

SIZE = 1024
SHARD_ROWS = 2000
RANGE_SHARDS = 4
K1, B = 1.2, 0.75
SLICE_CHARS = 1 << 22
VOCABULARY = 50_257

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Characters other than those whose kind (letter, digit, white space) their first byte tells.
_UNUSUAL = re.compile("[^\\t\\n\\r\x20-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018-\u201e\u2026\u20ac]")
#: The end of a text, white space, letters, digits, all else.
_END, _WHITE, _LETTER, _DIGIT, _OTHER = range(5)
_KIND = np.full(256, _OTHER, dtype=np.uint8)
_KIND[0] = _END
_KIND[list(b"\t\n\r ")] = _WHITE
_KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC3, 0xCA)]] = _LETTER
_KIND[ord("0") : ord("9") + 1] = _DIGIT


def pre_tokens(data: np.ndarray) -> np.ndarray:
    """Where the pre-tokens of texts without unusual characters start, and the end of the last one. data: UTF-8, a 0 after each text, which is a pre-token of its own.

    The tokenizer's pattern, in runs of one kind: a space before a run belongs to it, white space before that or at the end of a text stands alone, and
    a quote that opens a match takes the letters of a contraction with it.
    """
    kind = _KIND[data]
    later = np.flatnonzero((data & 0xC0) == 0x80)
    for _ in range(2):  # characters have three bytes at most
        kind[later] = kind[later - 1]
    cut = np.ones(len(data) + 1, dtype=bool)
    np.not_equal(kind[1:], kind[:-1], out=cut[1:-1])
    cut[:-1] |= kind == _END
    last = np.flatnonzero((kind[:-1] == _WHITE) & (kind[1:] > _WHITE))
    cut[last] = True
    cut[last[data[last] == ord(" ")] + 1] = False
    quote = np.flatnonzero(data == ord("'"))
    quote = quote[cut[quote] & (kind[quote + 1] == _LETTER)]
    first, second = data[quote + 1], data[quote + 2]
    one = np.isin(first, list(b"stmd"))
    two = (((first == ord("r")) | (first == ord("v"))) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
    cut[quote[one | two] + 1] = False
    cut[quote[one] + 2] = True
    cut[quote[two] + 3] = True
    return np.flatnonzero(cut)


class Tokenizer:
    """Token ids of whole texts with end_id after each, as little-endian 16-bit numbers. A byte-level BPE never joins two pre-tokens, so those of
    a slice of texts are told apart by Arrow, and the distinct ones are encoded in one call.

    Texts with characters outside the common Latin ones are encoded whole. ranks: the same vocabulary as
    merge ranks, which encodes several times faster; without it the tokenizer itself does.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str, end_id: int):
        self.end = np.array([end_id], dtype="<u2")
        if ranks:
            import tiktoken

            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
            sizes = {b: len(a) for a, b in table.items()}
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Fast

            fast = Fast.from_file(path)
            fast.encode_special_tokens = True
            encode = lambda text: fast.encode(text, add_special_tokens=False).ids
            sizes = {b: len(a) for a, b in fast.get_vocab().items()}  # a character for each byte
        self.encode = encode
        self.sizes = np.zeros(1 << 16, dtype=np.int64)  # bytes of each token
        self.sizes[list(sizes)] = list(sizes.values())

    def one(self, text: str) -> np.ndarray:
        return np.array(self.encode(text), dtype="<u2")

    def _distinct(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each pre-token begin and how many they are. In one text line feeds part pre-tokens that no space begins, and the bytes of its tokens tell
        which are whose; pre-tokens of white space and the end of texts stay out of it."""
        kind = _KIND[data[start]]
        alone = np.flatnonzero((kind == _END) | ((kind == _WHITE) & ((size == 1) | (_KIND[data[np.minimum(start + 1, len(data) - 1)]] == _WHITE))))
        apart = np.ones(len(start), dtype=bool)
        apart[alone] = False
        rest, length = start[apart], size[apart]
        end = np.cumsum(length + (data[rest] != ord(" ")))
        text = np.full(end[-1] if len(end) else 0, ord("\n"), dtype=np.uint8)
        text[ragged(end - length, length)] = data[ragged(rest, length)]
        ids = self.one(text.tobytes().decode())
        upto = np.concatenate(([0], np.cumsum(self.sizes[ids])))
        first, count = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        first[apart] = np.searchsorted(upto, end - length)
        count[apart] = np.searchsorted(upto, end) - first[apart]
        more = [self.one(data[start[k] : start[k] + size[k]].tobytes().decode()) if kind[k] else self.end for k in alone.tolist()]
        count[alone] = [len(x) for x in more]
        first[alone] = len(ids) + np.cumsum(count[alone]) - count[alone]
        return np.concatenate([ids, *more]), first, count

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        raw = "\0".join([*texts, ""]).encode()
        bounds = pre_tokens(np.frombuffer(raw, dtype=np.uint8))
        words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
        each, distinct = words.indices.to_numpy(), words.dictionary
        start = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[: len(distinct) + 1]
        data = np.frombuffer(distinct.buffers()[2], dtype=np.uint8)
        ids, first, count = self._distinct(data, start[:-1], np.diff(start))
        counts = count[each]
        is_end = data[start[:-1]] == 0
        return np.split(ids[ragged(first[each], counts)], np.cumsum(counts)[is_end[each]][:-1])

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        usual = [not _UNUSUAL.search(x) for x in texts]
        split = iter(self._split([x for x, u in zip(texts, usual, strict=True) if u]) if any(usual) else ())
        return [next(split) if u else np.append(self.one(x), self.end) for x, u in zip(texts, usual, strict=True)]


@lru_cache(maxsize=1)
def _tokenizer(path: str, ranks: str | None, pattern: str, end_id: int) -> Tokenizer:
    """One for all tasks of a worker process."""
    return Tokenizer(path, ranks, pattern, end_id)


def _slices(ids: list, texts: list[str]) -> Iterator[tuple[list, list[str]]]:
    """Runs of whole rows of about SLICE_CHARS characters."""
    first, held = 0, 0
    for k, text in enumerate(texts, 1):
        held += len(text)
        if held >= SLICE_CHARS or k == len(texts):
            yield ids[first:k], texts[first:k]
            first, held = k, 0


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _tokenised(path: str, ranks: str | None, pattern: str, size: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path, ranks, pattern, end_id)
        sequence = (TaskContext.get().partitionId() << 36) + (1 << 35)
        seen, docs, total = np.zeros(VOCABULARY, dtype=np.int64), 0, 0
        kinds = [pa.int64()] * 6 + [pa.binary(), pa.binary()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "tail", "seen"]
        for batch in batches:
            out: list[tuple] = []
            rows = _slices(batch.column(0).to_pylist(), [x or "" for x in batch.column(1).to_pylist()])
            for doc_id, ids in ((d, x) for docs_, texts in rows for d, x in zip(docs_, encode(texts), strict=True)):
                seen[ids] += 1  # once for each distinct id
                docs += 1
                total += len(ids)
                for start in range(0, len(ids) - size + 1, size):
                    out.append((doc_id, start, size, _crc(ids[start : start + size]), len(ids), sequence, None, None))
                    sequence += 1
                if rest := len(ids) % size:
                    out.append((doc_id, len(ids) - rest, rest, None, len(ids), None, ids[len(ids) - rest :].tobytes(), None))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        if docs:
            give_back()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((None, docs, total, None, None, None, None, seen.astype("<i4").tobytes()), kinds, strict=True)], names)

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(VOCABULARY, dtype=np.int64)
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total += np.frombuffer(x, dtype="<i4")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])


class Index:
    """BM25 over the tails of a shard: postings of every token id, with precomputed impacts."""

    def __init__(self, tails: list[np.ndarray], idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in tails])
        doc = np.repeat(np.arange(len(tails)), sizes)
        flat = np.concatenate(tails).astype(np.int64)
        key, tf = np.unique(flat * len(tails) + doc, return_counts=True)
        self.term, self.doc = key // len(tails), key % len(tails)
        self.impact = idf[self.term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[self.doc] / mean))
        self.first = np.searchsorted(self.term, np.arange(VOCABULARY + 1))
        self.n = len(tails)

    def neighbours(self, tail: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """The score of every tail over all token ids of `tail`, -1 for used ones."""
        terms = np.unique(tail)
        size = self.first[terms + np.uint16(1)] - self.first[terms]
        at = np.arange(size.sum()) + np.repeat(self.first[terms] - np.cumsum(size) + size, size)
        score = np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        score[~unused] = -1.0
        return score


def pack_shard(tails: list[np.ndarray], idf: np.ndarray, mean: float, size: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(tail, start in it, length, sequence, offset) of all pieces of the tails of a shard."""
    if not tails:
        return
    index = Index(tails, idf, mean)
    begin, unused = np.zeros(len(tails), dtype=np.int64), np.ones(len(tails), dtype=bool)
    sizes = np.array([len(t) for t in tails])
    sequence = 0
    for seed in range(len(tails)):
        if not unused[seed]:
            continue
        unused[seed] = False
        room = size - int(sizes[seed] - begin[seed])
        yield seed, int(begin[seed]), int(sizes[seed] - begin[seed]), sequence, 0
        if room:
            score = index.neighbours(tails[seed], unused)
            while room:
                best = int(np.argmax(score))
                if score[best] < 0:
                    break
                score[best] = -1.0
                take = min(room, int(sizes[best] - begin[best]))
                yield best, int(begin[best]), take, sequence, size - room
                begin[best] += take
                unused[best] = begin[best] < sizes[best]
                room -= take
        sequence += 1


def rarest(tail: np.ndarray, frequency: np.ndarray) -> int:
    """The three token ids of a tail that fewest documents hold, but at least two, as one number; the rarest stands first."""
    ids = np.unique(tail)
    ids = ids[frequency[ids] > 1]
    first = ids[np.argsort(frequency[ids], kind="stable")[:3]].tolist()
    return sum(int(t) << 16 * (2 - k) for k, t in enumerate(first))


def _placed(sent):
    """Tails with the number that places them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, frequency = sent.value
        for batch in batches:
            place = [rarest(np.frombuffer(x, dtype="<u2"), frequency) for x in batch.column("tail").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "place"])

    return run


def _pack(sent, size: int):
    """The tails of a range, in the order of their places, in shards of SHARD_ROWS."""

    def pieces(shard: pa.Table, sequence: int) -> tuple[pa.RecordBatch, int]:
        ids, starts, totals = (shard.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        tails = [np.frombuffer(x, dtype="<u2") for x in shard.column("tail").to_pylist()]
        idf, mean, _ = sent.value
        out = [(ids[t], starts[t] + s, n, _crc(tails[t][s : s + n]), totals[t], sequence + q, o) for t, s, n, q, o in pack_shard(tails, idf, mean, size)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names), max(x[5] for x in out) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, held = TaskContext.get().partitionId() << 36, pa.table({})
        for batch in batches:
            held = pa.concat_tables([held, pa.Table.from_batches([batch])]) if held.num_columns else pa.Table.from_batches([batch])
            while held.num_rows >= SHARD_ROWS:
                out, sequence = pieces(held.slice(0, SHARD_ROWS), sequence)
                held = held.slice(SHARD_ROWS)
                yield out
        if held.num_rows:
            yield pieces(held, sequence)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, ranks: str | None, pattern: str, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) that hold every token id of docs exactly once.

    tokenizer: a byte-level BPE file that every executor can read; ranks: the same vocabulary as merge ranks, or None;
    pattern: its pre-token pattern. A document is its ids followed by end_id; a null or
    empty text is end_id alone. Only doc_id and text are read; repeated and null doc_ids are documents of their own. An
    empty table gives no rows. Tails are ordered by their terms, their content and doc_id.
    """
    spark = docs.sparkSession
    small_arrow_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, tail binary, seen binary"
    cut = materialise(texts.mapInArrow(_tokenised(tokenizer, ranks, pattern, size, end_id), schema), "pieces")
    counts = cut.where("seen IS NOT NULL")
    total = counts.agg(F.sum("start"), F.sum("length")).first()
    documents, tokens = int(total[0] or 0), int(total[1] or 0)
    frequency = np.zeros(VOCABULARY)
    for r in counts.select("seen").mapInArrow(_frequencies, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row for each id of the vocabulary
        frequency[r["id"]] = r["n"]
    idf = np.log(1 + (documents - frequency + 0.5) / (frequency + 0.5))
    sent = spark.sparkContext.broadcast((idf, max(1.0, min(size / 2, tokens / max(1, documents))), frequency))
    tails = cut.where("tail IS NOT NULL").select("doc_id", "start", "doc_tokens", "tail")
    placed = "doc_id long, start long, doc_tokens long, tail binary, place long"
    placed = materialise(tails.mapInArrow(_placed(sent), placed).withColumn("salt", F.xxhash64("doc_id", "tail")), "tails")
    ranges = placed.repartitionByRange(max(1, -(-documents // (RANGE_SHARDS * SHARD_ROWS))), "place", "salt")
    packed = ranges.sortWithinPartitions("place", "salt", "doc_id", "start").mapInArrow(_pack(sent, size), PIECE)
    whole = cut.where("sequence_id IS NOT NULL").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
