"""URL filtering: host and path rules, and a Bloom filter cascade over the corpus's own keys.

The cascade is exact on every key it was built with. Level 1 is a Bloom filter of the listed keys;
level 2 holds the unlisted keys of the corpus that level 1 lets through; level 3 the listed keys
that level 2 lets through, and so on until no key is misjudged. A key is then judged by the first
level that rejects it. Nothing is joined: each page's key is hashed and tested in place.

Keys are dealt to blocks by their hash, so that one block's filters stay under MAX_BITS; the blocks
are built and applied one after the other, whatever the number of listed keys, and a block's filters are
dropped before the next one's are sent. Only the filters reach the driver, and only they are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from loomspan.session import materialise, small_arrow_batches

BITS_PER_KEY = (12, 6)
PROBES = (8, 4)
MAX_BITS = 1 << 26
MAX_LEVELS = 40


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both are '' for null and for a url without '://'."""
    rest = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(rest(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), rest(2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _shifts(level: int, probes: int) -> list[tuple[int, int]]:
    """How far the two hashes of a key are shifted for each probe; every level probes elsewhere."""
    return [((7 * (i + 3 * level)) % 38, (11 * (i + 5 * level)) % 37) for i in range(probes)]


def _positions(h1: np.ndarray, h2: np.ndarray, bits: int, level: int, probes: int) -> list[np.ndarray]:
    a, b = h1.astype(np.int64).view(np.uint64), h2.astype(np.int64).view(np.uint64)
    return [((a >> np.uint64(x)) ^ (b >> np.uint64(y))) & np.uint64(bits - 1) for x, y in _shifts(level, probes)]


class Level:
    """One Bloom filter of a power of two bits."""

    def __init__(self, words: np.ndarray, bits: int, level: int, probes: int):
        self.words, self.bits, self.level, self.probes = words, bits, level, probes

    def lets_through(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.ones(len(h1), dtype=bool)
        for p in _positions(h1, h2, self.bits, self.level, self.probes):
            out &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


class Cascade:
    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        answer = np.full(len(h1), len(self.levels) % 2 == 1)
        alive = np.ones(len(h1), dtype=bool)
        for k, level in enumerate(self.levels):
            through = level.lets_through(h1, h2)
            answer[alive & ~through] = k % 2 == 1
            alive &= through
        return answer


def _level(keys: DataFrame, count: int, k: int) -> Level:
    """Bits are set by a grouped bit_or, so that only one filter's words come back to the driver."""
    bits = 1 << max(10, (BITS_PER_KEY[min(k, 1)] * count - 1).bit_length())
    probes = PROBES[min(k, 1)]
    probe = [F.shiftrightunsigned("h1", x).bitwiseXOR(F.shiftrightunsigned("h2", y)).bitwiseAND(F.lit(bits - 1)) for x, y in _shifts(k, probes)]
    spots = keys.select(F.explode(F.array(*probe)).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    got = words.toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return Level(out, bits, k, probes)


def _tester(sent):
    @F.pandas_udf(BooleanType())
    def test(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(sent.value.listed(h1.to_numpy(), h2.to_numpy()))

    return test


def build_cascade(keys: DataFrame) -> Cascade:
    """The cascade of keys (h1, h2, listed), which must be distinct and materialised."""
    levels: list[Level] = []
    wrong = keys.where("listed")
    others = keys.where("not listed")
    while (count := wrong.count()) > 0:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("a listed and an unlisted key share 128 hash bits")
        levels.append(_level(wrong, count, len(levels)))
        test = _tester(keys.sparkSession.sparkContext.broadcast(Cascade(levels[-1:])))
        wrong, others = others.where(test("h1", "h2")), wrong
        wrong = materialise(wrong, "cascade")
    return Cascade(levels)


def listed_in_cascade(rows: DataFrame, key: str, listed: DataFrame, into: str) -> DataFrame:
    """rows with the boolean column `into`: is its key one of the column `key` of the table `listed`.

    The key universe is the distinct keys of rows; a hot key is one row of it after the partial aggregate, and only these
    meet the list. A null key is never listed; repeated and null keys of the list, and those that no row has, change nothing. No
    listed keys: nothing is listed.
    """
    spark = rows.sparkSession
    small_arrow_batches(spark)
    h1, h2 = F.xxhash64(F.col(key)), F.xxhash64(F.lit(7), F.col(key))
    own = rows.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct()
    marks = listed.select(F.col(key).alias("k")).where("k IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    hashes = (F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"))
    universe = materialise(own.join(marks, "k", "left").select(*hashes, F.coalesce("listed", F.lit(False)).alias("listed")), "keys")
    blocks = max(1, -(-universe.where("listed").count() * BITS_PER_KEY[0] // (MAX_BITS // 2)))
    answer = None
    for b in range(blocks):
        sent = spark.sparkContext.broadcast(build_cascade(universe.where(F.pmod("h1", F.lit(blocks)) == b)))
        mine = rows if blocks == 1 else rows.where(F.coalesce(F.pmod(h1, F.lit(blocks)), F.lit(0)) == b)
        judged = mine.withColumn(into, F.col(key).isNotNull() & _tester(sent)(h1, h2))
        if blocks > 1:
            judged = materialise(judged, "judged")
            sent.unpersist()
        answer = judged if answer is None else answer.union(judged)
    return answer


def blocked_keys(keys: DataFrame, rules: list[Rule], listed: DataFrame | None = None) -> DataFrame:
    """(key): the distinct keys among `keys` (host, path, key) that a rule blocks, and those that no rule fits and that `listed` (key) holds."""
    verdict = longest_rule(F.col("host"), F.col("path"), rules)["verdict"]
    own = keys.select("key", verdict.alias("verdict")).distinct()
    blocked = own.where("verdict = 'block'").select("key")
    if listed is None:
        return blocked
    return blocked.union(own.where("verdict IS NULL").join(listed.select("key").distinct(), "key", "left_semi").select("key"))


def judge_urls(pages: DataFrame, rules: list[Rule], listed: DataFrame | None = None, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages.

    The cascade learns the corpus's blocked keys, those that the rules block and those of the table `listed` (key: host and path) that no rule fits, on the distinct keys of pages;
    it gives the verdict of every row, and the rules only the name. Of rules that fit, the one of most characters counts, and of equally long ones the last by name. A null
    url has an empty host and path. Repeated and null ids and repeated urls are separate rows; other columns of pages are not read. An empty table gives no rows.
    """
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("key", F.concat("host", "path"))
    judged = listed_in_cascade(rows, "key", blocked_keys(rows, rules, listed), "in_list")
    verdict = F.when(F.col("in_list"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", longest_rule(F.col("host"), F.col("path"), rules)["rule"].alias("rule"), verdict.alias("verdict"))
