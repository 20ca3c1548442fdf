"""Conversation repair as a min-plus matrix scan.

A good conversation is nothing, or an optional system turn and then questions and answers in turn: an automaton of the states START, BRIEFED, ASKED and ANSWERED.
A turn is a 4 x 4 matrix over the semiring of (cost, audit) pairs, where a sum is the lesser pair and a product adds costs and joins audits: entry (i, j) is the cheapest way
from state i to state j past this turn, insertions before it included (the closure of the insert matrix). Two audits of one cost for the same turns never begin one
another, as only insertions could differ and these cost; so the lesser pair stays the lesser whatever follows, and products may be formed in any grouping.

Turns are range-partitioned by conversation and turn and written in order. Chunks of CHUNK consecutive turns become one matrix for each conversation that they hold, and the matrices of
longer conversations are multiplied in rounds of FAN neighbours across the cluster. Audits are cut into the chunks' shares again and travel beside the turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import materialise, small_arrow_batches

CHUNK_BITS = 9
FAN = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, BRIEFED, ASKED, ANSWERED = range(4)
FINAL = (START, ANSWERED)
MOVES = {(START, "s"): BRIEFED, (START, "u"): ASKED, (BRIEFED, "u"): ASKED, (ASKED, "a"): ANSWERED, (ANSWERED, "u"): ASKED}
#: The role that an inserted or changed turn gets in each state, and the state after it.
ROLES = ("user", "user", "assistant", "user")
NEXT = tuple(MOVES[s, ROLES[s][0]] for s in range(4))
LEGAL = frozenset({("s", "u"), ("u", "a"), ("a", "u")})
NOTHING = hashlib.sha256(b"").hexdigest()

Entry = tuple[int, str] | None
Matrix = tuple[Entry, ...]
IDENTITY: Matrix = tuple((0, "") if i == j else None for i in range(4) for j in range(4))


def plus(a: Entry, b: Entry) -> Entry:
    return a if b is None else b if a is None else min(a, b)


def times(a: Matrix, b: Matrix) -> Matrix:
    out: list[Entry] = []
    for i in range(0, 16, 4):
        for j in range(4):
            best: Entry = None
            for k in range(4):
                x, y = a[i + k], b[4 * k + j]
                if x is not None and y is not None:
                    found = (x[0] + y[0], x[1] + y[1])
                    if best is None or found < best:
                        best = found
            out.append(best)
    return tuple(out)


def product(matrices: list[Matrix]) -> Matrix:
    """The product in order, as a balanced tree."""
    while len(matrices) > 1:
        matrices = [times(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0] if matrices else IDENTITY


def _closure() -> Matrix:
    once: Matrix = tuple((INSERT, "I") if NEXT[i] == j else None for i in range(4) for j in range(4))
    out = power = IDENTITY
    for _ in range(3):  # longer walks pass a state twice
        power = times(power, once)
        out = tuple(plus(a, b) for a, b in zip(out, power, strict=True))
    return out


INSERTS = _closure()


@lru_cache(maxsize=10_000)
def turn_matrix(initial: str, fault: str) -> Matrix:
    """The matrix of a turn whose role begins with `initial`; fault: "b"lank, "d"uplicate, "t"runcated or none."""
    own: dict[tuple[int, int], Entry] = {}
    for s in range(4):
        ways = [(s, (DELETE, "D"))]
        if fault not in ("b", "d"):
            more = TRUNCATED if fault == "t" else 0
            ways.append((NEXT[s], (REROLE + more, "R")))
            if (s, initial) in MOVES:
                ways.append((MOVES[s, initial], (KEEP + more, "K")))
        for to, entry in ways:
            own[s, to] = plus(own.get((s, to)), entry)
    return times(INSERTS, tuple(own.get((i, j)) for i in range(4) for j in range(4)))


PART = "conv_id long, chunk long, cost array<long>, audit array<string>, illegal long, first string, last string, chunks array<long>, sizes array<int>"


def _part(conv, chunk, matrix: Matrix, illegal: int, first: str, last: str, chunks: list[int], sizes: list[int]) -> tuple:
    return conv, chunk, [-1 if e is None else e[0] for e in matrix], ["" if e is None else e[1] for e in matrix], illegal, first, last, chunks, sizes


def _matrix(row: dict) -> Matrix:
    return tuple(None if c < 0 else (c, a) for c, a in zip(row["cost"], row["audit"], strict=True))


def _table(rows: list[tuple], schema: str, kinds: tuple) -> pa.Table:
    names = [x.split()[0] for x in schema.split(", ")]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * len(names), kinds, strict=True)], names)


_PART = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))


def _runs(rows: list[dict]) -> Iterator[list[dict]]:
    begin = 0
    for k in range(1, len(rows) + 1):
        if k == len(rows) or rows[k]["conv_id"] != rows[begin]["conv_id"]:
            yield rows[begin:k]
            begin = k


def _chunk(table: pa.Table) -> pa.Table:
    """One part for each conversation of a chunk."""
    out = []
    for run in _runs(sorted(table.to_pylist(), key=lambda r: r["at"])):
        initials = [r["initial"] for r in run]
        illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:], strict=False))
        chunk = run[0]["chunk"]
        matrix = product([turn_matrix(r["initial"], r["fault"]) for r in run])
        out.append(_part(run[0]["conv_id"], chunk, matrix, illegal, initials[0], initials[-1], [chunk], [len(run)]))
    return _table(out, PART, _PART)


def _joined(table: pa.Table) -> pa.Table:
    """Neighbouring parts of one conversation as one."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    illegal = sum(r["illegal"] for r in rows) + sum((a["last"], b["first"]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    part = _part(rows[0]["conv_id"], rows[0]["chunk"], product([_matrix(r) for r in rows]), illegal, rows[0]["first"], rows[-1]["last"], [c for r in rows for c in r["chunks"]], [n for r in rows for n in r["sizes"]])
    return _table([part], PART, _PART)


def examined(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text; others are not read) in order and written: with their place `at`, which rises over all rows, the role's initial and the first fault.

    Turns are ordered by turn, nulls first, then by role and text. Null roles and texts are empty. fault: "b" without a visible character, "d" if the conversation has the
    same role and text before, "t" if the last visible character doesn't end a sentence, else "".
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    # the sample of the ranges takes no more than the beginning of a text to the driver
    key = ("conv_id", "turn", "role")
    rows = rows.repartitionByRange(*key, F.substring("text", 1, 32)).sortWithinPartitions(*key, "text").withColumn("at", F.monotonically_increasing_id())
    same = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    blank, ended = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    own = F.when(blank, "b").when(ended, "").otherwise("t")
    return materialise(rows.withColumns({"chunk": F.shiftright("at", CHUNK_BITS), "initial": F.substring("role", 1, 1), "own": own, "same": same}), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, at, chunk, initial, turn, fault) of examined turns, duplicates told."""
    light = rows.select("conv_id", "at", "chunk", "initial", "turn", "own", "same")
    again = light.groupBy("conv_id", "same").agg(F.min("at").alias("head"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), "same", "head")
    told = light.join(again.withColumnRenamed("same", "s"), F.col("same").eqNullSafe(F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")), "left")
    fault = F.when(F.col("own") == "b", "b").when(F.col("at") > F.col("head"), "d").otherwise(F.col("own"))
    return materialise(told.select("conv_id", "at", "chunk", "initial", "turn", fault.alias("fault")), "faults")


def _whole(faults: DataFrame) -> DataFrame:
    """The part that is all of each conversation."""
    parts = materialise(faults.groupBy("chunk").applyInArrow(_chunk, PART), "parts")
    done = None
    while True:
        ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk")) - 1)
        several = parts.groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"))
        several = materialise(several, "several")
        mine = F.col("conv_id").eqNullSafe(F.col("c"))
        single = parts.join(several, mine, "left_anti")
        done = single if done is None else done.unionByName(single)
        if not several.limit(1).count():
            return done
        group = ranked.join(several, mine, "left_semi").withColumn("group", F.floor(F.col("rank") / FAN).cast("long")).drop("rank")
        parts = materialise(group.groupBy("conv_id", "group").applyInArrow(lambda t: _joined(t.drop_columns(["group"])), PART), "parts")


_REPAIR = "conv_id long, illegal long, cost long, audit string, chunks array<long>, sizes array<int>"


def _cheapest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            whole = times(_matrix(r), INSERTS)
            cost, audit = min(e for e in (whole[j] for j in FINAL) if e is not None)
            out.append((r["conv_id"], r["illegal"], cost, audit, r["chunks"], r["sizes"]))
        yield from _table(out, _REPAIR, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))).to_batches()


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The share of every chunk in its conversation's audit: insertions stand before the turn they precede, the last ones in the last share."""
    for batch in batches:
        out = []
        for conv, audit, chunks, sizes in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "chunks", "sizes")), strict=True):
            at = 0
            for k, (chunk, n) in enumerate(zip(chunks, sizes, strict=True)):
                end = at
                while n:
                    n -= audit[end] != "I"
                    end += 1
                end = len(audit) if k == len(chunks) - 1 else end
                out.append((conv, chunk, audit[at:end]))
                at = end
        yield from _table(out, "conv_id, chunk, share", (pa.int64(), pa.int64(), pa.string())).to_batches()


REPAIRED = "conv_id long, nth long, edit string, role string, text string"


class _Editor:
    """Applies a conversation's audit, share by share, to its turns as they come."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.nth, self.out = conv, START, 0, []
        self.share, self.at, self.tail = "", 0, 0

    def follow(self, share: str) -> None:
        self.share, self.at, self.tail = share, 0, len(share.rstrip("I"))

    def _put(self, edit: str, role: str, text: str) -> None:
        self.out.append((self.conv, self.nth, edit, role, text))
        self.nth += 1
        self.state = MOVES[self.state, role[:1]]

    def _insert(self, end: int) -> None:
        while self.at < end and self.share[self.at] == "I":
            self._put("I", ROLES[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insert(self.tail)
        edit = self.share[self.at]
        self.at += 1
        if edit != "D":
            self._put(edit, role if edit == "K" else ROLES[self.state], text)
        if self.at == self.tail:
            self._insert(len(self.share))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns after their edits, from rows in order: the share of a chunk, then its turns."""
    editor = None
    for batch in batches:
        out: list[tuple] = []
        for r in batch.to_pylist():
            if editor is None or r["conv_id"] != editor.conv:
                editor = _Editor(r["conv_id"])
            if r["at"] is None:
                editor.follow(r["share"])
            else:
                editor.turn(r["role"], r["text"])
                out += editor.out
                editor.out.clear()
        yield from _table(out, REPAIRED, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())).to_batches()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest = None, None
    for batch in batches:
        out: list[tuple] = []
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if digest is None or c != conv:
                out += [(conv, digest.hexdigest())] if digest else []
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield from _table(out, "conv_id, repaired_sha256", (pa.int64(), pa.string())).to_batches()
    if digest:
        yield from _table([(conv, digest.hexdigest())], "conv_id, repaired_sha256", (pa.int64(), pa.string())).to_batches()


def repaired_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired conversations: the SHA-256 of `role:text` of their turns, newline-joined."""
    return repaired.select("conv_id", "role", "text").mapInArrow(_digests, "conv_id long, repaired_sha256 string")


def repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of turns (conv_id, turn, role, text; others are not read).

    report: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one row for each conversation with turns. gaps are turn numbers missing between the least and the greatest,
    nulls left out; illegal counts neighbours whose roles' initials may not follow each other. Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (a must for blank and duplicate
    turns), Insert of an empty user or assistant turn 5, and 5 more for a truncated turn that stays. audit: the initials of the cheapest edits in order, of equally cheap ones the least.
    repaired: (conv_id, nth, edit, role, text), the turns after their edits, each conversation's together and in order; a conversation that loses all turns has none. See examined() for
    the order, ties, nulls and repeated rows. Rows without a conv_id are one conversation. An empty table gives no rows.
    Both read intermediate tables: where these are made inside a scratch() scope, write what you need of the results before it ends.
    """
    small_arrow_batches(turns.sparkSession)
    rows = examined(turns)
    faults = _faults(rows)
    cheapest = materialise(_whole(faults).mapInArrow(_cheapest, _REPAIR), "cheapest")
    number = lambda c: c.cast("decimal(38,0)")
    missing = number(F.max("turn")) - number(F.min("turn")) + 1 - F.count_distinct("turn")
    counts = faults.groupBy("conv_id").agg(F.coalesce(missing.try_cast("long"), F.lit(0)).alias("gaps"), *[F.count_if(F.col("fault") == f[0]).alias(f) for f in ("blank", "duplicate", "truncated")])
    report = counts.join(cheapest.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).select(*counts.columns, "illegal", "cost", "audit")
    none = F.lit(None)
    shares = cheapest.mapInArrow(_shares, "conv_id long, chunk long, share string").select("conv_id", "chunk", none.cast("long").alias("at"), "share", none.cast("string").alias("role"), none.cast("string").alias("text"))
    beside = shares.unionByName(rows.select("conv_id", "chunk", "at", none.cast("string").alias("share"), "role", "text"))
    beside = beside.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at")
    return report, beside.mapInArrow(_edited, REPAIRED)
