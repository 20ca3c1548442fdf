"""Chat formatting: a finite-state machine over roles validates the order of turns, a declarative template gives text segments with loss flags.

Every turn becomes an opening mark, its text and a closing mark. Inside texts every control string of the template, and the escape
character itself, gets the escape character before it, so the output can be read back exactly. Conversations are dealt out by
their id and stream through a task in the order of their turns: a task holds one Arrow batch, the machine's state and, when reading, one turn,
however long a conversation is. A conversation is read by one task, because its digests run from its first to its last turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import small_arrow_batches


@dataclass(frozen=True)
class Template:
    """Marks, roles and moves of a chat format.

    openers: the mark before the text of each known role. other: the marks around the name of any other role. closer and between stand
    after every text. learned: the roles whose texts are under the loss. moves: the machine, state -> role -> state; an illegal turn leaves its state as it is.
    """

    openers: dict[str, str]
    other: tuple[str, str]
    closer: str
    moves: dict[str, dict[str, str]]
    start: str
    final: frozenset[str]
    learned: frozenset[str]
    between: str = "\n"
    escape: str = "\\"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = (*self.openers.values(), *self.other, self.closer)
        object.__setattr__(self, "controls", tuple(sorted(set(marks), key=lambda m: (-len(m), m))))
        first = (*self.openers.values(), self.other[0])
        if any(not m or self.escape in m for m in marks) or len(self.escape) != 1:
            raise ValueError("a mark is empty or holds the escape character")
        if any(a is not b and b.startswith(a) for a in first for b in first):
            raise ValueError("an opening mark begins another")
        for mark in marks:
            for cut in range(1, len(mark)):
                if any(end.startswith(mark[cut:]) or mark[cut:].startswith(end) for end in (self.closer, self.other[1])):
                    raise ValueError(f"the end of a text and the mark after it could be read as {mark!r}")

    @property
    def pattern(self) -> str:
        """Whatever is escaped inside texts, the longest mark first."""
        return "|".join(re.escape(x) for x in (self.escape, *self.controls))

    def escaped(self, texts: pa.Array) -> pa.Array:
        return pc.replace_substring_regex(texts, f"({self.pattern})", re.escape(self.escape) + r"\1")

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}({self.pattern})", r"\1", text)

    def opening(self, role: str) -> str:
        """The mark before a turn of this role."""
        return self.openers.get(role) or self.other[0] + self.escaped(pa.array([role]))[0].as_py() + self.other[1]

    def marks(self) -> re.Pattern:
        """Escaped strings and bare marks; only the latter fill the group."""
        return re.compile(f"{re.escape(self.escape)}(?:{self.pattern})|({'|'.join(re.escape(x) for x in self.controls)})")


#: An optional system turn, then questions and answers in turn.
QUESTIONS_AND_ANSWERS = Template(
    openers={"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "},
    other=("### Role: ", "</role>"),
    closer="</turn>",
    moves={
        "start": {"system": "briefed", "user": "asked"},
        "briefed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    start="start",
    final=frozenset({"answered"}),
    learned=frozenset({"assistant"}),
)

SEGMENTS = "conv_id long, segment long, text string, loss boolean, legal boolean, state string"


def _segments(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = object()
        state, nth = template.start, 0
        end = template.closer + template.between
        openings: dict[str, str] = dict(template.openers)
        for batch in batches:
            out: list[tuple] = []
            texts = template.escaped(batch.column("text")).to_pylist()
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), texts, strict=True):
                if conv != current:
                    current, state, nth = conv, template.start, 0
                legal = role in template.moves.get(state, {})
                state = template.moves[state][role] if legal else state
                opening = openings.get(role) or template.opening(role)
                pieces = [(opening, False), (text, True), (end, False)] if role in template.learned else [(opening + text + end, False)]
                for piece, loss in pieces:
                    out.append((conv, nth, piece, loss, legal, state))
                    nth += 1
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in SEGMENTS.split(", ")])

    return run


def format_chat(conversations: DataFrame, template: Template = QUESTIONS_AND_ANSWERS) -> DataFrame:
    """(conv_id, segment, text, loss, legal, state) of conversations (conv_id, turn, role, text; others are not read), each one's segments together and in order.

    The segments' texts joined are the formatted conversation. loss: the segment is learned; it is then the whole escaped text of one turn. legal: the machine has a
    move for the turn; state: its state after it. Turns are ordered by turn, role and text, nulls first. A null role or text is empty; a role that the template doesn't
    know, the empty one too, is written between its own marks and is never legal. Repeated rows are turns of their own; rows without a conv_id
    are one conversation. An empty table gives no rows.
    """
    small_arrow_batches(conversations.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(_segments(template), SEGMENTS)


def in_order(segments: DataFrame) -> DataFrame:
    """Segments that were stored or shuffled since format_chat(), each conversation's together and in order again."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")


class _Reader:
    """Gives the turns of one conversation from its segments' texts, wherever these are cut."""

    def __init__(self, template: Template):
        self.template, self.marks, self.held = template, template.marks(), ""

    def turns(self, text: str) -> Iterator[tuple[str, str]]:
        self.held += text
        if self.template.closer + self.template.between not in text and self.template.closer not in self.held:
            return
        while found := self._turn():
            yield found

    def _turn(self) -> tuple[str, str] | None:
        t = self.template
        role = next((r for r, o in t.openers.items() if self.held.startswith(o)), None)
        begin, start = len(t.openers[role] if role is not None else t.other[0]), 0
        for m in self.marks.finditer(self.held, begin):
            if role is None and m[1] == t.other[1]:
                role, start = t.unescaped(self.held[begin : m.start()]), m.end()
            elif m[1] == t.closer and len(self.held) >= m.end() + len(t.between):
                text = t.unescaped(self.held[start or begin : m.start()])
                self.held = self.held[m.end() + len(t.between) :]
                return role, text
            elif m[1]:
                break
        return None

    def close(self) -> None:
        if self.held:
            raise ValueError(f"text behind the last turn: {self.held[:80]!r}")


def _each_conversation(batches: Iterator[pa.RecordBatch], fresh: Callable[[], object]) -> Iterator[tuple[object, object, list[dict] | None]]:
    """(conversation, its state, some of its rows), then (conversation, its state, None) at its end."""
    current, state, begun = None, None, False
    for batch in batches:
        rows = batch.to_pylist()
        at = 0
        while at < len(rows):
            conv = rows[at]["conv_id"]
            end = next((k for k in range(at, len(rows)) if rows[k]["conv_id"] != conv), len(rows))
            if not begun or conv != current:
                if begun:
                    yield current, state, None
                current, state, begun = conv, fresh(), True
            yield current, state, rows[at:end]
            at = end
    if begun:
        yield current, state, None


def _read(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, (reader, count), rows in _each_conversation(batches, lambda: (_Reader(template), [0])):
            if rows is None:
                reader.close()
                continue
            turns = [x for r in rows for x in reader.turns(r["text"])]
            columns = [pa.array([conv] * len(turns), pa.int64()), pa.array(range(count[0], count[0] + len(turns)), pa.int64()), *[pa.array([x[k] for x in turns], pa.string()) for k in (0, 1)]]
            count[0] += len(turns)
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "nth", "role", "text"])

    return run


def read_back(segments: DataFrame, template: Template = QUESTIONS_AND_ANSWERS) -> DataFrame:
    """(conv_id, nth, role, text): the turns that segments hold, each conversation's together and in order (see in_order)."""
    return segments.select("conv_id", "text").mapInArrow(_read(template), "conv_id long, nth long, role string, text string")


@dataclass
class _Digest:
    reader: _Reader
    turns: object = field(default_factory=hashlib.sha256)
    learned: object = field(default_factory=hashlib.sha256)
    n_turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    legal: bool = True
    state: str = ""


def _digests(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for conv, d, rows in _each_conversation(batches, lambda: _Digest(_Reader(template))):
            if rows is None:
                d.reader.close()
                done.append((conv, d.n_turns, d.turns.hexdigest(), d.loss_chars, d.learned.hexdigest(), d.chars, d.legal and d.state in template.final))
                if len(done) >= 1000:
                    yield _digest_batch(done)
                    done = []
                continue
            for r in rows:
                d.chars += len(r["text"])
                d.legal, d.state = d.legal and r["legal"], r["state"]
                if r["loss"]:
                    text = template.unescaped(r["text"])
                    d.loss_chars += len(text)
                    d.learned.update(text.encode())
                for role, text in d.reader.turns(r["text"]):
                    d.n_turns += 1
                    d.turns.update(f"{role}\n{text}\n".encode())
        yield _digest_batch(done)

    return run


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean"


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [()] * 7, kinds, strict=True)], [x.split()[0] for x in DIGESTS.split(", ")])


def chat_digests(segments: DataFrame, template: Template = QUESTIONS_AND_ANSWERS) -> DataFrame:
    """One row for each conversation of segments, read back from them: turns and learned text as SHA-256, their sizes in code points, and whether its order is legal to the end."""
    return segments.select("conv_id", "text", "loss", "legal", "state").mapInArrow(_digests(template), DIGESTS)
