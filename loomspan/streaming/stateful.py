"""Streams whose state has timers: where a pointer will be, which regions are final, and what state a region is in.

Each takes a stream with an event-time column and gives a stream. State belongs to a key, sits in the state store (RocksDB) and goes when a timer on event time says so; the
watermark drops what comes later than that. Rows of a micro-batch are taken in the order of their time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
AHEAD_MS, STEP_MS, LEAST_SPEED, DAMP = 500, 100, 1.0, 0.5
SIZE, HALO = 250, 90


def use_state_store(spark) -> None:
    """Keep state in RocksDB, which keyed maps, lists and timers need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _sorted(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(rows).sort_values("at", kind="stable")


class _Timed(StatefulProcessor):
    """A processor with one timer for a key: the latest that was set."""

    def _wake_at(self, at_ms: int) -> None:
        for known in list(self.handle.listTimers()):
            self.handle.deleteTimer(known if isinstance(known, int) else known[0])
        self.handle.registerTimer(at_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def close(self) -> None:
        pass


class _Pointer(_Timed):
    """The damped velocity of a pointer, forgotten when it has rested."""

    def __init__(self, rest_ms: int):
        self.rest_ms = rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at long, x double, y double, vx double, vy double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at, x, y, vx, vy = self.last.get() if self.last.exists() else (None, 0.0, 0.0, 0.0, 0.0)
        out = []
        for r in _sorted(rows).itertuples():
            now = _ms(r.at)
            if at is None:
                x, y = r.x, r.y
            elif now > at:
                vx, vy = (DAMP * v + (1 - DAMP) * (b - a) / (now - at) for v, a, b in ((vx, x, r.x), (vy, y, r.y)))
                if not (math.isfinite(vx) and math.isfinite(vy)):
                    vx = vy = 1.0
                x, y = r.x, r.y
            at = now
            out += [(key[0], r.at, k, chunk) for k, chunk in enumerate(expected_chunks(r.y, vx, vy, r.height))]
        self.last.update((at, float(x), float(y), float(vx), float(vy)))
        self._wake_at(at + self.rest_ms)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "rank", "chunk"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")], "rank": [-1], "chunk": [-1]})


def expected_chunks(y: float, vx: float, vy: float, height: float) -> list[int]:
    """The chunks of an image that a pointer at y will cross in the next half second, the next one first. A slow pointer counts as one of a pixel a millisecond."""
    speed = math.hypot(vx, vy)
    vy = vy / speed * max(speed, LEAST_SPEED) if speed else 0.0
    count = max(1, math.ceil((height - HALO) / (SIZE - HALO)))
    found: list[int] = []
    for t in range(0, AHEAD_MS, STEP_MS):
        at = y + vy * t
        if not 0 <= at < height:
            break
        k = min(count - 1, int(at // (SIZE - HALO)))
        found += [c for c in ([k, k - 1] if k and at - k * (SIZE - HALO) < HALO else [k]) if c not in found]
    return found


def pointer_chunks(moves: DataFrame, key: str, at: str, late: str = "1 second", rest_ms: int = 10_000) -> DataFrame:
    """(key, at, rank, chunk) of a stream of moves (key, at, x, y, height): the chunks that a pointer will need, the likeliest first.

    A pointer that has rested for rest_ms is forgotten, which a row with rank and chunk -1 tells.
    """
    flat = moves.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), *[F.col(c).cast("double").alias(c) for c in ("x", "y", "height")])
    schema = "key string, at timestamp, rank int, chunk int"
    return flat.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Pointer(rest_ms), schema, "Append", "EventTime")


class _Completion(_Timed):
    """Which chunks of an image are done, and the regions whose neighbours are not."""

    def __init__(self, linger_ms: int):
        self.linger_ms = linger_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.done = handle.getMapState("done", "chunk int", "at long")
        self.open = handle.getMapState("open", "region string", "chunks array<int>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = _sorted(rows)
        for r in batch.itertuples():
            self.done.updateValue((int(r.chunk),), (_ms(r.at),))
            if r.region is not None:
                known = list(self.open.getValue((r.region,))[0]) if self.open.containsKey((r.region,)) else []
                if int(r.chunk) not in known:
                    self.open.updateValue((r.region,), ([*known, int(r.chunk)],))
        total, latest = int(batch["chunks"].max()), batch["at"].max()
        done = {c for (c,) in self.done.keys()}
        final = sorted(region for (region,), (chunks,) in list(self.open.iterator()) if all({max(0, c - 1), min(total - 1, c + 1)} <= done for c in chunks))
        for region in final:
            self.open.removeKey((region,))
        if len(done) == total:
            self._wake_at(_ms(latest) + self.linger_ms)
        if final:
            yield pd.DataFrame({"key": [key[0]] * len(final), "region": final, "at": [latest] * len(final)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.done.clear()
        self.open.clear()
        yield pd.DataFrame({"key": [key[0]], "region": [None], "at": [pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")]})


def final_regions(lines: DataFrame, image: str, at: str, late: str = "2 seconds", linger_ms: int = 500) -> DataFrame:
    """(key, region, at) of a stream of lines (image, at, chunk, chunks, region): regions as soon as the chunks beside all of their lines are done.

    chunks is how many the image has; a chunk without regions comes with a null one. When all chunks are done and linger_ms have gone by, the image's state is dropped and a row with a null
    region marks that; chunks that come later than that are late and dropped.
    """
    flat = lines.select(F.col(image).cast("string").alias("key"), F.col(at).alias("at"), F.col("chunk").cast("int").alias("chunk"), F.col("chunks").cast("int").alias("chunks"), F.col("region").cast("string").alias("region"))
    return flat.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Completion(linger_ms), "key string, region string, at timestamp", "Append", "EventTime")


class _Machine(_Timed):
    """waiting, processing, finished; what was asked for before the end is kept and answered then."""

    def __init__(self, forget_ms: int):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "state string")
        self.asked = handle.getListState("asked", "token string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()[0] if self.state.exists() else "waiting"
        asked = [t for (t,) in self.asked.get()]
        out, latest = [], 0
        for r in _sorted(rows).itertuples():
            latest = max(latest, _ms(r.at))
            if r.kind == "ask":
                asked.append(r.token)
            now = {("begin", "waiting"): "processing", ("end", "processing"): "finished"}.get((r.kind, now), "waiting" if r.kind == "reset" else now)
            if now == "finished":
                out += [(key[0], r.at, now, t) for t in asked]
                asked = []
            if r.kind != "ask":
                out.append((key[0], r.at, now, None))
        self.state.update((now,))
        if asked:
            self.asked.put([(t,) for t in asked])
        else:
            self.asked.clear()
        self._wake_at(latest + self.forget_ms)
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "state", "token"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        unanswered = [t for (t,) in self.asked.get()]
        self.state.clear()
        self.asked.clear()
        when = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms")
        yield pd.DataFrame([(key[0], when, "forgotten", t) for t in unanswered or [None]], columns=["key", "at", "state", "token"])


def region_machine(events: DataFrame, key: str, at: str, late: str = "2 seconds", forget_ms: int = 60_000) -> DataFrame:
    """(key, at, state, token) of a stream of events (key, at, kind, token): a region's state after `begin`, `end` and `reset`, and the tokens that were asked for.

    `ask` events wait until the region is finished and are answered with it. A region without events for forget_ms is forgotten; tokens still waiting come back with that.
    """
    flat = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col("kind").cast("string").alias("kind"), F.col("token").cast("string").alias("token"))
    return flat.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Machine(forget_ms), "key string, at timestamp, state string, token string", "Append", "EventTime")
