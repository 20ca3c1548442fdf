"""Stateful operators over an event stream; each takes and returns a streaming (or batch) DataFrame."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.operators.regions import stitch_image


def unexpired(events: DataFrame, at: str, ttl: str) -> DataFrame:
    """Events no later than `ttl` behind the newest one; later ones are dropped by the watermark of a following stateful step."""
    return events.withWatermark(at, ttl)


def once(events: DataFrame, keys: list[str], at: str, ttl: str) -> DataFrame:
    """The first event of each key within the watermark: work that is done or in flight is not begun again."""
    return events.withWatermark(at, ttl).dropDuplicatesWithinWatermark(keys)


def idle_sessions(events: DataFrame, key: str, at: str, idle: str, late: str) -> DataFrame:
    """(key, start, end, n) of runs of events without a pause of `idle`."""
    window = F.session_window(at, idle)
    return events.withWatermark(at, late).groupBy(key, window.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def damped_velocity(events: DataFrame, key: str, at: str, value: str, keep: float = 0.5) -> DataFrame:
    """(key, at, velocity): exponentially damped change of `value` a second, kept as state for each key.

    A change that is not finite counts as 1. Events of a micro-batch are taken in the order of their time.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_at, last_value, speed = state.get if state.exists else (None, 0.0, 0.0)
        rows = pd.concat(frames).sort_values("at")
        out = []
        for t, v in zip(rows["at"], rows["value"], strict=True):
            seconds = (t - last_at).total_seconds() if last_at is not None else 0.0
            change = (v - last_value) / seconds if seconds > 0 else 1.0
            speed = keep * speed + (1 - keep) * change
            last_at, last_value = t, float(v)
            out.append((k[0], t, speed))
        state.update((last_at, last_value, speed))
        yield pd.DataFrame(out, columns=["key", "at", "velocity"])

    flat = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, velocity double", "at timestamp, value double, speed double", "append", GroupStateTimeout.NoTimeout)


def throttled(events: DataFrame, key: str, at: str, pause_ms: int) -> DataFrame:
    """(key, at): events of each key that come at least `pause_ms` after the last one let through."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in pd.concat(frames)["at"].sort_values():
            if last is None or (t - last).total_seconds() * 1000 >= pause_ms:
                out.append((k[0], t))
                last = t
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "at"])

    flat = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, at timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def jobs_with_results(jobs: DataFrame, results: DataFrame, key: str, within: str) -> DataFrame:
    """Each job with its result if one comes up to `within` after it; jobs and results have columns `key` and `at`."""
    a, b = jobs.withWatermark("at", within).alias("j"), results.withWatermark("at", within).alias("r")
    on = (F.col(f"j.{key}") == F.col(f"r.{key}")) & (F.col("r.at") >= F.col("j.at")) & (F.col("r.at") <= F.col("j.at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, on, "leftOuter")


def region_states(events: DataFrame, key: str, at: str, kind: str) -> DataFrame:
    """(key, at, state) after every event: waiting until `begin`, processing until `end`, then finished; `reset` begins anew.

    An `end` without a `begin` changes nothing. Events of a micro-batch are taken in the order of their time.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else "waiting"
        out = []
        for t, event in pd.concat(frames).sort_values("at")[["at", "kind"]].itertuples(index=False):
            now = {("begin", "waiting"): "processing", ("end", "processing"): "finished"}.get((event, now), "waiting" if event == "reset" else now)
            out.append((k[0], t, now))
        state.update((now,))
        yield pd.DataFrame(out, columns=["key", "at", "state"])

    flat = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(kind).alias("kind"))
    return flat.groupBy("key").applyInPandasWithState(step, "key string, at timestamp, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def restitched(lines: DataFrame, image: str) -> DataFrame:
    """Every time chunks of an image come in, all of its lines (image, id, chunk, fate) so far, stitched anew.

    lines: (image, id, chunk, x0, y0, x1, y1, direction, lettercount). The state of an image is its lines, bounded by its pixels;
    a line that comes again replaces itself.
    """
    columns = ["id", "chunk", "x0", "y0", "x1", "y1", "direction", "lettercount"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(frames)[columns]
        known = pd.DataFrame(json.loads(state.get[0]), columns=columns) if state.exists else fresh.iloc[:0]
        rows = pd.concat([known, fresh]).drop_duplicates("id", keep="last").reset_index(drop=True)
        state.update((json.dumps(rows.values.tolist()),))
        done = stitch_image(rows.astype({"id": "int64", "chunk": "int64"}))
        yield pd.DataFrame({"image": k[0], "id": done["id"], "chunk": done["chunk"], "fate": done["fate"]})

    flat = lines.select(F.col(image).cast("string").alias("image"), *columns)
    return flat.groupBy("image").applyInPandasWithState(step, "image string, id long, chunk long, fate string", "rows string", "append", GroupStateTimeout.NoTimeout)
