"""Streams with timers: state goes when its time has come, and what is late is dropped."""

from datetime import datetime, timedelta

import pytest

from loomspan.streaming import stateful

T0 = datetime(2024, 1, 1)


def at(ms: int) -> datetime:
    return T0 + timedelta(milliseconds=ms)


@pytest.fixture
def played(spark, tmp_path):
    """play(schema, batches, build): the rows a stream gives for each micro-batch."""
    stateful.use_state_store(spark)

    def play(schema, batches, build):
        source, seen = str(tmp_path / "in"), []
        spark.createDataFrame([], schema).write.mode("append").parquet(source)
        stream = build(spark.readStream.schema(schema).parquet(source))
        for k, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            got = []
            query = stream.writeStream.foreachBatch(lambda df, _, got=got: got.extend(tuple(r) for r in df.collect())).outputMode("append")
            q = query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            assert q.awaitTermination(180), k
            seen.append(sorted(got, key=repr))
        return seen

    return play


def test_regions_are_final_between_done_chunks_and_state_goes(played):
    line = lambda chunk, region, ms: ("i", at(ms), chunk, 4, region)
    batches = [
        [line(0, "a", 0), line(1, "a", 10), line(1, "b", 10), ("k", at(10), 0, 1, "z")],
        [line(2, "b", 20)],
        [line(3, None, 30)],
        [("j", at(60_000), 0, 9, None)],  # time passes, the image is dropped
        [line(0, "late", 40), ("j", at(61_000), 1, 9, "c")],
        [("j", at(62_000), 2, 9, None)],
    ]
    got = played("image string, at timestamp, chunk int, chunks int, region string", batches, lambda s: stateful.final_regions(s, "image", "at"))
    flat = [[r[:2] for r in rows] for rows in got]
    assert flat[0] == [("k", "z")]
    assert flat[1] == [("i", "a")]
    assert flat[2] == [("i", "b")]
    assert sorted(flat[3], key=repr) == [("i", None), ("k", None)]  # the markers
    assert flat[4] == []  # the late line began no new state
    assert flat[5] == [("j", "c")]


def test_pointer_needs_chunks_ahead_and_is_forgotten(played):
    move = lambda ms, y: ("p", at(ms), 5.0, float(y), 1000.0)
    batches = [[move(0, 100), move(100, 200)], [move(200, 300)], [("q", at(60_000), 0.0, 10.0, 90.0)], [move(60_100, 990)]]
    got = played("s string, at timestamp, x double, y double, height double", batches, lambda s: stateful.pointer_chunks(s, "s", "at"))
    chunks = [[(r[0], (r[1] - T0).total_seconds() * 1000, r[2], r[3]) for r in rows if r[2] >= 0] for rows in got]
    speeds, want, speed, y0 = {}, {}, 0.0, 100
    for ms, y in ((0, 100), (100, 200), (200, 300)):
        speed = 0.5 * speed + 0.5 * (y - y0) / 100 if ms else 0.0
        y0, speeds[ms] = y, speed
        want[ms] = [("p", float(ms), k, c) for k, c in enumerate(stateful.expected_chunks(y, 0.0, speed, 1000))]
    assert chunks[0] == want[0] + want[100] and chunks[1] == want[200]
    assert len(want[200]) > 2 and stateful.expected_chunks(100, 0, 0, 1000) == [0] and stateful.expected_chunks(200, 0, -1, 1000) == [1, 0]
    assert ("p", -1) in [(r[0], r[3]) for r in got[2]] + [(r[0], r[3]) for r in got[3]]
    assert [c for c in chunks[3] if c[0] == "p"] == [("p", 60_100.0, 0, 5)]  # at rest again: no speed is known


def test_machine_answers_at_the_end_and_forgets(played):
    event = lambda ms, kind, token=None: ("r", at(ms), kind, token)
    batches = [
        [event(0, "ask", "t1"), event(5, "end"), event(10, "begin")],
        [event(20, "ask", "t2"), event(30, "end"), event(40, "ask", "t3")],
        [event(50, "reset"), event(60, "ask", "t4")],
        [("x", at(200_000), "begin", None)],
        [event(100, "begin"), event(200_100, "end")],
    ]
    got = played("r string, at timestamp, kind string, token string", batches, lambda s: stateful.region_machine(s, "r", "at"))
    brief = [sorted(((r[2], r[3]) for r in rows if r[0] == "r"), key=repr) for rows in got]
    assert brief[0] == [("processing", None), ("waiting", None)]
    assert brief[1] == [("finished", "t1"), ("finished", "t2"), ("finished", "t3"), ("finished", None)]
    assert brief[2] == [("waiting", None)]
    assert brief[3] == [("forgotten", "t4")]
    assert brief[4] == [("waiting", None)]  # `begin` was late, and nothing is left of the state before
