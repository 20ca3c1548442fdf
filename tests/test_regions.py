"""Regions, lines and stitching against plain loops, on small hand-made documents and synthetic images."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspan.functions import colour, numbers
from loomspan.operators import regions
from loomspan.plans import layout_queries
from loomspan.plans.shapes import frame
from loomspan.sources.regions import write_regions
from loomspan.streaming import events

SF = "/root/testdata/sf0.001"


def line(id_, x0, y0, x1, y1, letters=9, direction=1, angle=0.0, chunk=0):
    return dict(id=id_, img=0, x0=float(x0), y0=float(y0), x1=float(x1), y1=float(y1), width=x1 - x0 + 1.0, height=y1 - y0 + 1.0, cx=(x0 + x1) / 2, cy=(y0 + y1) / 2, area=float((x1 - x0) * (y1 - y0)), angle=angle, lettercount=letters, lettersize=2.0, xheight=8.0, avgheight=10.0, lineheight=14.0, thickness=2.0, direction=direction, chunk=chunk)


def test_paragraph_of_four_lines_beside_a_heading(spark):
    # four lines one below the other, the last one read in the next chunk, and a lone line far off
    lines = [line(0, 10, 10, 200, 22), line(1, 10, 30, 195, 42), line(2, 12, 50, 205, 63), line(3, 40, 70, 110, 82, chunk=1), line(4, 400, 300, 560, 330)]
    edges = regions.paragraph_edges(spark.createDataFrame(pd.DataFrame(lines)), ["img"])
    assert sorted((r["a"], r["b"]) for r in edges.collect()) == [(0, 1), (1, 2)]
    lines[3] = line(3, 10, 70, 200, 82, chunk=1)
    edges = regions.paragraph_edges(spark.createDataFrame(pd.DataFrame(lines)), ["img"])
    assert sorted((r["a"], r["b"]) for r in edges.collect()) == [(0, 1), (1, 2), (2, 3)]


def components(ids, edges):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


def share(axis, a, b):
    return min(a[axis + "1"], b[axis + "1"]) - max(a[axis + "0"], b[axis + "0"])


def ratio(name, a, b):
    return max(a[name], b[name]) / min(a[name], b[name])


def wrap(lines):
    n = sum(x["lettercount"] for x in lines)
    angle = sum(x["angle"] * x["lettercount"] for x in lines) / n
    out = {k: f(x[k] for x in lines) for k, f in (("x0", min), ("y0", min), ("x1", max), ("y1", max))}
    out |= {k: sum(x[k] for x in lines) / len(lines) for k in ("lineheight", "lettersize")}
    return out | {"id": min(x["id"] for x in lines), "lettercount": n, "angle": 0.0 if n < 5 and angle < 0.1 else angle, "direction": min(lines, key=lambda x: x["id"])["direction"], "lines": lines, "width": out["x1"] - out["x0"], "area": (out["x1"] - out["x0"]) * (out["y1"] - out["y0"])}


def deviation(lines):
    ys = sorted((x["cy"], x["id"]) for x in lines)
    gaps = sorted(max(0, b[0] - a[0]) for a, b in zip(ys, ys[1:], strict=False))
    return sum(abs(g - gaps[len(gaps) // 2]) for g in gaps) / len(gaps) if gaps else math.inf


def regroup(items, test):
    label = components([x["id"] for x in items], [(a["id"], b["id"]) for a in items for b in items if a["id"] < b["id"] and test(a, b)])
    groups = {}
    for x in items:
        groups.setdefault(label[x["id"]], []).append(x)
    return list(groups.values())


def over(limit):
    return lambda a, b: share("x", a, b) > 0 and share("y", a, b) > 0 and share("x", a, b) * share("y", a, b) > limit * min(a["area"], b["area"])


def score(letters):
    touching = regroup(letters, lambda a, b: share("x", a, b) > -2 and share("y", a, b) > -2)
    median = lambda g: sorted(min(x["thickness"], x["size"] / min(x["width"], x["height"])) for x in g)[len(g) // 2]
    return sum(median(g) * math.sqrt(max(x["width"] for x in g)) for g in touching)


def near(a, b):
    spacing = (a["height"] + b["height"]) / 2
    return (ratio("thickness", a, b) <= 3 and ratio("height", a, b) <= 2 and share("x", a, b) > 0 and share("y", a, b) < 0.1 * spacing and -share("y", a, b) < 1.7 * spacing and ratio("avgheight", a, b) < 1.7
            and min(abs(a[c] - b[c]) for c in ("x0", "x1", "cx")) / max(a["width"], b["width"]) < 0.1 and abs(a["angle"] - b["angle"]) < 0.1 and min(a["lettercount"], b["lettercount"]) > 2
            and ratio("lettersize", a, b) - 1 < 0.4 and ratio("xheight", a, b) - 1 < 0.4 and a["direction"] == b["direction"])


def continues(a, b):
    return (a["direction"] == b["direction"] and ratio("lettersize", a, b) - 1 < 0.4 and len(a["lines"]) + len(b["lines"]) > 2 and share("x", a, b) >= 0.9 * min(a["width"], b["width"])
            and 0 < -share("y", a, b) < 2 * max(a["lineheight"], b["lineheight"]) and ratio("lineheight", a, b) < 1.5 and deviation(a["lines"] + b["lines"]) < 2)


def otsu(values):
    bins = {}
    for v in values:
        bins[math.floor(v)] = bins.get(math.floor(v), 0) + 1
    best, at, n, s = 0.0, 0, sum(bins.values()), sum(k * c for k, c in bins.items())
    w = t = 0
    for k in sorted(bins):
        w, t = w + bins[k], t + k * bins[k]
        between = round(w * (n - w) * (t / w - (s - t) / (n - w)) ** 2, 3) if n > w else 0.0
        if between > best:
            best, at = between, k
    return at


def split(region):
    rows = sorted(region["lines"], key=lambda x: (x["cy"], x["id"]))
    gaps = [max(0.0, b["y0"] - a["y1"]) for a, b in zip(rows, rows[1:], strict=False)]
    mean = sum(gaps) / len(gaps) if gaps else 0.0
    spread = math.sqrt(sum((g - mean) ** 2 for g in gaps) / len(gaps)) if gaps else 0.0
    parts = [[rows[0]]]
    for gap, x in zip(gaps, rows[1:], strict=True):
        if gap > otsu(gaps) and len(rows) > 3 and spread > mean * 0.3:
            parts.append([])
        parts[-1].append(x)
    return [wrap(p) for p in parts]


def plain_regions(lines, letters):
    found = [wrap(g) for g in regroup(lines, near)]
    kept = []
    for group in regroup(found, over(0.2)):
        votes = [(x["direction"], score(letters[x["id"]])) for r in group for x in r["lines"]]
        total = sum(d * s for d, s in votes) / sum(s for _, s in votes) - 0.001
        kept += [r for r in group if r["direction"] == (1 if total > 0 else -1)]
    joined = []
    for group in regroup(kept, continues):
        whole = [x for r in group for x in r["lines"]]
        joined += [wrap(whole)] if len(whole) > 1 and deviation(whole) < 2 else group
    out = {}
    for group in regroup([p for r in joined for p in split(r)], over(0.3)):
        if len(group) > 1 and abs(sum(r["angle"] for r in group) / len(group)) > 0.1:
            out.update({x["id"]: min(r["id"] for r in group) for r in group for x in r["lines"]})
            continue
        chosen = []
        for r in sorted(group, key=lambda r: (-r["lettercount"], r["id"])):
            if not any(over(0.2)(r, c) for c in chosen):
                chosen.append(r)
        out.update({x["id"]: r["id"] for r in chosen for x in r["lines"]})
    return out


def test_built_regions_equal_plain_loops(spark):
    lines = layout_queries.doubled_lines(frame(spark, SF, "lines").where("img < 3"))
    letters = layout_queries._line_letters(lines)
    got = {r["id"]: r["region"] for r in regions.build_regions(lines, letters, "img").select("id", "region").collect()}
    of = {}
    for r in letters.collect():
        of.setdefault(r["line"], []).append(r.asDict())
    want = {}
    rows = [r.asDict() for r in lines.collect()]
    for img in {r["img"] for r in rows}:
        want |= plain_regions([r for r in rows if r["img"] == img], of)
    assert len(want) > 100 and got == want


def test_greedy_subset_equals_one_after_the_other(spark):
    r = random.Random(2)
    items = [(i, r.randrange(6)) for i in range(60)]
    edges = [(a, b) for a in range(60) for b in range(a) if r.random() < 0.06]
    kept = []
    for i, _ in sorted(items, key=lambda x: (-x[1], x[0])):
        if not any((i, k) in edges or (k, i) in edges for k in kept):
            kept.append(i)
    got = regions.greedy_subset(spark.createDataFrame(items, "id long, w long"), spark.createDataFrame(edges, "a long, b long"), "w")
    assert sorted(x["id"] for x in got.collect()) == sorted(kept)
    assert regions.greedy_subset(spark.createDataFrame(items, "id long, w long"), spark.createDataFrame([], "a long, b long"), "w").count() == 60


def test_letters_join_to_straight_lines(spark):
    row = lambda k, y, n, h=10: [dict(page=0, id=k + i, x0=12.0 * i, y0=y, x1=12.0 * i + 8, y1=y + h - 1.0, cx=12.0 * i + 4, cy=y + (h - 1) / 2, width=9.0, height=float(h), thickness=2.0) for i in range(n)]
    letters = spark.createDataFrame(pd.DataFrame(row(0, 0.0, 6) + row(10, 30.0, 4) + row(20, 80.0, 1, 30)))
    got = regions.built_lines(letters, regions.letter_pairs(letters, ["page"]), "page")
    assert {r["id"]: r["line"] for r in got.collect()} == {**dict.fromkeys(range(6), 0), **dict.fromkeys(range(10, 14), 10), 20: 20}


def straight_plain(group, parts):
    """Does a group of letters, made of two parts, stand on one even line? From all slopes and gaps at once."""
    def tilt(letters):
        both = [(a, b) for i, a in enumerate(letters) for b in letters[i + 1 :] if a["cx"] != b["cx"]]
        found = np.sort([(a["cy"] - b["cy"]) / (a["cx"] - b["cx"]) for a, b in both])
        return abs(np.arctan(found[len(found) // 2])) if len(found) else 0.0

    row = sorted(group, key=lambda x: (x["x1"], x["id"]))
    lift = [max(2.0, max(a["y0"], b["y0"]) - min(a["y1"], b["y1"])) for a, b in zip(row, row[1:], strict=False)]
    hull = [[f(x[c] for x in p) for f, c in ((min, "x0"), (min, "y0"), (max, "x1"), (max, "y1"))] for p in parts]
    (a0, a1, a2, a3), (b0, b1, b2, b3) = hull
    w, h = min(a2, b2) - max(a0, b0), min(a3, b3) - max(a1, b1)
    least = min((a2 - a0) * (a3 - a1), (b2 - b0) * (b3 - b1))
    tall = [max(x["height"] for x in p) for p in parts]
    return (
        tilt(group) <= 0.1 + sum(tilt(p) for p in parts)
        and len(set(lift)) <= 1
        and not (w > 0 and h > 0 and w * h > 0.3 * least)
        and max(tall) / min(tall) <= 1.5 + 10 / max(map(len, parts))
    )


def lines_plain(letters, pairs):
    """Single-link merging, the nearest pair first, as sets of letters."""
    groups = [[x] for x in letters]
    for _, left, right in sorted((p["dist"], p["left"], p["right"]) for p in pairs):
        a, b = (next(g for g in groups if any(x["id"] == k for x in g)) for k in (left, right))
        if a is not b and (len(a) + len(b) == 2 or straight_plain(a + b, (a, b))):
            groups = [g for g in groups if g is not a and g is not b] + [a + b]
    return {x["id"]: min(y["id"] for y in g) for g in groups for x in g}


def test_lines_of_letters_equal_a_plain_version(spark):
    r, letters = random.Random(7), []
    for page in range(4):
        for k in range(60):
            row, place, w, h = k // 15, k % 15, r.randrange(5, 12), r.randrange(8, 15) if r.random() < 0.9 else 30
            x0, y0 = place * 13.0 + r.randrange(3), row * 22.0 + place * (page % 2) * 0.5 + r.choice([0, 0, 0, 1, 4])
            letters.append({"page": page, "id": page * 100 + k, "x0": x0, "y0": y0, "x1": x0 + w, "y1": y0 + h, "cx": x0 + w / 2, "cy": y0 + h / 2, "width": w + 1.0, "height": h + 1.0, "thickness": 2.0})
    df = spark.createDataFrame(pd.DataFrame(letters))
    pairs = regions.letter_pairs(df, ["page"])
    got = {x["id"]: x["line"] for x in regions.built_lines(df, pairs, "page").collect()}
    near = [p.asDict() for p in pairs.collect()]
    want = {}
    for page in range(4):
        want |= lines_plain([x for x in letters if x["page"] == page], [p for p in near if p["page"] == page])
    assert got == want and 8 < len(set(want.values())) < 200


def stitch_plain(lines):
    """Groups by a flood over both sides of neighbouring chunks, with the survivors of the chunk before."""
    fate, alive = {}, []
    for chunk in sorted({x["chunk"] for x in lines}):
        cur = [x for x in lines if x["chunk"] == chunk]
        fate |= {x["id"]: "valid" for x in alive if x["chunk"] != chunk - 1}
        old, seen, alive_next = [x for x in alive if x["chunk"] == chunk - 1], set(), []
        for start in cur + old:
            if start["id"] in seen:
                continue
            todo, group = [start], []
            while todo:
                x = todo.pop()
                if x["id"] in seen:
                    continue
                seen.add(x["id"])
                group.append(x)
                todo += [y for y in (old if x in cur else cur) if x["direction"] == y["direction"] and all(share(a, x, y) > 0.7 * (min(x[a + "1"] - x[a + "0"], y[a + "1"] - y[a + "0"]) + 1) for a in "xy")]
            new, prev = [x for x in group if x in cur], [x for x in group if x in old]
            if not prev:
                alive_next += new
            elif not new:
                fate |= {x["id"]: "valid" for x in prev}
            else:
                edge = [min(min(max(0, x["y0"] - 160 * x["chunk"]), max(0, 160 * x["chunk"] + 250 - x["y1"])) for x in side) for side in (new, prev)]
                most = [max(x["lettercount"] for x in side) for side in (new, prev)]
                a, b = edge if min(edge) < 62.5 and (most[0] - most[1]) / sum(most) < 0.5 else most
                fate |= {x["id"]: "valid" if (a > b) == (x in new) else "orphan" for x in group}
        alive = alive_next
    return fate | {x["id"]: "valid" for x in alive}


def test_stitched_lines_equal_a_plain_version(spark):
    lines = layout_queries.chunk_lines(frame(spark, SF, "lines").where("img < 12"))
    rows = [r.asDict() for r in lines.collect()]
    want = {}
    for img in {r["img"] for r in rows}:
        want |= stitch_plain([r for r in rows if r["img"] == img])
    got = {r["id"]: r["fate"] for r in regions.stitched(lines, "img").collect()}
    assert got == want and set(got.values()) == {"valid", "orphan"}


def test_colours_come_back(spark):
    rows = spark.createDataFrame([(r, g, b) for r in (0, 7, 90, 255) for g in (0, 33, 250) for b in (0, 128, 255)], "r int, g int, b int")
    back = colour.rgb(*colour.lab(F.col("r"), F.col("g"), F.col("b")))
    for r in rows.select("r", "g", "b", *[c.alias(n) for c, n in zip(back, "xyz", strict=True)]).collect():
        assert all(abs(r[a] - r[b]) < 0.6 for a, b in zip("rgb", "xyz", strict=True))


def test_normal_distribution(spark):
    got = spark.range(-30, 31).select("id", numbers.cdf(F.col("id") / 10, F.lit(0.5), F.lit(4.0)).alias("p")).collect()
    assert all(abs(r["p"] - 0.5 * (1 + math.erf((r["id"] / 10 - 0.5) / math.sqrt(8)))) < 2e-7 for r in got)


def test_documents_are_written_by_key(spark, tmp_path):
    write_regions(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n long"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("id=*")) == ["id=a", "id=b"]
    assert sorted(map(tuple, spark.read.json(str(tmp_path / "out")).select("id", "n").collect())) == [("a", 1), ("a", 2), ("b", 3)]


def run_stream(spark, build, source, schema, name, place):
    stream = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", place).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return spark.table(name).collect()


def test_states_velocities_and_late_results(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "u string, ts timestamp, kind string, value double"
    rows = [("u", t0 + timedelta(seconds=s), k, float(v)) for s, k, v in ((0, "end", 0), (1, "begin", 10), (2, "end", 14), (4, "reset", 14), (5, "begin", 15))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = run_stream(spark, lambda s: events.region_states(s, "u", "ts", "kind"), str(tmp_path / "in"), schema, "states", str(tmp_path / "c1"))
    assert [r["state"] for r in sorted(got, key=lambda r: r["at"])] == ["waiting", "processing", "finished", "waiting", "processing"]
    speeds = run_stream(spark, lambda s: events.damped_velocity(s, "u", "ts", "value"), str(tmp_path / "in"), schema, "speeds2", str(tmp_path / "c2"))
    want, m = [], 0.0
    for change in (1.0, 10.0, 4.0, 0.0, 1.0):
        m = 0.5 * m + 0.5 * change
        want.append(m)
    assert [r["velocity"] for r in sorted(speeds, key=lambda r: r["at"])] == pytest.approx(want)
    jobs = spark.createDataFrame([("a", t0), ("b", t0)], "job string, at timestamp")
    results = spark.createDataFrame([("a", t0 + timedelta(seconds=5), "text"), ("b", t0 + timedelta(seconds=90), "late")], "job string, at timestamp, text string")
    joined = events.jobs_with_results(jobs, results, "job", "60 seconds")
    assert sorted((r["j.job"] if "j.job" in joined.columns else r[0], r[-1]) for r in joined.collect()) == [("a", "text"), ("b", None)]


def test_restitched_stream_gives_the_batch_result_in_the_end(spark, tmp_path):
    lines = layout_queries.chunk_lines(frame(spark, SF, "lines").where("img < 2"))
    for c in range(4):
        lines.where(F.col("chunk") == c).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = run_stream(spark, lambda s: events.restitched(s, "img"), str(tmp_path / "in"), lines.schema, "restitched", str(tmp_path / "c"))
    assert len(got) > lines.count()
    last = {}
    for r in got:
        last[r["image"], r["id"]] = r["fate"]
    batch = {(str(r["img"]), r["id"]): r["fate"] for r in regions.stitched(lines, "img").collect()}
    assert last.keys() == batch.keys()
