"""Scores of letters: clusters of touching letters against all pairs, and few pairs where lines are even."""

import math
import random
from pathlib import Path

from loomspan.operators import regions
from loomspan.plans import layout_queries
from loomspan.plans.shapes import frame
from loomspan.session import scratch_dir


def plain(letters):
    out = {}
    for line in {x["line"] for x in letters}:
        own = [x for x in letters if x["line"] == line]
        name = {x["id"]: x["id"] for x in own}
        touch = lambda a, b: all(min(a[f"{c}1"], b[f"{c}1"]) - max(a[f"{c}0"], b[f"{c}0"]) > -2 for c in "xy")
        for _ in own:
            for a in own:
                for b in own:
                    if touch(a, b):
                        name[a["id"]] = name[b["id"]] = min(name[a["id"]], name[b["id"]])
        score = 0.0
        for c in set(name.values()):
            many = [x for x in own if name[x["id"]] == c]
            strokes = sorted(min(x["thickness"], x["size"] / min(x["width"], x["height"])) for x in many)
            score += strokes[len(strokes) // 2] * math.sqrt(max(x["width"] for x in many))
        out[line] = round(score, 6)
    return out


def test_scores_equal_all_pairs_and_even_lines_are_met_in_none(spark, monkeypatch):
    r, letters = random.Random(5), []
    for line in range(12):
        for j in range(14):
            x, y = float(r.randrange(40)), float(r.randrange(30)) if line % 2 else 3.0
            w, h = float(r.randrange(1, 7)), float(r.randrange(1, 7))
            letters.append({"line": line, "id": line * 100 + j, "x0": x, "x1": x + w, "y0": y, "y1": y + h, "width": w + 1, "height": h + 1, "thickness": float(r.randrange(1, 4)), "size": float(r.randrange(3, 30))})
    asked, pairs = [], regions.near_pairs
    monkeypatch.setattr(regions, "near_pairs", lambda items, *a, **b: asked.append(items) or pairs(items, *a, **b))
    schema = "line long, id long, x0 double, x1 double, y0 double, y1 double, width double, height double, thickness double, size double"
    frame = spark.createDataFrame([tuple(x.values()) for x in letters], schema)
    assert {q["line"]: round(q["score"], 6) for q in regions.letter_scores(frame, ["line"]).collect()} == plain(letters)
    assert {q["line"] % 2 for q in asked[0].select("line").distinct().collect()} == {1}


def test_built_regions_leave_only_their_last_table_of_lines(spark):
    lines = layout_queries.doubled_lines(frame(spark, "/root/testdata/sf0.001", "lines").where("img = 1"))
    there = lambda: set(Path(scratch_dir(spark).removeprefix("file:")).glob("placed-*"))
    before = there()
    assert regions.build_regions(lines, layout_queries._line_letters(lines), "img").count() and len(there() - before) == 1
