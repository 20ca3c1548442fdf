"""Kernels over pixels against plain loops on drawn shapes."""

import heapq
import math
import random

import pytest

from loomspan.operators import colour_filter, inpaint, strokes
from loomspan.operators import pixels as px


def picture(seed: int, height: int = 24, width: int = 31) -> dict:
    """(y, x) -> gray of a bright field with dark bars, a ring and some noise."""
    r = random.Random(seed)
    out = {}
    for y in range(height):
        for x in range(width):
            dark = 4 <= x <= 7 and 3 <= y < 20 or 11 <= y <= 13 and 3 <= x < 28 or 9 <= (y - 6) ** 2 + (x - 21) ** 2 <= 25
            out[y, x] = (20 if dark else 230) + r.randrange(-9, 10)
    return out


def as_frame(spark, pictures, name="v"):
    return spark.createDataFrame([(i, y, x, v) for i, p in enumerate(pictures) for (y, x), v in p.items()], f"img long, y long, x long, {name} int")


def unit(dx, dy):
    n = math.sqrt(dx * dx + dy * dy)
    return (1.0, 0.0) if n == 0 else (dx / n, dy / n)


def plain_strokes(edges, direction, longest=35):
    """edges: (y, x) -> (dx, dy) of one image."""
    first, rays = {}, []
    for (y, x), g in edges.items():
        ux, uy = unit(*g)
        ray = [(y, x)]
        for step in range(1, longest):
            p = (math.floor(y + uy * direction * step + 0.5), math.floor(x + ux * direction * step + 0.5))
            ray.append(p)
            if p in edges:
                ox, oy = unit(*edges[p])
                if ux * ox + uy * oy < -1e-12:
                    rays.append(ray)
                    width = math.hypot(p[0] - y, p[1] - x)
                    for q in ray:
                        first[q] = min(first.get(q, math.inf), width)
                break
    out = dict(first)
    for ray in rays:
        w = sorted(first[q] for q in ray[1:])
        for q in ray[1:]:
            out[q] = min(out[q], w[len(w) // 2])
    return out


@pytest.mark.parametrize("direction", [1, -1])
def test_stroke_widths(spark, direction):
    pictures = [picture(1), picture(2), {(0, 0): 3}]
    gradients = px.sobel(as_frame(spark, pictures), ["img"], "v").selectExpr("img * 10000 + y * 100 + x AS p", "img", "y", "x", "dx", "dy", "1 AS width", "2 AS stroke")
    edges = strokes.canny(gradients, ["img"], "p", 300, 500).join(gradients.drop("p"), ["img", "y", "x"])
    rows = edges.collect()
    assert len(rows) > 100
    want = {}
    for i in range(3):
        want |= {(i, *p): w for p, w in plain_strokes({(r["y"], r["x"]): (r["dx"], r["dy"]) for r in rows if r["img"] == i}, direction).items()}
    got = {(r["img"], r["y"], r["x"]): r["stroke"] for r in strokes.stroke_widths(edges, ["img"], direction).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in got)
    if direction < 0:  # against the gradient lies the dark side: bars of four and three pixels
        assert sum(2 <= w <= 6 for w in got.values()) > 0.5 * len(got)
    assert strokes.stroke_widths(edges.limit(0), ["img"], direction).count() == 0


def test_separator_walks(spark):
    r = random.Random(5)
    ink = {(y, x) for y in range(40) for x in range(60) if x in (20 + y // 9, 21 + y // 9) or r.random() < 0.2}
    gaps = [(k, 4 * k, 8, 55, goal) for k, goal in enumerate((1, 2, 9, 16, 17, 5, 30, 3))]
    want = {}
    for k, y, x0, x1, goal in gaps:
        streak = -1
        for x in range(x0, x1):
            if (y, x) in ink:
                streak = x if streak < 0 else streak
            elif streak > 0:
                total = 0
                for way in (1, -1):
                    at = (x + streak) // 2
                    for t in range(goal):
                        found = [d for d in (0, 1, -1) if (y + way * t, at + d) in ink]
                        if not found:
                            break
                        at += found[0]
                        total += 1
                want[k, (x + streak) // 2] = total
                streak = -1
            else:
                streak = -1
    mask = spark.createDataFrame([(1, *p, 0) for p in ink], "img long, y long, x long, goal int")
    given = spark.createDataFrame([(1, *g) for g in gaps], "img long, id long, y long, x0 long, x1 long, goal int")
    got = {(w["id"], w["mid"]): w["explored"] for w in strokes.separators(mask.drop("goal"), given, ["img"]).collect()}
    assert got == want
    assert strokes.separators(mask.drop("goal"), given.limit(0), ["img"]).count() == 0
    assert strokes.separators(mask.drop("goal").limit(0), given, ["img"]).count() == 0


def test_runs(spark):
    mask = spark.createDataFrame([(0, 1, x) for x in (3, 4, 5, 8, 9, 11)], "img long, y long, x long")
    assert sorted((r["x0"], r["x1"]) for r in strokes.runs(mask, ["img"]).collect()) == [(3, 5), (8, 9), (11, 11)]


def test_local_colours(spark):
    r = random.Random(3)
    colours = {(y, x): (200 + r.randrange(20), r.randrange(40), 60) if 10 <= y < 14 and x % 6 < 2 else (r.randrange(80, 120), 200, 200) for y in range(50) for x in range(70)}
    letters = [(0 if x < 30 else 1, y, x) for (y, x) in colours if 10 <= y < 14 and x % 6 < 2]
    pixels = spark.createDataFrame([(7, y, x, *c) for (y, x), c in colours.items()], "img long, y long, x long, r int, g int, b int")
    contours = spark.createDataFrame([(7, *p) for p in letters], "img long, region long, y long, x long")
    bins = {(q["y"], q["x"]): q["bin"] for q in pixels.select("y", "x", colour_filter.colour_bin(pixels["r"], pixels["g"], pixels["b"]).alias("bin")).collect()}
    inside = {p[1:] for p in letters}
    near = {(y + dy, x + dx) for y, x in inside for dy in range(-2, 3) for dx in range(-2, 3)}
    want = {}
    for region in (0, 1):
        own = [p[1:] for p in letters if p[0] == region]
        ys, xs = [y for y, _ in own], [x for _, x in own]
        box = [p for p in bins if min(ys) - 3 <= p[0] < max(ys) + 3 and min(xs) - 5 <= p[1] < max(xs) + 5]
        n, m = {}, {}
        for p in box:
            if p in near:
                for d in colour_filter.AROUND:
                    side = n if p in inside else m
                    side[bins[p] + d] = side.get(bins[p] + d, 0) + 1
        for p in box:
            ratio = n.get(bins[p], 0) / (1 + m.get(bins[p], 0))
            if ratio > 3:
                want[p] = (region, math.floor(min(255, 2 * ratio)))
    got = {(q["y"], q["x"]): (q["region"], q["marker"]) for q in colour_filter.local_colours(pixels, contours, ["img"], 2, (5, 3)).collect()}
    assert got == want and len(want) > 20
    assert colour_filter.local_colours(pixels, contours.limit(0), ["img"]).count() == 0


def plain_arrivals(pixels, mask):
    """Fast marching with a heap: a place is settled when it is the earliest of all that are not."""
    known = {p: 0.0 for p in pixels - mask}
    trial, best = [], {}

    def offer(p):
        at = lambda q: known.get(q, math.inf)
        a, b = sorted((min(at((p[0], p[1] - 1)), at((p[0], p[1] + 1))), min(at((p[0] - 1, p[1])), at((p[0] + 1, p[1])))))
        u = a + 1 if b - a >= 1 else (a + b + math.sqrt(2 - (b - a) ** 2)) / 2
        if u < best.get(p, math.inf):
            best[p] = u
            heapq.heappush(trial, (u, p))

    around = lambda p: [(p[0] + dy, p[1] + dx) for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    for p in mask & pixels:
        if any(q in known for q in around(p)):
            offer(p)
    while trial:
        u, p = heapq.heappop(trial)
        if p in known:
            continue
        known[p] = u
        for q in around(p):
            if q in mask and q in pixels and q not in known:
                offer(q)
    return {p: known.get(p) for p in mask & pixels}


def masks():
    r = random.Random(8)
    pixels = {(y, x) for y in range(30) for x in range(34)}
    blob = {(y, x) for y, x in pixels if (y - 13) ** 2 + (x - 15) ** 2 < 80 or 5 < x < 30 and 20 <= y < 24}
    return pixels, [blob, {p for p in pixels if r.random() < 0.5}, set(pixels), blob | {(-1, 3), (99, 99)}, set()]


@pytest.mark.parametrize("tile", [64, 7, 1])
def test_arrivals(spark, tile):
    pixels, many = masks()
    many = many if tile > 1 else [{p for p in many[0] if p[0] < 9}]
    field = spark.createDataFrame([(i, *p) for i in range(len(many)) for p in pixels], "img long, y long, x long")
    mask = spark.createDataFrame([(i, *p) for i, m in enumerate(many) for p in m], "img long, y long, x long")
    got = {(r["img"], r["y"], r["x"]): r["u"] for r in inpaint.arrivals(field, mask, ["img"], tile).collect()}
    want = {(i, *p): u for i, m in enumerate(many) for p, u in plain_arrivals(pixels, m).items()}
    assert got.keys() == want.keys()
    assert all((got[p] is None) == (want[p] is None) and (got[p] is None or math.isclose(got[p], want[p], rel_tol=1e-12)) for p in got)


def plain_inpaint(values, mask, radius):
    times = plain_arrivals(set(values), mask)
    seen = {p: (0.0, v) for p, v in values.items() if p not in mask}
    for layer in range(1, max(math.ceil(u) for u in times.values() if u is not None) + 1):
        fresh = {}
        for (y, x), u in times.items():
            if u is None or math.ceil(u) != layer:
                continue
            slope = []
            for dy, dx in ((1, 0), (0, 1)):
                up, down = seen.get((y + dy, x + dx)), seen.get((y - dy, x - dx))
                slope.append((up[0] - down[0]) / 2 if up and down else up[0] - u if up else u - down[0] if down else 0.0)
            total, norm = [0, 0, 0], 0
            for dy in range(-radius, radius + 1):
                for dx in range(-radius, radius + 1):
                    q = seen.get((y + dy, x + dx))
                    if q and 0 < dy * dy + dx * dx <= radius * radius and q[1] != (250, 254, 252):
                        square = float(dy * dy + dx * dx)
                        w = math.floor((abs(dx * slope[1] + dy * slope[0]) / (square * math.sqrt(square)) / (1 + abs(q[0] - u)) + 1e-6) * (1 << 40))
                        norm += w
                        total = [t + w * c for t, c in zip(total, q[1], strict=True)]
            fresh[y, x] = (u, tuple(math.floor(t / norm + 0.5) for t in total) if norm else values[y, x])
        seen |= fresh
    return {p: seen.get(p, (None, values[p]))[1] for p in times}


def test_inpaint(spark):
    r = random.Random(2)
    pixels, (blob, *_) = masks()
    values = {p: (250, 254, 252) if r.random() < 0.1 else (p[0] * 7, p[1] * 5, r.randrange(256)) for p in pixels}
    field = spark.createDataFrame([(1, *p, *c, 9, 9) for p, c in values.items()], "img long, y long, x long, r int, g int, b int, u int, layer int")
    mask = spark.createDataFrame([(1, *p) for p in blob], "img long, y long, x long")
    got = {(q["y"], q["x"]): (q["r"], q["g"], q["b"]) for q in inpaint.inpaint(field, mask, ["img"], ["r", "g", "b"], 3, tile=16).collect()}
    assert got == plain_inpaint(values, blob, 3)
    assert inpaint.inpaint(field, mask.limit(0), ["img"], ["r", "g", "b"]).count() == 0
    whole = inpaint.inpaint(field, field.select("img", "y", "x"), ["img"], ["r", "g", "b"]).collect()
    assert {(q["y"], q["x"]): (q["r"], q["g"], q["b"]) for q in whole} == values and all(q["layer"] is None for q in whole)
