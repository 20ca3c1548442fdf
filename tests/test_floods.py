"""Components by ratio and by flood against plain versions."""

import heapq
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from loomspan.operators import floods
from loomspan.plans import kernel_queries

SF = "/root/testdata/sf0.001"
AROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]


def plain_floods(values, power=1.5):
    """Floods with a heap from the highest pixel left, each pixel taken by the first flood that reaches it."""
    owner = {}
    for seed in sorted(values, key=lambda p: (-values[p], p)):
        if seed in owner:
            continue
        owner[seed], heap = seed, [(-values[seed], seed)]
        while heap:
            _, (y, x) = heapq.heappop(heap)
            for dy, dx in AROUND:
                n = (y + dy, x + dx)
                if n in values and n not in owner and values[n] ** power > values[seed]:
                    owner[n] = seed
                    heapq.heappush(heap, (-values[n], n))
    return owner


def plain_ratios(values, ratio, name):
    """Rounds of joining by sets of pixels."""
    groups = {name[p]: {p} for p in values}
    while True:
        mean = {c: sum(Fraction(round(values[p] * 10**6)) for p in g) / len(g) / 10**6 for c, g in groups.items()}
        of = {p: c for c, g in groups.items() for p in g}
        able = {}
        for (y, x), c in of.items():
            for dy, dx in AROUND:
                d = of.get((y + dy, x + dx), c)
                if d != c:
                    like = float(max(mean[c], mean[d])) / float(min(mean[c], mean[d]))
                    if like <= ratio:
                        able.setdefault(c, set()).add((like, min(c, d), max(c, d)))
        if not able:
            return of
        chosen = {min(x)[1:] for x in able.values()}
        for a, b in chosen:
            ga, gb = (next(g for g in groups.values() if k in {name[p] for p in g}) for k in (a, b))
            if ga is not gb:
                groups = {c: g for c, g in groups.items() if g is not ga and g is not gb}
                whole = ga | gb
                groups[min(name[p] for p in whole)] = whole


def images():
    r = random.Random(6)
    noise = {(y, x): r.choice([0, 1, 1, 2, 5, 9, 20, 35]) for y in range(14) for x in range(15)}
    slope = {(y, x): 3.0 + 0.7 * x + (0.01 * y) ** 2 for y in range(5) for x in range(12)}
    hills = {(0, x): v for x, v in enumerate([100, 40, 21, 50, 90, 20.5, 20, 70, 8, 7, 6, 5, 4, 3, 2.5, 2.2, 2.1, 1, 1, 1])}
    return [noise, slope, hills, dict.fromkeys([(y, x) for y in range(6) for x in range(6)], 4.0), {(2, 2): 7}, {(0, 0): 0}]


@pytest.fixture
def pixels(spark):
    rows = [(i, y, x, 1000 * i + 20 * y + x, float(v)) for i, p in enumerate(images()) for (y, x), v in p.items()]
    return spark.createDataFrame(rows, "img long, y long, x long, p long, v double").withColumns({"c": F.lit(1), "n": F.lit(2), "into": F.lit(3)}).repartition(5)


def named(owner, i):
    least = {}
    for (y, x), s in owner.items():
        least[s] = min(least.get(s, 10**9), 1000 * i + 20 * y + x)
    return {1000 * i + 20 * y + x: least[s] for (y, x), s in owner.items()}


def test_floods(pixels):
    want = {}
    for i, p in enumerate(images()):
        want |= named(plain_floods({k: v for k, v in p.items() if v > 0}), i)
    assert {r["p"]: r["component"] for r in floods.priority_components(pixels, ["img"], "p", "v").collect()} == want
    assert floods.priority_components(pixels.limit(0), ["img"], "p", "v").count() == 0


@pytest.mark.parametrize("ratio", [1.3, 3.0])
def test_ratios(pixels, ratio):
    want = {}
    for i, p in enumerate(images()):
        live = {k: v for k, v in p.items() if v > 0}
        name = {(y, x): 1000 * i + 20 * y + x for y, x in live}
        want |= {name[k]: c for k, c in plain_ratios(live, ratio, name).items()}
    got = {r["p"]: r["component"] for r in floods.ratio_components(pixels, ["img"], "p", "v", ratio).collect()}
    assert got == want
    assert floods.ratio_components(pixels.limit(0), ["img"], "p", "v", ratio).count() == 0


def test_whole_table(spark):
    levels = kernel_queries._levels(spark, SF).where("level > 0").collect()
    values = {}
    for r in levels:
        values.setdefault(r["img"], {})[r["y"], r["x"]] = r["level"]
    want = {}
    for img, p in values.items():
        owner, least, size = plain_floods(p), {}, {}
        for (y, x), s in owner.items():
            least[s], size[s] = min(least.get(s, 10**9), img * 1600 + y * 40 + x), size.get(s, 0) + 1
        want |= {img * 1600 + y * 40 + x: least[s] for (y, x), s in owner.items() if size[s] >= 10}
    got = {r["p"]: r["component"] for r in kernel_queries.priority_components(spark, SF).collect()}
    assert got == want and len(set(got.values())) > 1
