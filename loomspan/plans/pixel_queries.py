"""Registered queries over pixels, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import colour
from loomspan.operators import pixels as px
from loomspan.operators.regions import grouped
from loomspan.plans.catalog import query
from loomspan.plans.shapes import frame, sql

PIXELS = sql("pixels")
GRAY = f"{PIXELS}, gray AS (SELECT img, y, x, (4899 * r + 9617 * g + 1868 * b + 8192) >> 14 AS v FROM pixels)"


def _gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = colour.gray(F.col("r"), F.col("g"), F.col("b"))
    return frame(spark, sf_dir, "pixels").select("img", "y", "x", v.alias("v"))


@query(f"WITH {GRAY} SELECT img, y, x, v FROM gray")
def gray(spark, sf_dir):
    return _gray(spark, sf_dir)


def _line(value: str, axis: str, weights: tuple[float, float, float], into: str, source: str) -> str:
    other = "x" if axis == "y" else "y"
    a, b, c = weights
    return f"SELECT *, {a} * coalesce(lag({value}) OVER w, {value}) + {b} * {value} + {c} * coalesce(lead({value}) OVER w, {value}) AS {into} FROM {source} WINDOW w AS (PARTITION BY img, {other} ORDER BY {axis})"


@query(f"WITH {GRAY}, h AS ({_line('v', 'x', (0.25, 0.5, 0.25), 'h', 'gray')}), s AS ({_line('h', 'y', (0.25, 0.5, 0.25), 's', 'h')}) SELECT img, y, x, CAST(round(s, 6) AS DOUBLE) AS s FROM s")
def blurred(spark, sf_dir):
    """A 3 x 3 Gaussian as two weighted moving windows."""
    out = px.separable(_gray(spark, sf_dir), ["img"], "v", [0.25, 0.5, 0.25], [0.25, 0.5, 0.25], "s")
    return out.select("img", "y", "x", F.round("s", 6).alias("s"))


SOBEL = f"""{GRAY}, a AS ({_line('v', 'x', (-1, 0, 1), 'da', 'gray')}), b AS ({_line('da', 'y', (1, 2, 1), 'dx', 'a')}),
c AS ({_line('v', 'x', (1, 2, 1), 'db', 'b')}), sobel AS ({_line('db', 'y', (-1, 0, 1), 'dy', 'c')})"""


@query(f"WITH {SOBEL} SELECT img, y, x, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy FROM sobel")
def gradients(spark, sf_dir):
    return px.sobel(_gray(spark, sf_dir), ["img"], "v").select("img", "y", "x", "dx", "dy")


CROSS = "(VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dy, dx)"


@query(f"WITH {GRAY}, m AS (SELECT * FROM gray WHERE v < 60) SELECT DISTINCT g.img, g.y, g.x FROM m, {CROSS}, gray g WHERE g.img = m.img AND g.y = m.y + dy AND g.x = m.x + dx")
def dilation(spark, sf_dir):
    pixels = _gray(spark, sf_dir)
    return px.dilated(pixels.where("v < 60"), pixels, ["img"])


@query(f"""WITH {GRAY}, m AS (SELECT * FROM gray WHERE v < 170)
SELECT img, y, x FROM m WHERE NOT EXISTS (SELECT 1 FROM gray g, {CROSS} WHERE g.v >= 170 AND g.img = m.img AND g.y = m.y + dy AND g.x = m.x + dx)""")
def erosion(spark, sf_dir):
    pixels = _gray(spark, sf_dir)
    return px.eroded(pixels.where("v < 170"), pixels, ["img"])


@query(f"WITH {GRAY} SELECT img, y // 2 AS y, x // 2 AS x, bool_or(v < 60) AS any_dark FROM gray GROUP BY ALL")
def or_pool(spark, sf_dir):
    half = [F.expr(f"{c} DIV 2").alias(c) for c in ("y", "x")]
    return _gray(spark, sf_dir).groupBy("img", *half).agg(F.bool_or(F.col("v") < 60).alias("any_dark"))


MASK = f"""{PIXELS}, mask AS (SELECT img * 1600 + y * 40 + x AS p, img, y, x, t % 53 = 0 AS seed FROM pixels WHERE r < 45),
edges AS (SELECT a.p AS a, b.p AS b FROM mask a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx), mask b WHERE b.img = a.img AND b.y = a.y + dy AND b.x = a.x + dx),
reached(p, root) AS (SELECT p, p FROM mask UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.p),
placed AS (SELECT p, min(root) AS component FROM reached GROUP BY p)"""


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = frame(spark, sf_dir, "pixels").where("r < 45").selectExpr("img * 1600 + y * 40 + x AS p", "img", "y", "x", "t % 53 = 0 AS seed")
    return px.components(mask, ["img"], "p")


@query(f"WITH RECURSIVE {MASK} SELECT p, component FROM placed")
def pixel_components(spark, sf_dir):
    """8-connected components of dark pixels."""
    return _components(spark, sf_dir).select("p", "component")


@query(f"""WITH RECURSIVE {MASK},
c AS (SELECT component, img, count(*) AS n, bool_or(seed) AS seeded, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM placed JOIN mask USING (p) GROUP BY ALL),
s AS (SELECT img, min(n) AS least, max(n) AS most FROM c WHERE seeded GROUP BY img)
SELECT component, n, seeded FROM c LEFT JOIN s USING (img)
WHERE seeded OR (n > least / 10 AND n < most * 2 AND x1 - x0 < 20 * (y1 - y0) AND y1 - y0 < 20 * (x1 - x0) AND x0 > 0 AND x1 < 39 AND y0 > 0 AND y1 < 39)""")
def kept_components(spark, sf_dir):
    """Components that touch a seed, and those of like size and shape off the image's edge."""
    boxes = [F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")]
    c = _components(spark, sf_dir).groupBy("component", "img").agg(F.count("*").alias("n"), F.bool_or("seed").alias("seeded"), *boxes)
    sizes = Window.partitionBy("img")
    seeded = F.when(F.col("seeded"), F.col("n"))
    c = c.withColumns({"least": F.min(seeded).over(sizes), "most": F.max(seeded).over(sizes)})
    alike = "n > least / 10 AND n < most * 2 AND x1 - x0 < 20 * (y1 - y0) AND y1 - y0 < 20 * (x1 - x0) AND x0 > 0 AND x1 < 39 AND y0 > 0 AND y1 < 39"
    return c.where(f"seeded OR ({alike})").select("component", "n", "seeded")


@query(f"""WITH RECURSIVE {MASK}, b AS (SELECT component, min(x) AS x0, max(x) AS x1, min(y) AS y0 FROM placed JOIN mask USING (p) GROUP BY 1)
SELECT p, (x - x0) + (y - y0) * (x1 - x0 + 1) AS shape, p % 40 AS x_of_p, p % 1600 // 40 AS y_of_p FROM placed JOIN mask USING (p) JOIN b USING (component)""")
def component_shapes(spark, sf_dir):
    """Pixels by their place in the box of their component, and their coordinates from one index."""
    found = _components(spark, sf_dir)
    box = Window.partitionBy("component")
    x0, x1, y0 = F.min("x").over(box), F.max("x").over(box), F.min("y").over(box)
    shape = (F.col("x") - x0) + (F.col("y") - y0) * (x1 - x0 + 1)
    return found.select("p", shape.alias("shape"), F.pmod("p", F.lit(40)).alias("x_of_p"), F.expr("p % 1600 DIV 40").alias("y_of_p"))


BINS = f"""{PIXELS}, bins AS (SELECT img, r // 16 AS l, g // 16 AS a, b // 16 AS b, count(*) AS n FROM pixels GROUP BY ALL HAVING count(*) > 1),
named AS (SELECT *, img * 4096 + l * 256 + a * 16 + b AS p FROM bins),
edges AS (SELECT u.p AS a, v.p AS b FROM named u JOIN named v ON u.img = v.img AND u.p <> v.p AND abs(u.l - v.l) <= 1 AND abs(u.a - v.a) <= 1 AND abs(u.b - v.b) <= 1),
reached(p, root) AS (SELECT p, p FROM named UNION SELECT e.b, r.root FROM reached r JOIN edges e ON e.a = r.p)"""


@query(f"""WITH RECURSIVE {BINS} SELECT img, root AS cluster, CAST(sum(n) AS BIGINT) AS weight, round(sum(l * n) / sum(n), 6) AS l, round(sum(a * n) / sum(n), 6) AS a, round(sum(b * n) / sum(n), 6) AS b
FROM named JOIN (SELECT p, min(root) AS root FROM reached GROUP BY p) USING (p) GROUP BY img, root""")
def colour_clusters(spark, sf_dir):
    """Connected occupied bins of colour space, with their weight and mean colour."""
    bins = frame(spark, sf_dir, "pixels").selectExpr("img", "r DIV 16 AS l", "g DIV 16 AS a", "b DIV 16 AS b").groupBy("img", "l", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    named = bins.withColumn("p", F.expr("img * 4096 + l * 256 + a * 16 + b"))
    steps = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1) if (x, y, z) > (0, 0, 0)]
    near = F.explode(F.array(*[F.struct((F.col("l") + x).alias("l"), (F.col("a") + y).alias("a"), (F.col("b") + z).alias("b")) for x, y, z in steps])).alias("s")
    ahead = named.select("img", F.col("p").alias("u"), near).select("img", "u", "s.*")
    edges = ahead.join(named.select("img", "l", "a", "b", F.col("p").alias("v")), ["img", "l", "a", "b"]).select(F.col("u").alias("a"), F.col("v").alias("b"))
    placed = grouped(named.withColumnRenamed("p", "id"), edges, "cluster")
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("n")) / F.sum("n"), 6).alias(c)
    return placed.groupBy("img", "cluster").agg(F.sum("n").alias("weight"), mean("l"), mean("a"), mean("b"))


@query(f"""WITH {PIXELS}, h AS (SELECT img, r // 32 AS bin, count(*) FILTER (x < 20) AS n_in, count(*) FILTER (x >= 20) AS n_out, count(*) AS n FROM pixels WHERE x < 24 OR x > 36 GROUP BY ALL),
k AS (SELECT img, least(8, n_in / (1 + n_out)) AS level, n FROM h WHERE least(8, n_in / (1 + n_out)) > 1),
c AS (SELECT img, CAST(floor(level) AS INT) AS bucket, sum(n) AS n FROM k GROUP BY ALL), u AS (SELECT *, sum(n) OVER (PARTITION BY img ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY img) AS total FROM c)
SELECT img, min(bucket) AS bucket, CASE WHEN min(bucket) = 8 THEN 4 ELSE 1 END AS threshold FROM u WHERE upto > total / 2 GROUP BY img""")
def bucket_medians(spark, sf_dir):
    """The median level of pixels by how much their colour prevails inside, in nine buckets; the last one raises the threshold."""
    inside = F.col("x") < 20
    h = frame(spark, sf_dir, "pixels").where("x < 24 OR x > 36").groupBy("img", F.expr("r DIV 32").alias("bin")).agg(F.count_if(inside).alias("n_in"), F.count_if(~inside).alias("n_out"), F.count("*").alias("n"))
    level = F.least(F.lit(8.0), F.col("n_in") / (1 + F.col("n_out")))
    buckets = h.withColumn("level", level).where("level > 1").groupBy("img", F.floor("level").cast("int").alias("bucket")).agg(F.sum("n").alias("n"))
    upto, all_ = F.sum("n").over(Window.partitionBy("img").orderBy("bucket")), F.sum("n").over(Window.partitionBy("img"))
    found = buckets.withColumns({"upto": upto, "total": all_}).where("upto > total / 2").groupBy("img").agg(F.min("bucket").alias("bucket"))
    return found.withColumn("threshold", F.when(F.col("bucket") == 8, 4).otherwise(1))


RINGS = f"""{GRAY}, m AS (SELECT * FROM gray WHERE v < 14),
d AS (SELECT g.img, g.y, g.x, g.v, min(abs(g.y - m.y) + abs(g.x - m.x)) AS ring FROM gray g JOIN m ON g.img = m.img AND abs(g.y - m.y) + abs(g.x - m.x) <= 10 GROUP BY ALL),
a AS (SELECT img, ring, avg(v * least(ring + 3, 10)) / 10 AS luma FROM d WHERE ring > 0 AND v <> 253 GROUP BY ALL)"""


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lumas of ten rings around a mask that casts a shadow over seven of them."""
    pixels = _gray(spark, sf_dir)
    near = px.rings(pixels.where("v < 14"), pixels, ["img"], 10)
    shaded = F.avg(F.col("v") * F.least(F.col("ring") + 3, F.lit(10))) / 10
    return near.join(pixels, ["img", "y", "x"]).where("v <> 253").groupBy("img", "ring").agg(shaded.alias("luma"))


@query(f"WITH {RINGS} SELECT img, CAST(ring AS INT) AS ring, round(luma, 6) AS luma FROM a")
def ring_lumas(spark, sf_dir):
    """Mean luma of the rings around a mask, without a sentinel colour."""
    return _rings(spark, sf_dir).select("img", "ring", F.round("luma", 6).alias("luma"))


@query(f"""WITH {RINGS}, r AS (SELECT img, max(luma) AS top, min(luma) AS low, arg_min(luma, ring) AS first FROM a GROUP BY img)
SELECT img, CAST(CASE WHEN top - low > 30 AND first < 85 THEN (SELECT min(ring) - 1 FROM a WHERE a.img = r.img AND luma > top - 10) ELSE 0 END AS INT) AS grow FROM r""")
def shadow_growth(spark, sf_dir):
    """By how many rings a mask grows: up to the first ring nearly as light as the lightest, if the first one is dark."""
    a = _rings(spark, sf_dir)
    img = Window.partitionBy("img")
    both = a.withColumns({"top": F.max("luma").over(img), "low": F.min("luma").over(img), "first": F.min_by("luma", "ring").over(img)})
    light = F.min(F.when(F.col("luma") > F.col("top") - 10, F.col("ring")))
    return both.groupBy("img", "top", "low", "first").agg(light.alias("light")).select("img", F.when((F.col("top") - F.col("low") > 30) & (F.col("first") < 85), F.col("light") - 1).otherwise(0).alias("grow"))


LAB = f"""{PIXELS}, s AS (SELECT img, y, x, r, g, b, {', '.join(f"CASE WHEN {c} / 255.0 > 0.04045 THEN power(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END AS {c}l" for c in 'rgb')} FROM pixels),
q AS (SELECT *, (rl * 0.4124 + gl * 0.3576 + bl * 0.1805) / 0.95047 AS vx, rl * 0.2126 + gl * 0.7152 + bl * 0.0722 AS vy, (rl * 0.0193 + gl * 0.1192 + bl * 0.9505) / 1.08883 AS vz FROM s),
f AS (SELECT *, {', '.join(f"CASE WHEN v{c} > 0.008856 THEN power(v{c}, 1 / 3.0) ELSE 7.787 * v{c} + 16 / 116.0 END AS f{c}" for c in 'xyz')} FROM q),
lab AS (SELECT img, y, x, r, g, b, 116 * fy - 16 AS l, 500 * (fx - fy) AS a, 200 * (fy - fz) AS bb FROM f)"""


@query(f"WITH {LAB} SELECT img, y, x, round(l, 4) AS l, round(a, 4) + 0.0 AS a, round(bb, 4) + 0.0 AS b, CAST(floor((2 * l + 40) / 16 + 0.5) AS BIGINT) AS bin_l FROM lab")
def lab_colours(spark, sf_dir):
    """L*a*b* of every pixel and its lightness bin."""
    pixels = frame(spark, sf_dir, "pixels")
    l_, a, b = colour.lab(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("img", "y", "x", F.round(l_, 4).alias("l"), (F.round(a, 4) + 0.0).alias("a"), (F.round(b, 4) + 0.0).alias("b"), F.floor((2 * l_ + 40) / 16 + 0.5).alias("bin_l"))


@query(f"""WITH {LAB}, d AS (SELECT img, y, x, l - lag(l) OVER w AS dl, sqrt(a * a + bb * bb) AS c1, sqrt(power(lag(a) OVER w, 2) + power(lag(bb) OVER w, 2)) AS c2, power(a - lag(a) OVER w, 2) + power(bb - lag(bb) OVER w, 2) AS dab
 FROM lab WINDOW w AS (PARTITION BY img, y ORDER BY x))
SELECT img, y, x, round(sqrt(dl * dl + power((c1 - c2) / (1 + 0.045 * c1), 2) + greatest(0, dab - power(c1 - c2, 2)) / power(1 + 0.015 * c1, 2)), 4) AS difference FROM d WHERE dl IS NOT NULL""")
def colour_differences(spark, sf_dir):
    """CIE94 difference of each pixel to the one before it."""
    lab = colour.lab(F.col("r"), F.col("g"), F.col("b"))
    named = frame(spark, sf_dir, "pixels").select("img", "y", "x", *[c.alias(n) for c, n in zip(lab, ("l", "a", "b2"), strict=True)])
    line = Window.partitionBy("img", "y").orderBy("x")
    both = named.withColumns({f"{c}_before": F.lag(c).over(line) for c in ("l", "a", "b2")}).where("l_before IS NOT NULL")
    side = lambda s: tuple(F.col(c + s) for c in ("l", "a", "b2"))
    return both.select("img", "y", "x", F.round(colour.difference(side(""), side("_before")), 4).alias("difference"))


@query(f"""WITH RECURSIVE {SOBEL}, mask AS (SELECT img * 1600 + y * 40 + x AS p, img, y, x, abs(dx) + abs(dy) > 900 AS strong FROM sobel WHERE abs(dx) + abs(dy) > 650),
edges AS (SELECT a.p AS a, b.p AS b FROM mask a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx), mask b WHERE b.img = a.img AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
reached(p) AS (SELECT p FROM mask WHERE strong UNION SELECT e.b FROM reached r JOIN edges e ON e.a = r.p)
SELECT p FROM reached""")
def linked_edges(spark, sf_dir):
    """Hysteresis: weak edge pixels count where they hang together with a strong one."""
    strength = F.abs("dx") + F.abs("dy")
    weak = px.sobel(_gray(spark, sf_dir), ["img"], "v").withColumn("m", strength).where("m > 650").selectExpr("img * 1600 + y * 40 + x AS p", "img", "y", "x", "m > 900 AS strong")
    found = px.components(weak, ["img"], "p")
    return found.withColumn("any", F.bool_or("strong").over(Window.partitionBy("component"))).where("any").select("p")


@query(f"""WITH {SOBEL}, g AS (SELECT img, y, x, abs(dx) + abs(dy) AS m,
 CASE WHEN abs(dy) > 2.414213562373095 * abs(dx) THEN 0 WHEN abs(dy) < 0.4142135623730951 * abs(dx) THEN 1 WHEN dx * dy > 0 THEN 1 ELSE -1 END AS sx,
 CASE WHEN abs(dy) > 2.414213562373095 * abs(dx) THEN 1 WHEN abs(dy) < 0.4142135623730951 * abs(dx) THEN 0 ELSE 1 END AS sy FROM sobel)
SELECT g.img, g.y, g.x, CAST(g.m AS DOUBLE) AS m FROM g LEFT JOIN g b ON b.img = g.img AND b.y = g.y - g.sy AND b.x = g.x - g.sx LEFT JOIN g a ON a.img = g.img AND a.y = g.y + g.sy AND a.x = g.x + g.sx
WHERE g.m >= coalesce(b.m, 0) AND g.m > coalesce(a.m, 0)""")
def thin_edges(spark, sf_dir):
    """Gradients that are the strongest along their direction, in four sectors."""
    return px.thinned(px.sobel(_gray(spark, sf_dir), ["img"], "v").select("img", "y", "x", "dx", "dy"), ["img"])


@query(f"""WITH {GRAY} SELECT img, CAST(floor((x - 4) * 1.5) AS BIGINT) AS x, CAST(floor((y - 2) * 1.5) AS BIGINT) AS y, count(*) AS n, round(min(20 + ((x - 20) * cos(0.3) + (y - 20) * sin(0.3)) * 0.9), 6) AS turned_x, round(max(20 + ((y - 20) * cos(0.3) - (x - 20) * sin(0.3)) * 0.9), 6) AS turned_y
FROM gray WHERE v < 60 AND x >= 4 AND y >= 2 GROUP BY ALL""")
def projected_mask(spark, sf_dir):
    """Mask pixels in a resized box, and turned by an angle at nine tenths of their size."""
    c, x, y = F.col, F.col("x") - 20, F.col("y") - 20
    cos, sin = F.cos(F.lit(0.3)), F.sin(F.lit(0.3))
    turned = _gray(spark, sf_dir).where("v < 60 AND x >= 4 AND y >= 2").withColumns({"tx": 20 + (x * cos + y * sin) * 0.9, "ty": 20 + (y * cos - x * sin) * 0.9})
    place = [F.floor((c("x") - 4) * 1.5).alias("px"), F.floor((c("y") - 2) * 1.5).alias("py")]
    grouped_ = turned.groupBy("img", *place).agg(F.count("*").alias("n"), F.round(F.min("tx"), 6).alias("turned_x"), F.round(F.max("ty"), 6).alias("turned_y"))
    return grouped_.select("img", F.col("px").alias("x"), F.col("py").alias("y"), "n", "turned_x", "turned_y")
