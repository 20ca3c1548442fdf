"""Registered queries of the kernels that march, walk, filter, fill and flood over pixels, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators import pixels as px
from loomspan.operators import colour_filter, floods, inpaint, strokes
from loomspan.plans.catalog import query
from loomspan.plans.pixel_queries import GRAY, LAB, SOBEL, _gray
from loomspan.plans.shapes import frame
from loomspan.session import large, materialise

LOW, HIGH = 200, 350

CANNY = f"""{SOBEL}, grad AS (SELECT img, y, x, dx, dy, abs(dx) + abs(dy) AS m,
 CASE WHEN abs(dy) > 2.414213562373095 * abs(dx) THEN 0 WHEN abs(dy) < 0.4142135623730951 * abs(dx) THEN 1 WHEN dx * dy > 0 THEN 1 ELSE -1 END AS sx,
 CASE WHEN abs(dy) > 2.414213562373095 * abs(dx) THEN 1 WHEN abs(dy) < 0.4142135623730951 * abs(dx) THEN 0 ELSE 1 END AS sy FROM sobel),
thin AS (SELECT g.img, g.y, g.x, g.m, g.dx, g.dy, g.img * 1600 + g.y * 40 + g.x AS p FROM grad g LEFT JOIN grad b ON b.img = g.img AND b.y = g.y - g.sy AND b.x = g.x - g.sx
 LEFT JOIN grad a ON a.img = g.img AND a.y = g.y + g.sy AND a.x = g.x + g.sx WHERE g.m > {LOW} AND g.m >= coalesce(b.m, 0) AND g.m > coalesce(a.m, 0)),
links AS (SELECT a.p AS a, b.p AS b FROM thin a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(oy, ox), thin b WHERE b.img = a.img AND b.y = a.y + oy AND b.x = a.x + ox),
reached(p) AS (SELECT p FROM thin WHERE m > {HIGH} UNION SELECT e.b FROM reached r JOIN links e ON e.a = r.p),
edges AS (SELECT img, y, x, m, CAST(dx AS DOUBLE) AS dx, CAST(dy AS DOUBLE) AS dy FROM thin JOIN reached USING (p))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    gradients = materialise(px.sobel(_gray(spark, sf_dir), ["img"], "v").selectExpr("img * 1600 + y * 40 + x AS p", "img", "y", "x", "dx", "dy"), "gradients")
    return materialise(strokes.canny(gradients, ["img"], "p", LOW, HIGH).join(large(gradients.drop("p")), ["img", "y", "x"]), "canny")


@query(f"WITH RECURSIVE {CANNY} SELECT img, y, x, CAST(m AS DOUBLE) AS m FROM edges")
def canny_edges(spark, sf_dir):
    """Thin edges, the weak ones where they hang together with a strong one."""
    return _edges(spark, sf_dir).select("img", "y", "x", "m")


RAYS = f"""{CANNY}, units AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 1.0::DOUBLE ELSE dx / sqrt(dx * dx + dy * dy) END AS ux, CASE WHEN dx = 0 AND dy = 0 THEN 0.0::DOUBLE ELSE dy / sqrt(dx * dx + dy * dy) END AS uy FROM edges),
steps AS (SELECT way, u.*, k, CAST(floor(x + ux * way * k + 0.5) AS BIGINT) AS tx, CAST(floor(y + uy * way * k + 0.5) AS BIGINT) AS ty FROM units u, (SELECT unnest(range(0, 35)) AS k), (VALUES (1), (-1)) d(way)),
met AS (SELECT s.way, s.img, s.y, s.x, min({{'k': s.k, 'ty': s.ty, 'tx': s.tx, 'facing': s.ux * e.ux + s.uy * e.uy}}) AS hit FROM steps s JOIN units e ON e.img = s.img AND e.y = s.ty AND e.x = s.tx WHERE s.k > 0 GROUP BY ALL),
rays AS (SELECT way, img, y, x, hit.k AS steps, sqrt(CAST(pow(hit.tx - x, 2) + pow(hit.ty - y, 2) AS DOUBLE)) AS width FROM met WHERE hit.facing < -1e-12)"""


@query(f"WITH RECURSIVE {RAYS} SELECT way, img, y, x, CAST(steps AS INT) AS steps, round(width, 6) AS width FROM rays")
def stroke_rays(spark, sf_dir):
    """Edge pixels whose ray meets an opposite edge, both ways."""
    edges = _edges(spark, sf_dir)
    both = [strokes.rays(edges, ["img"], way).select(F.lit(way).alias("way"), "img", "y", "x", "steps", F.round("width", 6).alias("width")) for way in (1, -1)]
    return both[0].unionByName(both[1])


@query(f"""WITH RECURSIVE {RAYS},
crossed AS (SELECT s.way, s.img, s.y, s.x, s.k, s.ty, s.tx, r.width FROM steps s JOIN rays r USING (way, img, y, x) WHERE s.k <= r.steps),
first AS (SELECT way, img, ty, tx, min(width) AS stroke FROM crossed GROUP BY ALL),
medians AS (SELECT way, img, c.y, c.x, list_sort(list(stroke))[count(*) // 2 + 1] AS median FROM crossed c JOIN first USING (way, img, ty, tx) WHERE k > 0 GROUP BY ALL),
offered AS (SELECT way, img, ty, tx, min(median) AS median FROM crossed JOIN medians USING (way, img, y, x) WHERE k > 0 GROUP BY ALL)
SELECT way, img, ty AS y, tx AS x, round(least(stroke, coalesce(median, stroke)), 6) AS stroke FROM first LEFT JOIN offered USING (way, img, ty, tx)""")
def stroke_widths(spark, sf_dir):
    """The stroke-width transform of every image, for light and for dark strokes."""
    edges = _edges(spark, sf_dir)
    both = [strokes.stroke_widths(edges, ["img"], way).select(F.lit(way).alias("way"), "img", "y", "x", F.round("stroke", 6).alias("stroke")) for way in (1, -1)]
    return both[0].unionByName(both[1])


#: Letters are runs of red-less pixels along a row; ink is whatever is dark.
GAPS = f"""{GRAY}, ink AS (SELECT img, y, x FROM gray WHERE v < 140), inked AS (SELECT img, y, x, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS i FROM pixels WHERE r < 45),
letters AS (SELECT img, y, min(x) AS x0, max(x) AS x1, img * 1600 + y * 40 + min(x) AS id FROM inked GROUP BY img, y, i),
following AS (SELECT img, y, id, x0, lag(x1) OVER w AS before, x1 - x0 + 1 AS n, lag(x1 - x0 + 1) OVER w AS n_before FROM letters WINDOW w AS (PARTITION BY img, y ORDER BY x0)),
gaps AS (SELECT img, y, id, before AS x0, x0 AS x1, 3 * (greatest(n, n_before) + 1) AS goal FROM following WHERE x0 - before > least(n, n_before)),
ends AS (SELECT img, y, min(x) AS s, max(x) + 1 AS e FROM (SELECT *, x - row_number() OVER (PARTITION BY img, y ORDER BY x) AS i FROM ink) GROUP BY img, y, i),
starts AS (SELECT g.img, g.y, g.id, g.goal, (e + greatest(s, x0)) // 2 AS mid FROM gaps g JOIN ends USING (img, y) WHERE e > x0 AND e < x1 AND greatest(s, x0) > 0),
walk(img, id, goal, start, way, t, yy, x, alive) AS (
 SELECT img, id, goal, mid, way, 0, y, mid, true FROM starts, (VALUES (1), (-1)) d(way)
 UNION ALL
 SELECT w.img, id, goal, start, way, t + 1, yy + way, CASE WHEN c.x IS NOT NULL THEN w.x WHEN r.x IS NOT NULL THEN w.x + 1 ELSE w.x - 1 END, c.x IS NOT NULL OR r.x IS NOT NULL OR l.x IS NOT NULL
 FROM walk w LEFT JOIN ink c ON c.img = w.img AND c.y = w.yy AND c.x = w.x LEFT JOIN ink r ON r.img = w.img AND r.y = w.yy AND r.x = w.x + 1 LEFT JOIN ink l ON l.img = w.img AND l.y = w.yy AND l.x = w.x - 1
 WHERE alive AND t < goal),
explored AS (SELECT img, id, goal, start, count(*) FILTER (alive AND t > 0) AS explored FROM walk GROUP BY ALL)"""


def _letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = strokes.runs(frame(spark, sf_dir, "pixels").where("r < 45"), ["img"]).withColumns({"id": F.expr("img * 1600 + y * 40 + x0"), "n": F.expr("x1 - x0 + 1")})
    row = Window.partitionBy("img", "y").orderBy("x0")
    return letters.withColumns({"before": F.lag("x1").over(row), "n_before": F.lag("n").over(row)})


def _separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _letters(spark, sf_dir).where("x0 - before > least(n, n_before)").selectExpr("img", "y", "id", "before AS x0", "x0 AS x1", "3 * (greatest(n, n_before) + 1) AS goal")
    ink = _gray(spark, sf_dir).where("v < 140").select("img", "y", "x")
    return strokes.separators(materialise(ink, "ink"), materialise(gaps, "gaps"), ["img"])


@query(f"WITH RECURSIVE {GAPS} SELECT img, id, start AS mid, goal, CAST(explored AS BIGINT) AS explored FROM explored")
def separator_walks(spark, sf_dir):
    """How far walks through ink come from every run of ink between two letters."""
    return _separators(spark, sf_dir).select("img", "id", "mid", "goal", "explored")


@query(f"""WITH RECURSIVE {GAPS}, cuts AS (SELECT DISTINCT id FROM explored WHERE explored > goal)
SELECT id, CAST(count(cuts.id) OVER (PARTITION BY img, y ORDER BY x0) AS BIGINT) AS part FROM letters LEFT JOIN cuts USING (id)""")
def crawled_lines(spark, sf_dir):
    """Rows of letters cut where a vertical separator, found by walking through ink, stands between two of them."""
    cuts = _separators(spark, sf_dir).where("explored > goal").select("id", F.lit(1).alias("cut")).distinct()
    letters = _letters(spark, sf_dir).join(large(cuts), "id", "left")
    return letters.select("id", F.count("cut").over(Window.partitionBy("img", "y").orderBy("x0")).alias("part"))


#: Letters are pixels with little red; a band of ten rows is a region.
FILTERED = f"""{LAB}, binned AS (SELECT img, y, x, CAST(floor((2 * l + 40) / 16 + 0.5) + 16 * floor((a + 128) / 16 + 0.5) + 256 * floor((bb + 128) / 16 + 0.5) AS INT) AS bin FROM lab),
contours AS (SELECT img, img * 4 + y // 10 AS region, y, x FROM pixels WHERE r < 45),
boxes AS (SELECT img, region, min(x) - 30 AS x0, max(x) + 30 AS x1, min(y) - 20 AS y0, max(y) + 20 AS y1 FROM contours GROUP BY ALL),
near AS (SELECT DISTINCT img, y + oy AS y, x + ox AS x FROM contours, (SELECT unnest(range(-4, 5)) AS oy), (SELECT unnest(range(-4, 5)) AS ox)),
counts AS (SELECT img, region, bin, count(*) FILTER (c.x IS NOT NULL) AS n, count(*) FILTER (c.x IS NULL) AS m
 FROM near JOIN binned USING (img, y, x) JOIN boxes b USING (img) LEFT JOIN (SELECT DISTINCT img, y, x FROM contours) c USING (img, y, x) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL),
ratios AS (SELECT img, region, bin + d AS bin, sum(n) / (1 + sum(m)) AS ratio FROM counts, (VALUES (0), (1), (-1), (16), (-16), (256), (-256)) o(d) GROUP BY ALL HAVING sum(n) / (1 + sum(m)) > 3)"""


def _contours(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels = frame(spark, sf_dir, "pixels").select("img", "y", "x", "r", "g", "b")
    return pixels, pixels.where("r < 45").selectExpr("img", "img * 4 + y DIV 10 AS region", "y", "x")


@query(f"WITH {FILTERED} SELECT img, y, x, max(region) AS region, CAST(floor(least(255, 2 * arg_max(ratio, region))) AS INT) AS marker FROM binned JOIN boxes USING (img) JOIN ratios USING (img, region, bin) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY ALL")
def local_colours(spark, sf_dir):
    """Pixels whose colour prevails in the letters of a region against a ring around them."""
    return colour_filter.local_colours(*_contours(spark, sf_dir), ["img"])


@query(f"WITH {FILTERED} SELECT img, region, bin, round(ratio, 6) AS ratio FROM ratios")
def prevailing_bins(spark, sf_dir):
    """Bins of 4,096 colours that prevail in a region's letters, each pixel counting for six bins around its own."""
    pixels, contours = _contours(spark, sf_dir)
    box = contours.groupBy("img", "region").agg((F.min("x") - 30).alias("x0"), (F.max("x") + 30).alias("x1"), (F.min("y") - 20).alias("y0"), (F.max("y") + 20).alias("y1"))
    coloured = pixels.select("img", "y", "x", colour_filter.colour_bin(F.col("r"), F.col("g"), F.col("b")).alias("bin"))
    near = colour_filter.in_boxes(colour_filter.marked(coloured, contours, ["img"]), box, ["img"])
    return colour_filter.prevailing_bins(near, ["img", "region"]).select("img", "region", "bin", F.round("ratio", 6).alias("ratio"))


#: The mask is blocks of pixels whose pooled colour is dark; times settle in at most 200 rounds.
MARCH = f"""{GRAY}, mask AS (SELECT img, y, x FROM gray WHERE (img, y // 5, x // 7) IN (SELECT (img, y // 5, x // 7) FROM gray GROUP BY img, y // 5, x // 7 HAVING avg(v) < 120)),
field AS (SELECT g.img, g.y, g.x, m.x IS NOT NULL AS masked FROM gray g LEFT JOIN mask m ON m.img = g.img AND m.y = g.y AND m.x = g.x),
rounds(k, img, y, x, masked, u) AS (
 SELECT 0, img, y, x, masked, CASE WHEN masked THEN 1e9 ELSE 0 END::DOUBLE FROM field
 UNION ALL
 SELECT k + 1, img, y, x, masked, CASE WHEN NOT masked THEN 0 WHEN abs(a - d) >= 1 THEN least(u, 1 + least(a, d)) ELSE least(u, (a + d + sqrt(2 - (a - d) * (a - d))) / 2) END FROM (
  SELECT *, least(coalesce(lag(u) OVER h, 1e9), coalesce(lead(u) OVER h, 1e9)) AS a, least(coalesce(lag(u) OVER v, 1e9), coalesce(lead(u) OVER v, 1e9)) AS d
  FROM rounds WHERE k < 60 WINDOW h AS (PARTITION BY img, y ORDER BY x), v AS (PARTITION BY img, x ORDER BY y))),
times AS (SELECT img, y, x, masked, u FROM rounds WHERE k = 60)"""


def _mask(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    gray = _gray(spark, sf_dir)
    block = ["img", F.expr("y DIV 5").alias("by"), F.expr("x DIV 7").alias("bx")]
    dark = gray.groupBy(*block).agg(F.avg("v").alias("mean")).where("mean < 120")
    mask = gray.select("y", "x", *block).join(large(dark), ["img", "by", "bx"], "left_semi").select("img", "y", "x")
    return frame(spark, sf_dir, "pixels").select("img", "y", "x", "r", "g", "b"), materialise(mask, "mask")


@query(f"WITH RECURSIVE {MARCH} SELECT img, y, x, round(u, 6) AS u FROM times WHERE masked")
def arrival_times(spark, sf_dir):
    """When a front from the mask's edge reaches each of its pixels."""
    return inpaint.arrivals(*_mask(spark, sf_dir), ["img"]).select("img", "y", "x", F.round("u", 6).alias("u"))


@query(f"""WITH RECURSIVE {MARCH},
target AS (SELECT img, y, x, u FROM times WHERE masked AND u <= 1), known AS (SELECT t.img, t.y, t.x, r, g, b FROM times t JOIN pixels p USING (img, y, x) WHERE NOT masked),
disc AS (SELECT oy, ox, CAST(oy * oy + ox * ox AS DOUBLE) AS sq FROM (SELECT unnest(range(-5, 6)) AS oy), (SELECT unnest(range(-5, 6)) AS ox) WHERE oy * oy + ox * ox BETWEEN 1 AND 25),
side AS (SELECT t.*, l.x IS NOT NULL AS l, r.x IS NOT NULL AS r, a.x IS NOT NULL AS a, d.x IS NOT NULL AS d FROM target t
 LEFT JOIN known l ON l.img = t.img AND l.y = t.y AND l.x = t.x - 1 LEFT JOIN known r ON r.img = t.img AND r.y = t.y AND r.x = t.x + 1
 LEFT JOIN known a ON a.img = t.img AND a.x = t.x AND a.y = t.y - 1 LEFT JOIN known d ON d.img = t.img AND d.x = t.x AND d.y = t.y + 1),
slope AS (SELECT *, CASE WHEN l = r THEN 0 WHEN r THEN -u ELSE u END AS sx, CASE WHEN a = d THEN 0 WHEN d THEN -u ELSE u END AS sy FROM side),
w AS (SELECT s.img, s.y, s.x, k.r, k.g, k.b, CASE WHEN k.r = 250 AND k.g = 254 AND k.b = 252 THEN 0 ELSE CAST(floor((abs(ox * sx + oy * sy) / (sq * sqrt(sq)) / (1 + u) + 1e-6::DOUBLE) * 1099511627776) AS BIGINT) END AS w
 FROM slope s, disc o JOIN known k ON k.img = s.img AND k.y = s.y + oy AND k.x = s.x + ox)
SELECT img, y, x, CAST(floor(CAST(sum(w * r) AS DOUBLE) / sum(w) + 0.5) AS INT) AS r, CAST(floor(CAST(sum(w * g) AS DOUBLE) / sum(w) + 0.5) AS INT) AS g, CAST(floor(CAST(sum(w * b) AS DOUBLE) / sum(w) + 0.5) AS INT) AS b FROM w GROUP BY ALL""")
def inpainted_edge(spark, sf_dir):
    """The first layer of a filled mask, which sees only pixels outside it."""
    return inpaint.inpaint(*_mask(spark, sf_dir), ["img"], ["r", "g", "b"], layers=1).where("layer = 1").select("img", "y", "x", "r", "g", "b")


@query()
def inpainted(spark, sf_dir):
    """Masks filled from their edges inwards, in the order in which a front reaches their pixels."""
    return inpaint.inpaint(*_mask(spark, sf_dir), ["img"], ["r", "g", "b"]).select("img", "y", "x", F.round("u", 6).alias("u"), "layer", "r", "g", "b")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels with the darkness of their block of two by two pixels, 0 where it is bright."""
    gray = _gray(spark, sf_dir)
    block = ["img", F.expr("y DIV 2").alias("by"), F.expr("x DIV 2").alias("bx")]
    dark = gray.groupBy(*block).agg(F.min("v").alias("low"))
    level = F.greatest(F.lit(0), 60 - F.col("low"))
    return gray.select("y", "x", *block).join(dark, ["img", "by", "bx"]).select("img", "y", "x", F.expr("img * 1600 + y * 40 + x").alias("p"), level.alias("level"))


@query()
def ratio_components(spark, sf_dir):
    """Dark pixels joined while their components' means are within a fifth of each other; components of ten pixels or more."""
    found = floods.ratio_components(_levels(spark, sf_dir), ["img"], "p", "level", 1.2)
    return found.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n >= 10").select("p", "component")


@query()
def priority_components(spark, sf_dir):
    """Floods from the darkest pixels down; components of ten pixels or more."""
    found = floods.priority_components(_levels(spark, sf_dir), ["img"], "p", "level")
    return found.withColumn("n", F.count("*").over(Window.partitionBy("component"))).where("n >= 10").select("p", "component")
