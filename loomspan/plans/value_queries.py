"""Registered queries over scalars, recognised text, states and stacks, and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import numbers
from loomspan.operators import glyphs
from loomspan.operators.boxes import box_pairs
from loomspan.plans.catalog import EVENTS, query
from loomspan.plans.shapes import frame, sql
from loomspan.session import table

LETTERS = sql("letters")


@query("""WITH x AS (SELECT event_id, (value - 100) / 50 AS z FROM events), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM x)
SELECT event_id, round(CASE WHEN z >= 0 THEN 1 ELSE -1 END * (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z)), 6) + 0.0 AS erf FROM t""")
def error_function(spark, sf_dir):
    z = (F.col("value") - 100) / 50
    return table(spark, sf_dir, "events").select("event_id", (F.round(numbers.erf(z), 6) + 0.0).alias("erf"))


@query("SELECT event_id, round(list_reduce(list_prepend(event_id, range(17)), lambda s, i: (1664525 * s + 1013904223) % 4294967296) / 4294967296, 9) AS spot FROM events")
def scattered(spark, sf_dir):
    """Start positions from a linear congruential generator."""
    return table(spark, sf_dir, "events").select("event_id", F.round(numbers.scattered(F.col("event_id")), 9).alias("spot"))


@query("SELECT o_orderkey, o_orderkey & o_custkey AS both_, o_orderkey | o_custkey AS any_, xor(o_orderkey, o_custkey) AS one, ~o_orderkey AS none, (o_orderkey << 3) >> 1 AS moved, bit_count(o_orderkey) AS ones FROM orders")
def bit_work(spark, sf_dir):
    a, b = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(a, a.bitwiseAND(b).alias("both_"), a.bitwiseOR(b).alias("any_"), a.bitwiseXOR(b).alias("one"), F.bitwise_not(a).alias("none"), F.shiftright(F.shiftleft(a, 3), 1).alias("moved"), F.bit_count(a).cast("tinyint").alias("ones"))


@query("""WITH m AS (SELECT o_custkey, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') AS urgent, max(o_orderkey) FILTER (o_orderpriority = '5-LOW') AS low, count(DISTINCT o_orderpriority) AS n, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS keys FROM orders GROUP BY 1)
SELECT o_custkey, urgent IS NOT NULL AS has_urgent, low, n - CAST(low IS NOT NULL AS INT) AS left_, keys FROM m""")
def map_work(spark, sf_dir):
    """Keys present, read, deleted and listed of a map for each customer."""
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.max("o_orderkey").alias("k"))
    m = latest.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "k"))).alias("m"))
    rest = F.map_filter("m", lambda k, v: k != "5-LOW")
    keys = F.array_join(F.array_sort(F.map_keys("m")), "|")
    return m.select("o_custkey", F.map_contains_key("m", "1-URGENT").alias("has_urgent"), F.try_element_at("m", F.lit("5-LOW")).alias("low"), F.size(F.map_keys(rest)).cast("long").alias("left_"), keys.alias("keys"))


@query("""SELECT event_id, strftime(ts, '%a, %d %b %Y %H:%M:%S GMT') AS utc, ((epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01 00:00:00')) // 10) / 100 AS seconds,
epoch_ms(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(ts) // 1000 > 24 * 60 * 1000 AS stale FROM events""")
def event_dates(spark, sf_dir):
    """A UTC string, elapsed seconds, and whether a status is due for a refresh."""
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    start, now = F.lit("2024-01-01 00:00:00"), F.lit("2024-01-20 00:00:00")
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("utc"), (F.floor((ms(F.col("ts")) - ms(start)) / 10) / 100).alias("seconds"), (ms(now) - ms(F.col("ts")) > 24 * 60 * 1000).alias("stale"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY t, event_id) AS epoch FROM e), l AS (SELECT user_id, max(epoch) AS epoch FROM s GROUP BY 1)
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase') THEN 'finished' WHEN bool_or(event_type = 'click') THEN 'processing' ELSE 'waiting' END AS state FROM s JOIN l USING (user_id, epoch) GROUP BY user_id""")
def region_states(spark, sf_dir):
    """waiting, processing, finished; an error begins anew."""
    e = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    order = F.struct("at", "event_id")
    reset = e.where("event_type = 'error'").groupBy("user_id").agg(F.max(order).alias("reset"))
    after = e.join(reset, "user_id", "left").where(F.col("reset").isNull() | (order >= F.col("reset")))
    seen = lambda kind: F.bool_or(F.col("event_type") == kind)
    return after.groupBy("user_id").agg(F.when(seen("purchase"), F.lit("finished")).when(seen("click"), F.lit("processing")).otherwise(F.lit("waiting")).alias("state"))


@query("""WITH a AS (SELECT user_id, max(ts) FILTER (event_type = 'click') AS ocr, max(ts) FILTER (event_type = 'purchase') AS plaster, max(ts) FILTER (event_type = 'error') AS translate, count(*) AS n FROM events GROUP BY 1)
SELECT user_id, least(CASE WHEN n % 5 = 0 THEN -1 ELSE epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(ocr) // 1000 END, epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(plaster) // 1000,
 CASE WHEN n % 7 = 0 THEN -2 WHEN n % 3 = 0 THEN -1 ELSE epoch_ms(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(translate) // 1000 END) AS elapsed FROM a""")
def elapsed(spark, sf_dir):
    """The youngest of a region's results, -1 while one is processed, -2 while one waits."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    last = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("at")))
    a = e.groupBy("user_id").agg(last("click").alias("ocr"), last("purchase").alias("plaster"), last("error").alias("translate"), F.count("*").alias("n"))
    now = F.unix_millis(F.lit("2024-02-01 00:00:00").cast("timestamp"))
    age = lambda c: now - F.col(c)
    youngest = F.least(F.when(F.col("n") % 5 == 0, F.lit(-1)).otherwise(age("ocr")), age("plaster"), F.when(F.col("n") % 7 == 0, F.lit(-2)).when(F.col("n") % 3 == 0, F.lit(-1)).otherwise(age("translate")))
    return a.select("user_id", youngest.alias("elapsed"))


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, list(event_id ORDER BY t DESC, event_id DESC) AS l FROM e GROUP BY user_id) SELECT user_id, array_to_string(l[2:5], ',') AS left_ FROM s""")
def undo_stack(spark, sf_dir):
    """The four entries below the top of each user's stack: one is taken back."""
    e = table(spark, sf_dir, "events")
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    below = e.withColumn("k", F.row_number().over(newest)).where("k BETWEEN 2 AND 5").groupBy("user_id")
    return below.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "event_id"))), lambda s: s["event_id"].cast("string")), ",").alias("left_"))


@query(f"""WITH {EVENTS}, v AS (SELECT user_id, t, event_id, value, CASE WHEN t > lag(t) OVER w THEN (value - lag(value) OVER w) / ((t - lag(t) OVER w) / 3600) ELSE 1 END AS v, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS k
 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)), m AS (SELECT user_id, sum(v * power(0.5, k)) AS speed, arg_min(value, k) AS y FROM v GROUP BY user_id)
SELECT user_id, step, CAST(floor((y * 10 + speed * step / 5) / 160) AS BIGINT) AS chunk FROM m, (SELECT unnest(range(0, 6)) AS step)""")
def predicted_chunks(spark, sf_dir):
    """Chunks that a pointer with its damped velocity reaches in five steps."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1_000_000.0)).alias("t"))
    order = Window.partitionBy("user_id").orderBy("t", "event_id")
    hours = (F.col("t") - F.lag("t").over(order)) / 3600
    v = F.when(hours > 0, (F.col("value") - F.lag("value").over(order)) / hours).otherwise(1.0)
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("t"), F.desc("event_id")))
    m = e.withColumns({"v": v, "k": k}).groupBy("user_id").agg(F.sum(F.col("v") * F.pow(F.lit(0.5), "k")).alias("speed"), F.min_by("value", "k").alias("y"))
    steps = m.withColumn("step", F.explode(F.expr("sequence(0L, 5L)")))
    return steps.select("user_id", "step", F.floor((F.col("y") * 10 + F.col("speed") * F.col("step") / 5) / 160).alias("chunk"))


IMAGES = "images AS (SELECT p_partkey AS id, 100 + p_size * 9 AS width, 50 + p_size * 47 AS natural_width, 40 + p_size * 5 AS height, p_name AS alt, 'http' || CASE WHEN p_size % 7 = 0 THEN ':' ELSE 's:' END || '//' || repeat(p_brand, p_size) AS src, p_size % 11 = 0 AS switched_off, p_size % 3 = 0 AS linked, p_size / 50.0 AS text_share FROM part)"


@query(f"""WITH {IMAGES} SELECT id FROM images WHERE width > 150 AND natural_width > 150 AND natural_width < 2000 AND height > 60 AND least(width, natural_width) * height > 19000 AND length(src) < 300
AND regexp_matches(src, '^(https?|file):') AND NOT switched_off AND (NOT linked OR text_share <= 0.85)""")
def eligible_images(spark, sf_dir):
    """All conditions under which an image is read."""
    s = F.col("p_size")
    scheme = F.concat(F.lit("http"), F.when(s % 7 == 0, F.lit(":")).otherwise(F.lit("s:")), F.lit("//"), F.expr("repeat(p_brand, p_size)"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (100 + s * 9).alias("width"), (50 + s * 47).alias("natural"), (40 + s * 5).alias("height"), scheme.alias("src"), (s % 11 == 0).alias("off"), (s % 3 == 0).alias("linked"), (s / 50.0).alias("share"))
    size = "width > 150 AND natural > 150 AND natural < 2000 AND height > 60 AND least(width, natural) * height > 19000"
    return images.where(size).where((F.length("src") < 300) & F.col("src").rlike("^(https?|file):") & ~F.col("off") & (~F.col("linked") | (F.col("share") <= 0.85))).select("id")


#: Answers of two readers about pages of letters: some lines broken, some glyphs without a guess.
TABBED_LINE = "CASE WHEN s % 17 = 0 THEN 'noise ' || s ELSE CAST(CAST(x0 AS INT) AS STRING) || ' ' || CAST(CAST(y0 AS INT) AS STRING) || ' ' || CAST(CAST(width AS INT) AS STRING) || ' ' || CAST(CAST(height AS INT) AS STRING) || ' ' || s || '.5' || CASE WHEN s % 6 = 0 THEN ' SW' ELSE '' END || chr(9) || chr(CAST(97 + s % 26 AS INT)) END"
GUESSED_LINE = "CASE WHEN s % 19 = 0 THEN 'x ; y' ELSE '  ' || CAST(CAST(x0 AS INT) AS STRING) || '  ' || CAST(CAST(y0 AS INT) AS STRING) || ' ' || CAST(CAST(width AS INT) AS STRING) || ' ' || CAST(CAST(height AS INT) AS STRING) || '; ' || CASE WHEN s % 4 = 0 THEN '0' WHEN s % 4 = 1 THEN '1, ''' || chr(CAST(65 + s % 26 AS INT)) || '''' || s ELSE '2, ''' || chr(CAST(97 + s % 26 AS INT)) || '''' || s || ', ''o''3' END END"
RESPONSES = f"{LETTERS}, responses AS (SELECT page, string_agg({TABBED_LINE}, chr(10) ORDER BY id) AS tabbed, string_agg({GUESSED_LINE}, chr(10) ORDER BY id) AS guessed FROM letters GROUP BY page)"
SPLIT = "SELECT page, CAST(k - 1 AS INT) AS k, line FROM (SELECT page, generate_subscripts({c}l, 1) AS k, unnest({c}l) AS line FROM (SELECT page, string_split({c}, chr(10)) AS {c}l FROM responses))"


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = frame(spark, sf_dir, "letters").select("page", "id", F.expr(TABBED_LINE).alias("t"), F.expr(GUESSED_LINE).alias("g"))
    # a page is bounded by its pixels
    rows = letters.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("id", "t", "g"))).alias("r"))
    joined = lambda c: F.array_join(F.transform("r", lambda x: x[c]), "\n")
    return rows.select("page", joined("t").alias("tabbed"), joined("g").alias("guessed"))


TABBED = f"""{RESPONSES}, tl AS ({SPLIT.format(c="tabbed")}),
tabbed_glyphs AS (SELECT page, k, CAST(split_part(f, ' ', 1) AS DOUBLE) AS x, CAST(split_part(f, ' ', 2) AS DOUBLE) AS y, CAST(split_part(f, ' ', 3) AS DOUBLE) AS w, CAST(split_part(f, ' ', 4) AS DOUBLE) AS h,
 ends_with(f, ' SW') AS sw, split_part(line, chr(9), 2) AS best, CAST(split_part(f, ' ', 5) AS DOUBLE) AS conf, 1 AS guesses FROM (SELECT *, split_part(line, chr(9), 1) AS f FROM tl WHERE line NOT LIKE 'noise%'))"""
GUESSED = f"""{RESPONSES}, gl AS ({SPLIT.format(c="guessed")}),
guessed_glyphs AS (SELECT page, k, CAST(p[1] AS DOUBLE) AS x, CAST(p[2] AS DOUBLE) AS y, CAST(p[3] AS DOUBLE) AS w, CAST(p[4] AS DOUBLE) AS h, false AS sw, regexp_extract_all(line, '''(.)''(\\d+)', 1)[1] AS best,
 CAST(regexp_extract_all(line, '''(.)''(\\d+)', 2)[1] AS DOUBLE) AS conf, CAST(len(regexp_extract_all(line, '''(.)''(\\d+)', 1)) AS INT) AS guesses FROM (SELECT *, regexp_extract_all(split_part(line, ';', 1), '\\d+') AS p FROM gl WHERE line NOT LIKE 'x ;%'))"""


@query(f"WITH {TABBED} SELECT * FROM tabbed_glyphs")
def tabbed_glyphs(spark, sf_dir):
    return glyphs.tabbed_glyphs(glyphs.lines_of(_responses(spark, sf_dir).select("page", "tabbed"), "tabbed"))


@query(f"WITH {GUESSED} SELECT * FROM guessed_glyphs")
def guessed_glyphs(spark, sf_dir):
    return glyphs.guessed_glyphs(glyphs.lines_of(_responses(spark, sf_dir).select("page", "guessed"), "guessed"))


@query(f"""WITH {TABBED}, m AS (SELECT *, (page % 5 - 2) / 20.0 AS ang, x + w / 2 - 75 AS cx, y + h / 2 - 60 AS cy FROM tabbed_glyphs)
SELECT page, k, round(((cx * cos(ang) - cy * sin(ang) + 75) / 2 - w / 4) / 0.9, 6) AS x, round(((cx * sin(ang) + cy * cos(ang) + 60) / 2 - h / 4) / 0.9, 6) AS y, round(w / 1.8, 6) AS w FROM m""")
def unrotated_glyphs(spark, sf_dir):
    found = glyphs.tabbed_glyphs(glyphs.lines_of(_responses(spark, sf_dir).select("page", "tabbed"), "tabbed"))
    angle = (F.col("page") % 5 - 2) / F.lit(20.0)
    back = glyphs.unrotated(found, F.lit(150.0), F.lit(120.0), angle, F.lit(0.9), F.lit(2.0))
    return back.select("page", "k", *[F.round(c, 6).alias(c) for c in ("x", "y", "w")])


@query(f"""WITH {TABBED}, ln AS (SELECT page, row AS line, avg(cx) AS cx, avg(cy) AS cy, (page % 3 - 1) / 40.0 AS angle, min(x0) + 10 AS x0, max(x1) AS x1 FROM letters GROUP BY ALL),
b AS (SELECT l.page, line, min(l.y0 - ((l.cx - ln.cx) * tan(angle) + ln.cy)) AS low, max(l.y1 - ((l.cx - ln.cx) * tan(angle) + ln.cy)) AS high FROM letters l JOIN ln ON l.page = ln.page AND l.row = ln.line GROUP BY ALL),
t AS (SELECT page, line, trim(string_agg(CASE WHEN sw THEN ' ' ELSE '' END || best, '' ORDER BY x + w, k)) AS text FROM ln JOIN b USING (page, line) JOIN tabbed_glyphs g USING (page)
 WHERE g.x + w / 2 > x0 AND g.x + w / 2 < x1 AND y + h / 2 > (g.x + w / 2 - cx) * tan(angle) + cy + low AND y + h / 2 < (g.x + w / 2 - cx) * tan(angle) + cy + high GROUP BY ALL)
SELECT page, line, coalesce(text, '') AS text FROM ln LEFT JOIN t USING (page, line)""")
def line_texts(spark, sf_dir):
    """Text of each line: the glyphs of its tilted band from a start letter on, by their right edges."""
    letters, line = frame(spark, sf_dir, "letters").withColumnRenamed("row", "line"), ["page", "line"]
    axis = letters.groupBy(*line).agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), (F.min("x0") + 10).alias("s0"), F.max("x1").alias("s1")).withColumn("angle", (F.col("page") % 3 - 1) / F.lit(40.0))
    predicted = (F.col("cx") - F.col("mx")) * F.tan("angle") + F.col("my")
    band = letters.join(axis, line).groupBy(*line, "mx", "my", "angle", "s0", "s1").agg(F.min(F.col("y0") - predicted).alias("low"), F.max(F.col("y1") - predicted).alias("high"))
    lines = band.select(*line, F.col("mx").alias("cx"), F.col("my").alias("cy"), "angle", "low", "high", F.col("s0").alias("x0"), F.col("s1").alias("x1"))
    found = glyphs.tabbed_glyphs(glyphs.lines_of(_responses(spark, sf_dir).select("page", "tabbed"), "tabbed"))
    return glyphs.text_lines(found, lines, ["page"])


@query(f"""WITH {LETTERS}, seps AS (SELECT s_suppkey AS sep, s_suppkey % 40 AS page, CAST(s_suppkey * 17 % 140 AS DOUBLE) AS sx FROM supplier),
g AS (SELECT id, page, row, x0, lag(x1) OVER (PARTITION BY page, row ORDER BY x0, id) AS before FROM letters),
c AS (SELECT g.*, EXISTS (SELECT 1 FROM seps s WHERE s.page = g.page AND s.sx > before AND s.sx < g.x0) AS cut FROM g)
SELECT id, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY page, row ORDER BY x0, id) AS BIGINT) AS part FROM c""")
def separated_lines(spark, sf_dir):
    """Lines cut where a vertical separator stands between two letters."""
    order = Window.partitionBy("page", "row").orderBy("x0", "id")
    letters = frame(spark, sf_dir, "letters").select("id", "page", "row", "x0", F.lag("x1").over(order).alias("before"))
    spot = (F.col("s_suppkey") * 17 % 140).cast("double")
    seps = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 40).alias("page"), spot.alias("x0"), spot.alias("x1"))
    gaps = letters.where("before < x0").select("page", "id", F.col("before").alias("x0"), F.col("x0").alias("x1"))
    cuts = box_pairs(gaps, seps, ["page"], ["x"]).where("x0_r > x0_l AND x0_r < x1_l").select(F.col("id_l").alias("id")).distinct().withColumn("cut", F.lit(1))
    return letters.join(cuts, "id", "left").select("id", F.sum(F.coalesce("cut", F.lit(0))).over(order).alias("part"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'plain' ELSE 'json' END AS kind, CASE WHEN event_id % 5 = 0 THEN '{\"k\": ' || event_id ELSE json_extract_string(props, '$.k') END AS value FROM events")
def broken_json(spark, sf_dir):
    """Parsed where it is JSON, plain text where it is broken."""
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"k": '), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t")).withColumn("j", F.expr("try_parse_json(t)"))
    return e.select("event_id", F.when(F.col("j").isNull(), F.lit("plain")).otherwise(F.lit("json")).alias("kind"), F.coalesce(F.expr("try_variant_get(j, '$.k', 'string')"), "t").alias("value"))
