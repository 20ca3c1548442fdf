"""Registered queries of the layout operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import exprs
from loomspan.operators import boxes as boxes_
from loomspan.operators import graph, joins, sequences, stats
from loomspan.session import scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86_400


def query(sql: str | None = None):
    """Register a query with its SQL. The tables that its operators write are deleted when its own result is written; a query without any stays lazy."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        @wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with scratch(spark) as keep:
                out = f(spark, sf_dir)
                return keep(out, f.__name__) if keep.tables else out

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return run

    return register


def _seconds(column: str) -> F.Column:
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1_000_000.0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", _seconds("ts").alias("at"))


EVENTS = "e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1000000.0 AS t FROM events)"


@query("""
WITH h AS (SELECT l_returnflag, CAST(floor(l_quantity) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL),
c AS (SELECT l_returnflag, bin, sum(n) OVER u AS w, sum(bin * n) OVER u AS s, sum(n) OVER p AS tw, sum(bin * n) OVER p AS ts
      FROM h WINDOW u AS (PARTITION BY l_returnflag ORDER BY bin), p AS (PARTITION BY l_returnflag)),
b AS (SELECT l_returnflag, bin, tw, CASE WHEN tw > w THEN round(w * (tw - w) * pow(s / w - (ts - s) / (tw - w), 2), 3) ELSE 0 END AS between_ FROM c)
SELECT l_returnflag, CAST(arg_max(bin, between_ * 1000 - bin * 0.001) AS BIGINT) AS threshold, CAST(max(tw) AS BIGINT) AS n FROM b GROUP BY l_returnflag""")
def otsu_quantity(spark, sf_dir):
    return stats.otsu(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS med FROM lineitem GROUP BY l_returnflag")
def upper_median(spark, sf_dir):
    return stats.upper_medians(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("""
WITH m AS (SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS med FROM orders GROUP BY 1)
SELECT o_orderpriority, any_value(med) AS med, round(avg(abs(o_totalprice - med)), 4) AS mad FROM orders JOIN m USING (o_orderpriority) GROUP BY 1""")
def mad_price(spark, sf_dir):
    return stats.deviation_about_median(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice").withColumn("mad", F.round("mad", 4))


SLOPES = f"""
WITH {EVENTS}, s AS (SELECT a.user_id, (b.value - a.value) / (b.t - a.t) * 3600 AS slope FROM e a JOIN e b ON a.user_id = b.user_id AND a.t < b.t)
SELECT user_id, round(list_sort(list(slope))[count(*) // 2 + 1], 6) AS slope FROM s GROUP BY user_id"""


@query(SLOPES)
def theil_sen(spark, sf_dir):
    """The upper median of the slopes between all pairs of events of a user."""
    slopes = stats.theil_sen(_events(spark, sf_dir), "user_id", "at", "value").where("slope IS NOT NULL")
    return slopes.select("user_id", F.round(F.col("slope") * 3600, 6).alias("slope"))


@query(SLOPES)
def theil_sen_all(spark, sf_dir):
    """theil_sen under its earlier name."""
    return theil_sen(spark, sf_dir)


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    mean = stats.weighted_mean(F.col("l_discount"), F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(mean, 6).alias("mean"))


@query("""
SELECT l_returnflag, min(l_quantity) AS x0, max(l_quantity) AS x1, count(*) AS n, round(stddev_pop(l_quantity), 6) AS pop, round(stddev_samp(l_quantity), 6) AS samp
FROM lineitem GROUP BY 1""")
def spread(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.min(q).alias("x0"), F.max(q).alias("x1"), F.count("*").alias("n"), F.round(F.stddev_pop(q), 6).alias("pop"), F.round(F.stddev_samp(q), 6).alias("samp"))


@query("""
SELECT CAST(floor(l_quantity) AS INT) AS bin, count(*) FILTER (l_returnflag = 'N') AS n_in, count(*) FILTER (l_returnflag <> 'N') AS n_out
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'N') > 0.4 * (1 + count(*) FILTER (l_returnflag <> 'N'))""")
def hist_ratio(spark, sf_dir):
    return stats.dominant_bins(table(spark, sf_dir, "lineitem"), "l_quantity", F.col("l_returnflag") == "N", 0.4)


@query("""
WITH o AS (SELECT p_size AS x, CAST(floor(p_retailprice / 100) AS INT) AS y, count(*) AS n FROM part GROUP BY ALL),
s(dx, dy) AS (VALUES (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))
SELECT x + dx AS x, y + dy AS y, CAST(sum(n) AS BIGINT) AS votes FROM o, s GROUP BY ALL""")
def color_bins_neighbors(spark, sf_dir):
    binned = table(spark, sf_dir, "part").select(F.col("p_size").alias("x"), F.floor(F.col("p_retailprice") / 100).cast("int").alias("y"))
    return stats.neighbour_votes(binned, ["x", "y"])


@query("""
WITH h AS (SELECT l_returnflag, CAST(floor(l_quantity) AS INT) AS bin, count(*) AS n FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL),
m AS (SELECT l_returnflag, bin, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin RANGE BETWEEN 15 PRECEDING AND 14 FOLLOWING) AS BIGINT) AS mass FROM h)
SELECT l_returnflag, CAST(bin AS BIGINT) AS center, mass FROM m QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY mass DESC, bin) = 1""")
def densest_window(spark, sf_dir):
    return stats.densest_window(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", 15)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT DISTINCT user_id, 'click', 1 FROM events),
t AS (SELECT user_id, event_type, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY ALL)
SELECT user_id, event_type, n FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type DESC) = 1""")
def popularity_seeded(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    seed = events.select("user_id").distinct().select("user_id", F.lit("click").alias("event_type"), F.lit(1).cast("long").alias("n"))
    totals = counts.union(seed).groupBy("user_id", "event_type").agg(F.sum("n").alias("n"))
    return totals.groupBy("user_id").agg(F.max(F.struct("n", "event_type")).alias("b")).select("user_id", "b.event_type", "b.n")


GAPPED = f"WITH {EVENTS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e)"


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.with_gap(_events(spark, sf_dir), ["user_id"], ["at", "event_id"], "at")


@query(f"{GAPPED} SELECT event_id, user_id, round(gap, 3) AS gap FROM g")
def adjacent_gap(spark, sf_dir):
    return _gaps(spark, sf_dir).select("event_id", "user_id", F.round("gap", 3).alias("gap"))


@query(f"""{GAPPED}, s AS (SELECT *, sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS session FROM g)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(max(t) - min(t), 3) AS seconds FROM s GROUP BY ALL""")
def gap_sessions(spark, sf_dir):
    found = sequences.gap_sessions(_gaps(spark, sf_dir), ["user_id"], ["at", "event_id"], F.col("gap") > 43_200)
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.max("at") - F.min("at"), 3).alias("seconds"))


@query(f"""{GAPPED}, q AS (SELECT *, gap / 3600 AS hours FROM g),
h AS (SELECT user_id, CAST(floor(hours) AS INT) AS bin, count(*) AS n FROM q WHERE hours IS NOT NULL GROUP BY ALL),
c AS (SELECT user_id, bin, sum(n) OVER u AS w, sum(bin * n) OVER u AS s, sum(n) OVER p AS tw, sum(bin * n) OVER p AS ts
      FROM h WINDOW u AS (PARTITION BY user_id ORDER BY bin), p AS (PARTITION BY user_id)),
b AS (SELECT user_id, bin, CASE WHEN tw > w THEN round(w * (tw - w) * pow(s / w - (ts - s) / (tw - w), 2), 3) ELSE 0 END AS v FROM c),
t AS (SELECT user_id, CASE WHEN v > 0 THEN bin ELSE 0 END AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY v DESC, bin) = 1)
SELECT q.user_id, CAST(max(threshold) AS BIGINT) AS threshold, 1 + count(*) FILTER (hours > threshold) AS sessions FROM q JOIN t USING (user_id) GROUP BY q.user_id""")
def otsu_sessions(spark, sf_dir):
    hours = _gaps(spark, sf_dir).withColumn("hours", F.col("gap") / 3600)
    limits = stats.otsu(hours, ["user_id"], "hours").select("user_id", "threshold")
    return hours.join(limits, "user_id").groupBy("user_id").agg(F.max("threshold").alias("threshold"), (1 + F.count_if(F.col("hours") > F.col("threshold"))).alias("sessions"))


@query("""
WITH p AS (SELECT o_custkey, o_orderkey, o_totalprice - 2 * lag(o_totalprice) OVER w + lag(o_totalprice, 2) OVER w AS d2
           FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, round(sum(abs(d2)), 2) AS zigzag FROM p GROUP BY o_custkey""")
def second_diff(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = F.col("o_totalprice")
    bent = table(spark, sf_dir, "orders").withColumn("d2", p - 2 * F.lag(p).over(w) + F.lag(p, 2).over(w))
    return bent.groupBy("o_custkey").agg(F.round(F.sum(F.abs("d2")), 2).alias("zigzag"))


DAMPED = f"""WITH {EVENTS}, l AS (SELECT user_id, list(value ORDER BY t, event_id) AS v FROM e GROUP BY user_id)
SELECT user_id, round(list_reduce(list_prepend(0.0, v), lambda m, x: 0.5 * m + 0.5 * x), 6) AS ema FROM l"""


@query(DAMPED)
def ema(spark, sf_dir):
    """Damping m = 0.5 m + 0.5 v over all events of a user, as a weighted sum: the k-th from the end weighs 0.5 ** k."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("event_id")))
    weighed = _events(spark, sf_dir).select("user_id", (F.col("value") * F.pow(F.lit(0.5), newest)).alias("part"))
    return weighed.groupBy("user_id").agg(F.round(F.sum("part"), 6).alias("ema"))


@query(DAMPED)
def ema_all(spark, sf_dir):
    """ema under its earlier name."""
    return ema(spark, sf_dir)


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1)
SELECT day, round(avg(total) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 2) AS mean FROM d""")
def box_mean(spark, sf_dir):
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("total"))
    return days.select("day", F.round(F.avg("total").over(Window.orderBy("day").rowsBetween(-3, 3)), 2).alias("mean"))


@query("""
WITH h AS (SELECT l_returnflag, CAST(l_quantity AS INT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, bin, CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS BIGINT) AS upto FROM h""")
def cumulative_hist(spark, sf_dir):
    w = Window.partitionBy("l_returnflag").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    return stats.histogram(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity").select("l_returnflag", "bin", F.sum("n").over(w).alias("upto"))


@query(f"""{GAPPED}, s AS (SELECT *, sum(CASE WHEN gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g)
SELECT user_id, round(min(t), 6) AS start, round(max(t), 6) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def idle_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("ts", "6 hours 1 microsecond").alias("w")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n"))
    return found.select("user_id", F.round(_seconds("a"), 6).alias("start"), F.round(_seconds("b"), 6).alias("last"), "n")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("user_id", "event_id", F.col("at").alias("x0"), (F.col("at") + F.col("value") * 100).alias("x1")).where("x1 >= x0")


SPANS = f"WITH {EVENTS}, s AS (SELECT user_id, event_id, t AS x0, t + value * 100 AS x1 FROM e WHERE value >= 0)"


@query(f"""{SPANS} SELECT a.event_id AS a, b.event_id AS b, round(least(a.x1, b.x1) - greatest(a.x0, b.x0), 3) AS shared
FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.x0 <= b.x1 AND b.x0 <= a.x1""")
def range_join(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    pairs = boxes_.near_pairs(spans, ["user_id"], ["x"], order=("event_id",))
    shared = F.least("x1_l", "x1_r") - F.greatest("x0_l", "x0_r")
    return pairs.select(F.col("event_id_l").alias("a"), F.col("event_id_r").alias("b"), F.round(shared, 3).alias("shared"))


@query("""
WITH b AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x0, p_size + 2.0 AS x1, p_retailprice / 10 AS y0, p_retailprice / 10 + 4 AS y1 FROM part)
SELECT a.p_partkey AS a, b.p_partkey AS b FROM b a JOIN b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.2 * 8""")
def box_overlap(spark, sf_dir):
    y = F.col("p_retailprice") / 10
    boxes = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 2.0).alias("x1"), y.alias("y0"), (y + 4).alias("y1"))
    pairs = boxes_.near_pairs(boxes, ["p_brand"], order=("p_partkey",))
    c = F.col
    area = exprs.overlap(c("x0_l"), c("x1_l"), c("x0_r"), c("x1_r")) * exprs.overlap(c("y0_l"), c("y1_l"), c("y0_r"), c("y1_r"))
    return pairs.where(area > 0.2 * 8).select(c("p_partkey_l").alias("a"), c("p_partkey_r").alias("b"))


@query(f"""
WITH {EVENTS}, p AS (SELECT * FROM e WHERE event_type = 'purchase'), c AS (SELECT * FROM e WHERE event_type = 'click'),
j AS (SELECT p.event_id, c.event_id AS hit, c.t AS hit_at FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.t BETWEEN p.t - 86400 AND p.t)
SELECT event_id, arg_max(hit, hit_at * 10000000 + hit) AS hit FROM j GROUP BY event_id""")
def nearest(spark, sf_dir):
    events = _events(spark, sf_dir)
    found = joins.nearest_before(events.where("event_type = 'purchase'").select("event_id", "user_id", "at"), events.where("event_type = 'click'"), "user_id", "at", ["event_id"], float(DAY))
    return found.select("event_id", F.col("hit.event_id").alias("hit"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate FROM lineitem)
SELECT o_orderkey, max(l_shipdate) AS last_ship, arg_max(l_linenumber, epoch_us(l_shipdate) * 10 + l_linenumber) AS line FROM orders LEFT JOIN l ON o_orderkey = l_orderkey AND l_shipdate <= o_orderdate + INTERVAL 60 DAY GROUP BY o_orderkey""")
def asof_orders(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS"))
    latest = F.max_by("l_linenumber", F.struct("l_shipdate", "l_linenumber"))
    return orders.join(lines, on, "left").groupBy("o_orderkey").agg(F.max("l_shipdate").alias("last_ship"), latest.alias("line"))


@query(f"""{SPANS}, j AS (SELECT a.event_id AS a, b.event_id AS b, round(least(a.x1, b.x1) - greatest(a.x0, b.x0), 6) AS shared
FROM s a JOIN s b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND a.x0 <= b.x1 AND b.x0 <= a.x1)
SELECT a, b, shared FROM j QUALIFY row_number() OVER (PARTITION BY a ORDER BY shared DESC, b DESC) = 1""")
def best_overlap(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    pairs = joins.overlap_join(spans, spans, ["user_id"]).where("event_id_l <> event_id_r")
    shared = F.round(F.least("x1_l", "x1_r") - F.greatest("x0_l", "x0_r"), 6)
    best = pairs.groupBy(F.col("event_id_l").alias("a")).agg(F.max(F.struct(shared.alias("shared"), F.col("event_id_r").alias("b"))).alias("m"))
    return best.select("a", "m.b", "m.shared")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def semi_unseen(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def anti_unseen(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    return table(spark, sf_dir, "customer").join(open_, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(f"""{SPANS}, p AS (SELECT user_id, event_id, x0 AS x FROM s)
SELECT s.event_id, count(DISTINCT p.event_id) AS inside FROM s JOIN p ON s.user_id = p.user_id AND s.event_id <> p.event_id AND p.x BETWEEN s.x0 AND s.x1 GROUP BY 1 HAVING count(DISTINCT p.event_id) >= 2""")
def occlusion_count(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    points = spans.select("user_id", "event_id", "x0", F.col("x0").alias("x1"))
    pairs = joins.overlap_join(spans, points, ["user_id"]).where("event_id_l <> event_id_r")
    return pairs.groupBy(F.col("event_id_l").alias("event_id")).agg(F.countDistinct("event_id_r").alias("inside")).where("inside >= 2")


@query("""
WITH RECURSIVE g AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN o_orderdate - lag(o_orderdate) OVER w <= INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
k AS (SELECT o_orderkey, o_custkey, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS island FROM g)
SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey, island) AS component FROM k""")
def components(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", _seconds("o_orderdate").alias("x0"))
    spans = orders.withColumn("x1", F.col("x0") + F.lit(3.0 * DAY))
    edges = joins.overlap_join(spans, orders.withColumn("x1", F.col("x0")), ["o_custkey"]).where("o_orderkey_l <> o_orderkey_r")
    found = graph.connected_components(edges, "o_orderkey_l", "o_orderkey_r")
    return orders.join(found, F.col("o_orderkey") == F.col("node"), "left").select("o_orderkey", F.coalesce("component", "o_orderkey").alias("component"))


@query("""
WITH i AS (SELECT o_custkey, o_orderkey, epoch_us(min(o_orderdate)) / 86400000000.0 AS a, epoch_us(max(l_shipdate)) / 86400000000.0 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL),
v AS (SELECT * FROM i WHERE b >= a),
f AS (SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS fresh FROM v),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT o_custkey, round(min(a), 6) AS start, round(max(b), 6) AS "end", count(*) AS n FROM k GROUP BY o_custkey, island""")
def interval_merge(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    spans = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg((F.min(_seconds("o_orderdate")) / DAY).alias("a"), (F.max(_seconds("l_shipdate")) / DAY).alias("b"))
    merged = sequences.merged_intervals(spans.where("b >= a"), ["o_custkey"], "a", "b")
    return merged.select("o_custkey", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"), "n")


@query("""
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(chunk * 160 AS BIGINT) AS top, least(chunk * 160 + 250, greatest(n_chars, 250)) AS bottom
FROM (SELECT doc_id, n_chars, unnest(generate_series(0, greatest(1, CAST(ceil((n_chars - 90) / 160.0) AS BIGINT)) - 1)) AS chunk FROM documents)""")
def chunk_cover(spark, sf_dir):
    found = sequences.chunks(table(spark, sf_dir, "documents"), "n_chars", 250, 90)
    return found.select("doc_id", "chunk", F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom"))


@query("""
WITH p AS (SELECT doc_id, n_chars, n_chars // 2 AS y, greatest(1, CAST(ceil((n_chars - 90) / 160.0) AS BIGINT)) - 1 AS last_ FROM documents),
o AS (SELECT *, least(y // 160, last_) AS own FROM p)
SELECT doc_id, CAST(own AS VARCHAR) || CASE WHEN own >= 1 AND y < (own - 1) * 160 + 250 THEN ',' || CAST(own - 1 AS VARCHAR) ELSE '' END AS chunks FROM o""")
def to_chunks(spark, sf_dir):
    y = F.floor(F.col("n_chars") / 2)
    found = sequences.candidate_chunks(y, F.col("n_chars"), 250, 90)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(found, lambda c: c.cast("string")), ",").alias("chunks"))


@query("""
SELECT o_custkey, min(x0) AS x0, max(x1) AS x1, CAST(sum(n) AS BIGINT) AS n, string_agg(CAST(o_orderkey AS VARCHAR), '-' ORDER BY o_orderkey) AS id FROM orders
JOIN (SELECT l_orderkey, min(l_quantity) AS x0, max(l_quantity) AS x1, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def rollup_boxes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("x0"), F.max("l_quantity").alias("x1"), F.count("*").alias("n"))
    both = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), "-")
    return both.groupBy("o_custkey").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("n").alias("n"), ids.alias("id"))


@query("SELECT page_id FROM pages WHERE length(url) < 300 AND regexp_matches(url, '^(https?|file):') AND length(html) > 150")
def eligibility(spark, sf_dir):
    return table(spark, sf_dir, "pages").where((F.length("url") < 300) & F.col("url").rlike("^(https?|file):") & (F.length("html") > 150)).select("page_id")


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_]+', '-', 'g') AS id FROM pages")
def id_clean(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9_]+", "-").alias("id"))


@query("SELECT page_id, sha256(url) AS probe FROM pages WHERE sha256(url) IN (SELECT sha256(url) FROM pages WHERE url LIKE '%.com/%')")
def sha_probe(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.sha2("url", 256).alias("probe"))
    return pages.join(pages.where(F.col("url").like("%.com/%")).select("probe"), "probe", "left_semi").select("page_id", "probe")


@query(r"""SELECT item_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 2 AND w <> upper(w) AND NOT regexp_matches(w, '^[A-Za-z][a-z]*[a-z.''",!?-]$'))) > 0 AS garbled FROM benchmark""")
def bad_text(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", exprs.looks_garbled(F.col("text")).alias("garbled"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: length(w) > 2 AND w <> upper(w) AND NOT regexp_matches(w, '^[A-Za-z][a-z]*[a-z.''",!?-]$'))) > 0 AS garbled FROM documents""")
def bad_text_documents(spark, sf_dir):
    """As bad_text, over whole documents."""
    return table(spark, sf_dir, "documents").select("doc_id", exprs.looks_garbled(F.col("text")).alias("garbled"))


@query(r"""SELECT conv_id, turn, reverse(text) AS backwards, regexp_replace(replace(text, chr(10), ' '), '- +', '', 'g') AS joined FROM conversations""")
def reverse_dehyphen(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.reverse("text").alias("backwards"), exprs.dehyphenate(F.col("text")).alias("joined"))


@query(r"""
WITH w AS (SELECT item_id, regexp_split_to_array(text, ' ') AS words FROM benchmark)
SELECT item_id, list_aggregate(list_transform(words, lambda w: CASE WHEN NOT regexp_matches(w, '^[A-Za-z]{3,}$') THEN w
  WHEN regexp_extract(w, '^([^aeiouAEIOU]*)', 1) = '' THEN w || 'way'
  WHEN regexp_matches(w[1], '[A-Z]') THEN upper((w[length(regexp_extract(w, '^([^aeiouAEIOU]*)', 1)) + 1:] || regexp_extract(w, '^([^aeiouAEIOU]*)', 1))[1])
       || lower((w[length(regexp_extract(w, '^([^aeiouAEIOU]*)', 1)) + 1:] || regexp_extract(w, '^([^aeiouAEIOU]*)', 1))[2:]) || 'ay'
  ELSE w[length(regexp_extract(w, '^([^aeiouAEIOU]*)', 1)) + 1:] || regexp_extract(w, '^([^aeiouAEIOU]*)', 1) || 'ay' END), 'string_agg', ' ') AS pig FROM w""")
def pig_latin(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.transform(F.split("text", " "), exprs.pig_word), " ").alias("pig"))


@query(r"""
SELECT item_id, list_reduce(regexp_split_to_array(text, '\s+'), lambda lines, word: CASE WHEN length(string_split(lines, chr(10))[-1]) + length(word) < 40 THEN lines || ' ' || word ELSE lines || chr(10) || word END) AS wrapped
FROM benchmark""")
def wrap_greedy(spark, sf_dir):
    """Lines of at most 40 characters, filled greedily; a longer word stands alone."""
    words = F.split("text", r"\s+")
    start = F.array().cast("array<string>")

    def fill(lines, word):
        last = F.element_at(lines, -1)
        fits = (F.size(lines) > 0) & (F.length(last) + F.length(word) < 40)
        return F.when(fits, F.concat(F.slice(lines, 1, F.size(lines) - 1), F.array(F.concat_ws(" ", last, word)))).otherwise(F.concat(lines, F.array(word)))

    safe = lambda lines, word: F.when(F.size(lines) == 0, F.array(word)).otherwise(fill(lines, word))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.aggregate(words, start, safe), "\n").alias("wrapped"))


@query("""SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS region, CASE WHEN turn = 0 THEN NULL ELSE turn END AS line FROM conversations""")
def token_roundtrip(spark, sf_dir):
    """Locators written as (IDX:a&b:XDI), with ! for null and 0, and read again."""
    slot = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0)).cast("string"), F.lit("!"))
    token = F.concat(F.lit("see (IDX:"), F.concat_ws("&", F.col("conv_id").cast("string"), slot("turn")), F.lit(":XDI) there"))
    parts = F.split(F.regexp_extract("token", r"\(IDX:(.*?):XDI\)", 1), "&")
    both = table(spark, sf_dir, "conversations").withColumn("token", token)
    return both.select("conv_id", "turn", parts[0].alias("region"), F.nullif(parts[1], F.lit("!")).cast("long").alias("line"))


@query("""SELECT p_partkey, CAST(p_size AS BIGINT) AS x, CAST(p_partkey % 97 AS BIGINT) AS y, 3 AS w, 7 AS h, substr(p_brand, 1, 1) AS best FROM part""")
def glyph_parse(spark, sf_dir):
    """Glyph lines `x y w h; g, 'c'conf` are written from part and parsed."""
    text = F.format_string("%d %d 3 7; 1, '%s'%d", F.col("p_size"), F.col("p_partkey") % 97, F.substr("p_brand", F.lit(1), F.lit(1)), F.lit(9))
    lines = table(spark, sf_dir, "part").select("p_partkey", text.alias("line"))
    number = lambda k: F.regexp_extract("line", r"^\s*(\d+)\s+(\d+)\s+(\d+)\s+(\d+)\s*;\s*(\d+)(,?.+)?$", k)
    return lines.select("p_partkey", number(1).cast("long").alias("x"), number(2).cast("long").alias("y"), number(3).cast("int").alias("w"), number(4).cast("int").alias("h"), F.regexp_extract("line", r"'(.+?)'(\d+)", 1).alias("best"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fallback(spark, sf_dir):
    """A field of JSON text; null where the text is not JSON."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long", {"mode": "PERMISSIVE"})["k"].alias("k"))


@query("SELECT vec_id, CAST(pos - 1 AS INT) AS pos, CAST(v AS DOUBLE) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
def nested_flatten(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_dedup(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query(f"WITH {EVENTS} SELECT event_id FROM e QUALIFY t >= max(t) OVER (PARTITION BY user_id) - 7200")
def expiry(spark, sf_dir):
    """Events no older than two hours before the newest of their user: the batch form of the stream's expiry."""
    events = _events(spark, sf_dir)
    newest = events.groupBy(F.col("user_id").alias("u")).agg(F.max("at").alias("newest"))
    return events.join(newest, F.col("user_id") == F.col("u")).where(F.col("at") >= F.col("newest") - 7200).select("event_id")


@query("""SELECT p_partkey, CAST(floor(p_retailprice / 7 + 0.5) AS BIGINT) AS rounded, (SELECT string_agg(substr('0123456789abcdefghijklmnopqrstuvwxyz', CAST(p_partkey // CAST(pow(36, k) AS BIGINT) % 36 AS INT) + 1, 1), '' ORDER BY k DESC)
 FROM (SELECT unnest(range(0, 8)) AS k) WHERE k = 0 OR p_partkey >= CAST(pow(36, k) AS BIGINT)) AS id, (p_size * 4899 + 100 * 9617 + 50 * 1868 + 8192) >> 14 AS grey FROM part""")
def scalar_rules(spark, sf_dir):
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", exprs.half_up(F.col("p_retailprice") / 7).alias("rounded"), exprs.base36(key).alias("id"), exprs.luma(F.col("p_size"), F.lit(100), F.lit(50)).alias("grey"))


@query("""
SELECT p_partkey, round(sqrt(pow(greatest(10 - p_size, 0, p_size - 20), 2) + pow(greatest(1000 - p_retailprice, 0, p_retailprice - 1500), 2)), 6) AS dist FROM part""")
def point_box_distance(spark, sf_dir):
    lit = F.lit
    return table(spark, sf_dir, "part").select("p_partkey", F.round(exprs.point_box_distance(F.col("p_size"), F.col("p_retailprice"), lit(10), lit(1000), lit(20), lit(1500)), 6).alias("dist"))
