"""Ordered analytics, set operations, versions over time, event-time windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.functions import text as T
from atlasloom.operators import windows as W
from atlasloom.plans.base import Registry
from atlasloom.streaming import events as S

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


@q("SELECT l_suppkey, min(d) AS run_start, max(d) AS run_end, count(*) AS n FROM (SELECT l_suppkey, d, d - row_number() OVER (PARTITION BY l_suppkey ORDER BY d) AS g FROM (SELECT DISTINCT l_suppkey, CAST(date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS d FROM lineitem)) GROUP BY l_suppkey, g")
def gaps_islands(t):
    rows = t("lineitem").select("l_suppkey", F.date_diff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).alias("d"))
    return W.islands(rows, ["l_suppkey"], "d")


@q("SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 14400000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY 1, 2")
def gap_sessions(t):
    return W.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 4 * 3600).groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@q("SELECT event_id, round(sqrt(pow(value - lag(value) OVER w, 2)), 4) AS step FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def lag_steps(t):
    return W.steps(t("events"), ["user_id"], ["ts", "event_id"], ["value"]).select("event_id", F.round("step", 4).alias("step"))


@q("SELECT l_orderkey, l_linenumber, l_suppkey, count(*) OVER (PARTITION BY l_suppkey ORDER BY CAST(l_quantity AS BIGINT) RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM lineitem")
def sliding_bins(t):
    rows = t("lineitem").withColumn("bin", F.col("l_quantity").cast("long"))
    return W.sliding_count(rows, ["l_suppkey"], "bin", 2).select("l_orderkey", "l_linenumber", "l_suppkey", "near")


@q("""WITH k AS (SELECT event_id, user_id, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events), j AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS a, min(CASE WHEN v IS NOT NULL THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM k)
      SELECT j.event_id, round(CASE WHEN a IS NULL THEN y.value WHEN b IS NULL OR a = b THEN x.value ELSE x.value + (j.event_id - a) / (b - a) * (y.value - x.value) END, 8) AS filled FROM j LEFT JOIN events x ON x.event_id = a LEFT JOIN events y ON y.event_id = b""")
def interpolation(t):
    rows = t("events").select("event_id", "user_id", F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("v"))
    return W.interpolated(rows, ["user_id"], "event_id", "v").select("event_id", F.round("filled", 8).alias("filled"))


@q("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 5 OR event_type = 'error' AND value > 99")
def capped_retention(t):
    return W.retained(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5, (F.col("event_type") == "error") & (F.col("value") > 99)).select("user_id", "event_id", "value")


@q("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id) AS b FROM events) WHERE value >= 0.25 * b")
def ranked_support(t):
    return W.ranked_support(t("events"), ["user_id"], "value").select("user_id", "event_id", "value")


@q("SELECT event_id, event_type, lag(event_type) OVER w AS previous, event_type IS DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def version_changes(t):
    return W.changes(t("events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "event_type", "previous", "changed")


@q("""WITH d AS (SELECT *, 180 - (((180 - (h - lag(h) OVER w)) % 360) + 360) % 360 AS s FROM (SELECT *, value * 3.6 AS h FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), u AS (SELECT user_id, sum(coalesce(s, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS u FROM d)
      SELECT user_id, round(max(u) - min(u), 3) AS span FROM u GROUP BY 1""")
def sweep_span(t):
    return W.sweep_span(t("events").withColumn("h", F.col("value") * 3.6), ["user_id"], ["ts", "event_id"], "h").select("user_id", F.round("span", 3).alias("span"))


@q("SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY regexp_replace(p_brand, '\\d+', '') , CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), p_partkey) AS INTEGER) AS place FROM part")
def natural_order(t):
    """Places in natural order; ranks of a total order through a range-partitioned sort and counts, not one window over all rows."""
    rows = t("part").withColumn("k", T.natural_key("p_brand"))
    return W.ranked(rows, ["k", "p_partkey"], "place").select("p_partkey", "p_name", F.col("place").cast("int").alias("place"))


@q("SELECT user_id, arg_max(event_type, ROW(ts, event_id)) AS state, max(ts) AS at, count(*) AS n FROM events GROUP BY 1")
def version_latest_wins(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"), F.count(F.lit(1)).alias("n"))


@q("SELECT user_id, min(event_id) AS first_seen, max(event_id) AS last_seen, count(*) AS sightings FROM events GROUP BY 1")
def seen_versions(t):
    from atlasloom.operators.objects import seen_versions as seen

    return seen(t("events").withColumnRenamed("user_id", "object_id"), version="event_id").withColumnRenamed("object_id", "user_id")


@q("SELECT spelling, place FROM (SELECT l AS spelling, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM (SELECT lower(p_type) AS k, min(p_partkey) AS first, arg_min(p_type, p_partkey) AS l FROM part GROUP BY 1))")
def vocab_union(t):
    """Ordered union of two vocabularies, the first spelling kept."""
    p = t("part").select(F.col("p_partkey").alias("at"), F.col("p_type").alias("l"))
    both = p.where("at % 2 = 0").unionByName(p.where("at % 2 = 1"))
    first = both.groupBy(T.normalize_label("l").alias("k")).agg(F.min("at").alias("first"), F.min_by("l", "at").alias("spelling"))
    from pyspark.sql import Window

    return first.select("spelling", F.row_number().over(Window.orderBy("first")).alias("place"))


@q("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def version_difference(t):
    l = t("lineitem")
    return l.where("l_returnflag = 'A'").select("l_partkey").distinct().join(l.where("l_returnflag = 'R'").select("l_partkey"), "l_partkey", "left_anti")


@q("SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def membership(t):
    l = t("lineitem")
    return l.where("l_returnflag = 'A'").select("l_partkey").intersect(l.where("l_returnflag = 'R'").select("l_partkey"))


@q("SELECT l_suppkey, l_quantity FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) < 12")
def static_subtraction(t):
    """Rows without what recurs in many frames."""
    l = t("lineitem")
    static = l.groupBy("l_suppkey", "l_quantity").agg(F.countDistinct("l_orderkey").alias("n")).where("n >= 12")
    return l.select("l_suppkey", "l_quantity").distinct().join(static, ["l_suppkey", "l_quantity"], "left_anti")


@q("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_window(t):
    return S.tumbling(t("events"), "1 hour").select("start", "event_type", "n", F.round("total", 4).alias("total"))


@q("SELECT start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * k AS start, event_type FROM events, (VALUES (0), (1), (2), (3)) v(k)) GROUP BY 1, 2")
def sliding_window(t):
    return S.sliding(t("events"), "2 hours", "30 minutes").select("start", "event_type", "n")


@q("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS until, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 7200000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY user_id, s")
def session_window(t):
    return S.session(t("events"), "2 hours")


@q("SELECT day, event_type, approx, n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, TRUE AS approx FROM events GROUP BY 1, 2)")
def approximate_users(t):
    """Approximate distinct users within a tenth of the exact number, beside exact counts."""
    g = t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id", 0.01).alias("a"), F.countDistinct("user_id").alias("u"))
    return g.select("day", "event_type", (F.abs(F.col("a") - F.col("u")) <= F.greatest(F.lit(1), F.col("u") / 10)).alias("approx"), "n")


@q("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, time_bucket(INTERVAL 6 HOUR, ts) ORDER BY event_id) AS r FROM events) WHERE r = 1")
def first_in_window(t):
    from atlasloom.operators.joins import first_of_duplicates

    rows = t("events").withColumn("bucket", F.window(F.col("ts").cast("timestamp"), "6 hours")["start"])
    return first_of_duplicates(rows, ["user_id", "event_type", "bucket"], ["event_id"]).where("NOT duplicate").select("event_id", "user_id")
