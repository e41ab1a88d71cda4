"""Queries of the further map rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import rules as R
from atlasloom.plans.base import Registry, rounded

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


@q("""WITH r AS (SELECT DISTINCT CAST(l_suppkey AS BIGINT) AS row, CAST(l_linenumber AS BIGINT) AS col FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS r, l_linenumber AS c FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.05)
      SELECT row, col FROM r WHERE row BETWEEN 1 AND 98 AND col BETWEEN 1 AND 6 AND NOT EXISTS (SELECT 1 FROM b WHERE abs(b.r - row) <= 1 AND abs(b.c - col) <= 1)""")
def supported_pixels(t):
    cells = t("lineitem").groupBy(F.lit("f").alias("frame"), F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.max((F.col("l_quantity") == 50) & (F.col("l_discount") == 0.05)).alias("bad"))
    return R.supported_pixels(cells, ["frame"], F.col("bad"), 1, 100, 8).select("row", "col")


@q("""WITH v AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, s_nationkey * 1.0 AS y, [cos(s_suppkey), sin(s_suppkey), 0.0] AS d FROM supplier)
      SELECT a.k AS a, b.k AS b, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS distance FROM v a JOIN v b ON a.k < b.k WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 2 AND degrees(acos(greatest(-1, least(1, list_cosine_similarity(a.d, b.d))))) <= 100""")
def view_overlap(t):
    k = F.col("s_suppkey")
    views = t("supplier").select(k.alias("view"), (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"), F.lit(0.0).alias("z"), F.array(F.cos(k), F.sin(k), F.lit(0.0)).alias("axis"))
    return R.overlapping_views(views, 2.0).select("a", "b", F.round("distance", 6).alias("distance"))


@q("SELECT user_id AS frame FROM (SELECT user_id, min(value / 10) AS d, count(*) FILTER (event_id % 40 >= 15) AS v, max(event_id % 40) AS m FROM events WHERE event_type = 'view' GROUP BY 1) WHERE d <= 0.2 AND (v >= 2 OR m >= 30)")
def plausible_poses(t):
    e = t("events")
    support = e.where("event_type = 'view'").select(F.col("user_id").alias("frame"), (F.col("event_id") % 40).alias("inliers"), (F.col("value") / 10).alias("distance_m"))
    return R.plausible(e.select(F.col("user_id").alias("frame")).distinct(), support, metres=0.2)


@q("""WITH j AS (SELECT *, sum(CASE WHEN e > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, event_id // 500 AS e, lag(event_id // 500) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events))
      SELECT user_id, run, round(sum(s), 4) AS travelled FROM (SELECT user_id, CAST(run AS BIGINT) AS run, CASE WHEN lag(run) OVER w = run THEN abs(value - lag(value) OVER w) END AS s FROM j WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) GROUP BY 1, 2""")
def epoch_steps(t):
    rows = t("events").select("user_id", "event_id", F.floor(F.col("event_id") / 500).alias("epoch"), F.col("value").alias("x"))
    return R.epochs(rows, ["user_id"], ["event_id"], "epoch").groupBy("user_id", "run").agg(F.round(F.sum("step"), 4).alias("travelled"))


@q("""WITH RECURSIVE f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey > 3 THEN s_suppkey // 2 END AS ref, 0.25 + s_suppkey % 3 / 4.0 AS share, s_acctbal / 1000 AS lever FROM supplier WHERE s_suppkey > 0),
      r AS (SELECT k, CASE WHEN abs(share * lever * 0.05) < 0.01 THEN 0.0 ELSE share * lever * 0.05 END AS shift FROM f WHERE ref IS NULL UNION ALL
            SELECT f.k, CASE WHEN abs(share * lever * 0.05 + (1 - share) * shift) < 0.01 THEN 0.0 ELSE share * lever * 0.05 + (1 - share) * shift END FROM f JOIN r ON f.ref = r.k)
      SELECT k AS frame, round(shift, 8) AS shift FROM r""")
def replacement(t):
    k = F.col("s_suppkey")
    frames = t("supplier").where("s_suppkey > 0").select(k.alias("frame"), F.when(k > 3, F.floor(k / 2)).alias("reference"), (0.25 + k % 3 / 4.0).alias("share"), (F.col("s_acctbal") / 1000).alias("lever"))
    return R.replaced(frames, 0.05).select("frame", rounded(F.col("shift"), 8).alias("shift"))


@q()
def independent_set(t):
    """Places that are at least 150 apart, kept in order."""
    return R.independent_places(t("supplier").select(F.col("s_suppkey").alias("item"), F.col("s_acctbal").alias("x")), "item", "x", 150.0)


@q("""WITH r AS (SELECT user_id, value, w, sum(w) OVER (PARTITION BY user_id ORDER BY value) AS c, sum(w) OVER (PARTITION BY user_id) AS a FROM (SELECT *, event_id % 7 AS w FROM events) WHERE w > 0) SELECT user_id, min(value) AS median FROM r WHERE 2 * c >= a GROUP BY 1""")
def weighted_median(t):
    return R.weighted_median(t("events").withColumn("w", F.col("event_id") % 7), ["user_id"], "value", "w")


@q("SELECT user_id, event_type, value, -n AS event_id FROM (SELECT user_id, event_type, max(ROW(value, -event_id)) AS b FROM events GROUP BY 1, 2), LATERAL (SELECT b[1] AS value, b[2] AS n)")
def best_per_label(t):
    return R.best_per_label(t("events"), ["user_id"], "event_type", "value", "event_id")


@q("SELECT l_partkey, round(avg((1 + l_tax) / (1 + l_discount)), 8) AS ratio, count(*) AS views FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1")
def border_ratio(t):
    rows = t("lineitem").select("l_partkey", "l_returnflag", (1 + F.col("l_discount")).alias("own"), (1 + F.col("l_tax")).alias("other"))
    return R.border_ratio(rows, ["l_partkey"], "own", "other", F.col("l_returnflag") == "A").withColumn("ratio", F.round("ratio", 8))


@q("SELECT l_suppkey, -r AS region, n AS points FROM (SELECT l_suppkey, max(ROW(n, -g)) AS b FROM (SELECT l_suppkey, (CAST(floor(l_quantity / 10) AS BIGINT) + CAST(floor(l_discount * 10) AS BIGINT)) % 3 AS g, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1), LATERAL (SELECT b[1] AS n, b[2] AS r)")
def majority_region(t):
    points = t("lineitem").select("l_suppkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("y"))
    cells = points.sparkSession.range(12).crossJoin(points.sparkSession.range(4).withColumnRenamed("id", "row")).select("row", F.col("id").alias("col"), ((F.col("id") + F.col("row")) % 3).alias("region"))
    return R.majority_region(points, cells, 1.0, "l_suppkey")


@q("SELECT user_id, event_id FROM (SELECT *, median(value) OVER (PARTITION BY user_id) AS m FROM events) WHERE value < 0.1 * m AND event_id % 20 - 10 >= 5 OR value < 0.1 * m AND event_id % 20 - 10 <= -5")
def collapsed_runs(t):
    rows = t("events").withColumn("turn", F.col("event_id") % 20 - 10)
    return R.collapsed(rows, ["user_id"], ["event_id"], "value", "turn").select("user_id", "event_id")
