"""Fusion, matching and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.functions import text as T
from atlasloom.operators import fusion as U
from atlasloom.operators import matching as M
from atlasloom.operators import metrics as X
from atlasloom.plans.base import Registry, rounded

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


@q("""WITH v AS (SELECT l_partkey AS point, l_linenumber AS version, l_suppkey AS colour, l_extendedprice AS footprint, l_orderkey AS frame, CASE WHEN l_returnflag <> 'N' THEN l_suppkey % 5 END AS o FROM lineitem),
      c AS (SELECT point, max(version) AS version, arg_min(colour, ROW(-version, footprint, frame)) AS colour, count(*) AS seen FROM v GROUP BY 1), b AS (SELECT point, max(ROW(n, -o)) AS b FROM (SELECT point, o, count(*) AS n FROM v WHERE o IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
      SELECT c.point, version, colour, CASE WHEN b[1] >= seen / 3 THEN -b[2] END AS object_id FROM c LEFT JOIN b USING (point)""")
def point_attribution(t):
    views = t("lineitem").select(F.col("l_partkey").alias("point"), F.col("l_linenumber").alias("version"), F.col("l_suppkey").alias("colour"), F.col("l_extendedprice").alias("footprint"), F.col("l_orderkey").alias("frame"), F.when(F.col("l_returnflag") != "N", F.col("l_suppkey") % 5).alias("object_id"))
    return U.attributed(views)


@q("SELECT l_partkey, round(median((1 + l_tax) / (1 + l_discount)), 6) AS ratio, count(*) FILTER (1 + l_tax > (1 + l_discount) * 1.05) AS through, count(*) AS views, count(*) FILTER (1 + l_tax > (1 + l_discount) * 1.05) >= 2 AS dropped FROM lineitem GROUP BY 1")
def depth_consensus(t):
    rays = t("lineitem").select("l_partkey", (1 + F.col("l_discount")).alias("own"), (1 + F.col("l_tax")).alias("other"))
    return U.consensus(rays, ["l_partkey"], "own", "other", 0.05).withColumn("ratio", F.round("ratio", 6))


@q("SELECT l_suppkey AS x, CAST(l_linenumber AS BIGINT) AS y, round(sum(greatest(-0.03, least(0.03, l_discount - 0.04)) * l_quantity) / sum(l_quantity), 8) AS sdf, sum(l_quantity) AS weight FROM lineitem WHERE l_discount - 0.04 >= -0.03 GROUP BY 1, 2")
def signed_distances(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("x"), F.col("l_linenumber").cast("long").alias("y"), (F.col("l_discount") - 0.04).alias("d"), "l_quantity")
    return U.signed_distances(rows, ["x", "y"], "d", "l_quantity", 0.03).select("x", "y", F.round("sdf", 8).alias("sdf"), "weight")


@q("""WITH s AS (SELECT l_suppkey AS x, CAST(l_linenumber AS BIGINT) AS y, CAST(0 AS BIGINT) AS z, avg(l_discount) - 0.0503 AS d FROM lineitem GROUP BY 1, 2)
      SELECT a.x + a.d / (a.d - b.d) AS x, CAST(a.y AS DOUBLE) AS y FROM s a JOIN s b ON b.x = a.x + 1 AND b.y = a.y WHERE a.d * b.d < 0 UNION ALL SELECT CAST(a.x AS DOUBLE), a.y + a.d / (a.d - b.d) FROM s a JOIN s b ON b.y = a.y + 1 AND b.x = a.x WHERE a.d * b.d < 0""".replace("SELECT a.x + a.d / (a.d - b.d) AS x,", "SELECT round(a.x + a.d / (a.d - b.d), 5) AS x,").replace("a.y + a.d / (a.d - b.d) FROM", "round(a.y + a.d / (a.d - b.d), 5) FROM"))
def zero_crossings(t):
    rows = t("lineitem").groupBy(F.col("l_suppkey").alias("x"), F.col("l_linenumber").cast("long").alias("y")).agg((F.avg("l_discount") - 0.0503).alias("sdf")).withColumn("z", F.lit(0).cast("long"))
    return U.zero_crossings(rows, "x", "y", "z").select(*[rounded(F.col(c), 5).alias(c) for c in "xy"])


@q("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE p_size = s_suppkey % 50 AND abs(p_retailprice - s_acctbal) <= 200)")
def carved_points(t):
    boxes = t("supplier").select((F.col("s_suppkey") % 50).alias("at"), "s_acctbal")
    return U.carved(t("part"), boxes, (F.col("p_size") == F.col("at")) & (F.abs(F.col("p_retailprice") - F.col("s_acctbal")) <= 200), "p_partkey").select("p_partkey")


@q("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber >= 2 OR (l_linenumber >= l_quantity % 3 AND l_returnflag = 'A')")
def few_view_filter(t):
    rows = t("lineitem").withColumns({"v": F.col("l_quantity") % 3, "k": F.col("l_returnflag") == "A"})
    return U.kept_thin(rows, "l_linenumber", "v", "k").select("l_orderkey", "l_linenumber", "l_partkey")


@q("""WITH n AS (SELECT l_suppkey AS row, CAST(l_linenumber AS BIGINT) AS col, CAST(floor(l_discount / 0.01 + 1e-9) AS BIGINT) AS bin, count(*) AS n FROM lineitem WHERE l_tax >= 0.03 GROUP BY 1, 2, 3),
      j AS (SELECT *, CAST(sum(n) OVER (PARTITION BY row, col ORDER BY bin RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS BIGINT) AS slab, CAST(sum(n) OVER (PARTITION BY row, col ORDER BY bin RANGE BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS BIGINT) AS band FROM n) SELECT row, col, bin, n, slab FROM j WHERE slab >= 2 AND slab >= 0.5 * band""")
def support_surfaces(t):
    rows = t("lineitem").select((F.col("l_linenumber") + 0.5).alias("x"), (F.col("l_suppkey") + 0.5).alias("y"), (F.col("l_discount") / 0.01 + 1e-9).alias("z"), F.when(F.col("l_tax") >= 0.03, 1.0).otherwise(0.0).alias("nz"))
    return U.surfaces(rows, cell=1.0, bin_=1.0).select("row", "col", "bin", "n", "slab")


@q("""WITH c AS (SELECT CAST(floor(l_quantity / 10.0) AS BIGINT) AS c, l_suppkey AS r, CAST(floor(l_linenumber / 1.0) AS BIGINT) AS bin FROM lineitem), w AS (SELECT count(DISTINCT c * 100000 + r) AS a, quantile_cont(bin, 0.5) AS m FROM c), p AS (SELECT bin, count(DISTINCT c * 100000 + r) AS k FROM c GROUP BY 1)
      SELECT min(bin) * 1.0 AS height FROM p, w WHERE bin > m AND k >= 0.3 * a""")
def ceiling_cut(t):
    rows = t("lineitem").select((F.col("l_quantity") / 10).alias("x"), F.col("l_suppkey").cast("double").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    return U.ceiling(rows, 1.0, 1.0, 0.3)


@q("""WITH b AS (SELECT g, max(ROW(n, -b)) AS m FROM (SELECT l_suppkey AS g, CAST(floor(ln(l_quantity) / 0.25) AS BIGINT) AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1), c AS (SELECT g, (-m[2] + 0.5) * 0.25 AS c FROM b)
      SELECT l_suppkey AS g, round(exp(avg(ln(l_quantity))), 6) AS scale, count(*) AS votes FROM lineitem JOIN c ON g = l_suppkey WHERE abs(ln(l_quantity) - c) <= 0.3 GROUP BY 1""")
def pooled_scale(t):
    return U.pooled_scale(t("lineitem").select(F.col("l_suppkey").alias("g"), F.log("l_quantity").alias("v")), ["g"], "v", 0.25, 0.3).select("g", F.round("scale", 6).alias("scale"), "votes")


@q("""WITH r AS (SELECT l_suppkey AS beam, l_extendedprice / 1000 AS v, row_number() OVER w AS k, lead(l_extendedprice / 1000, 11) OVER w AS far, lead(l_extendedprice / 1000, 2) OVER w AS nth FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_extendedprice / 1000))
      SELECT beam, round(arg_min(nth, k) FILTER (far <= v + greatest(2.0, 0.05 * v)), 6) AS range, count(*) AS values FROM r GROUP BY 1""")
def range_scan(t):
    """Nearest return of each beam that twelve values support."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("beam"), (F.col("l_extendedprice") / 1000).alias("v"))
    return U.supported_return(rows, ["beam"], "v", absolute=2.0).select("beam", F.round("range", 6).alias("range"), "values")


@q("""SELECT b.beam, n FROM (SELECT unnest(range(-35, 37)) AS beam) b LEFT JOIN (SELECT CASE WHEN k = -36 THEN 36 ELSE k END AS beam, count(*) AS n FROM (SELECT CAST(round_even(degrees(atan2(l_discount - 0.05, l_quantity - 25)) / 5, 0) AS BIGINT) AS k FROM lineitem) GROUP BY 1) USING (beam)""")
def beams(t):
    rows = t("lineitem").select(F.lit("f").alias("frame"), U.beam(F.col("l_quantity") - 25, F.col("l_discount") - 0.05, 5.0).alias("beam"))
    return U.with_default_beams(rows.groupBy("frame", "beam").agg(F.count(F.lit(1)).alias("n")), ["frame"], 5.0).select(F.col("beam").cast("long").alias("beam"), "n")


@q("SELECT user_id AS object_id, CASE WHEN bool_or(event_type = 'view' AND value < 50) THEN 'full' ELSE 'partial' END AS x, CASE WHEN bool_or(event_type = 'click' AND value < 50) THEN 'full' ELSE 'partial' END AS y, CASE WHEN bool_or(event_type IN ('view', 'click') AND value < 50) OR bool_or(event_type = 'error' AND event_id % 2 = 0 AND value < 50) THEN 'full' ELSE 'partial' END AS z FROM events GROUP BY 1")
def extent_seen(t):
    e = F.col("event_type")
    views = t("events").select(F.col("user_id").alias("object_id"), (e == "view").alias("across_x"), (e == "click").alias("across_y"), (e == "error").alias("top"), (F.col("value") >= 50).alias("cut"), (F.col("event_id") % 2 == 0).alias("supported"))
    return U.extent_seen(views)


@q("""SELECT vec_id, round(list_cosine_similarity(u, v), 5) AS turn FROM (SELECT vec_id, [embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE] AS u, [embedding[4]::DOUBLE, embedding[5]::DOUBLE, embedding[6]::DOUBLE] AS v FROM embeddings) WHERE degrees(acos(greatest(-1, least(1, list_cosine_similarity(u, v))))) >= 2""")
def triangulation(t):
    """Rays through a common point meet in it."""
    d = lambda k: F.transform(F.slice("embedding", k, 3), lambda x: x.cast("double"))
    rows = t("embeddings").select("vec_id", d(1).alias("u"), d(4).alias("v"))
    at = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    rows = rows.withColumns({"p": F.zip_with(at, "u", lambda a, b: a - 2 * b), "q": F.zip_with(at, "v", lambda a, b: a - 3 * b)})
    out = M.triangulated(rows)
    wrong = F.exists(F.zip_with("point", at, lambda a, b: F.abs(a - b) > 1e-6), lambda x: x)
    return out.where(~wrong).select("vec_id", F.round(F.cos(F.radians("parallax")), 5).alias("turn"))


@q("""SELECT vec_id, round(pow(y2 * x1 - y1 * x2, 2) / (x1 * x1 + x2 * x2 + y1 * y1 + y2 * y2), 8) AS residual FROM (SELECT vec_id, embedding[1]::DOUBLE * 10 AS x1, embedding[2]::DOUBLE * 10 AS x2, embedding[3]::DOUBLE * 10 AS y1, embedding[4]::DOUBLE * 10 AS y2 FROM embeddings)""")
def epipolar_residual(t):
    """Residuals of a camera that moved along its axis."""
    e = [F.col("embedding")[k].cast("double") * 10 for k in range(4)]
    along = F.array(*[F.lit(float(v)) for v in (0, -1, 0, 1, 0, 0, 0, 0, 0)])
    return t("embeddings").select("vec_id", F.round(M.sampson(F.array(e[0], e[1], F.lit(1.0)), F.array(e[2], e[3], F.lit(1.0)), along), 8).alias("residual"))


@q("SELECT user_id, round(median(value / greatest(event_id % 10 / 10.0, 0.3)), 6) AS parallax, median(value / greatest(event_id % 10 / 10.0, 0.3)) > 2 * sqrt(1 + pow(0.25 * median(value / greatest(event_id % 10 / 10.0, 0.3)), 2)) AS moved FROM events GROUP BY 1")
def parallax_test(t):
    return M.parallax_test(t("events").withColumn("s", F.col("event_id") % 10 / 10.0), ["user_id"], "value", "s").withColumn("parallax", F.round("parallax", 6))


@q("WITH t AS (SELECT DISTINCT l_suppkey AS f, l_partkey AS p FROM lineitem) SELECT x.f AS a, y.f AS b, count(*) AS shared FROM t x JOIN t y ON x.p = y.p AND x.f < y.f GROUP BY 1, 2 HAVING count(*) >= 20")
def covisibility(t):
    return M.covisible(t("lineitem"), "l_suppkey", "l_partkey", 20)


@q("""SELECT f.k AS frame, p_partkey FROM (VALUES (1, 10.0), (2, 20.0), (3, 30.0)) f(k, x0), part WHERE p_retailprice / 100 - 9 - 0.0 > 0.05 AND p_retailprice / 100 - 9 <= 20 AND 200 * (p_size - x0) / (p_retailprice / 100 - 9) + 320 >= 0 AND 200 * (p_size - x0) / (p_retailprice / 100 - 9) + 320 < 640""")
def frustum_join(t):
    """Points that frames looking up see; axes are the map's."""
    points = t("part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.lit(0.0).alias("y"), (F.col("p_retailprice") / 100 - 9).alias("z"))
    frames = points.sparkSession.createDataFrame([(k, [1.0, 0.0, 0.0, 10.0 * k, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], 200.0, 200.0, 320.0, 240.0, 640, 480) for k in (1, 2, 3)], "frame int, pose array<double>, fx double, fy double, cx double, cy double, width int, height int")
    return M.frustum(points, frames, 10.0, 20.0 * 1.9).where("z <= 20").select("frame", "p_partkey")


@q()
def constrained_groups(t):
    e = t("lineitem").where("l_quantity >= 49").select((F.col("l_orderkey") % 8).alias("g"), F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 100000).alias("b"), (F.col("l_suppkey") % 9).alias("frame_a"), (F.col("l_partkey") % 9).alias("frame_b"), F.col("l_extendedprice").alias("strength"))
    return M.constrained_groups(e, ["g"])


@q("SELECT user_id AS frame, count(*) AS matches, count(*) AS inliers, TRUE AS placed FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY 1 HAVING count(*) >= 6")
def pose_refinement(t):
    """Poses from exact matches are found again from a start that is off."""
    x, y, z = F.col("event_id") % 13 - 6.0, F.col("event_id") % 7 - 3.0, 6.0 + F.col("event_id") % 5
    seen = t("events").select(F.col("user_id").alias("frame"), x.alias("x"), y.alias("y"), z.alias("z"), (500 * (x + 0.2) / (z + 0.5) + 320).alias("u"), (500 * (y - 0.1) / (z + 0.5) + 240).alias("v"))
    start = [1.0, 0.0, 0.02, 0.0, 0.0, 1.0, 0.0, 0.0, -0.02, 0.0, 1.0, 0.3, 0.0, 0.0, 0.0, 1.0]
    out = M.refined_poses(seen, start, (500.0, 500.0, 320.0, 240.0)).where("matches >= 6")
    return out.select("frame", "matches", "inliers", ((F.abs(F.col("pose")[3] - 0.2) < 1e-3) & (F.abs(F.col("pose")[7] + 0.1) < 1e-3) & (F.abs(F.col("pose")[11] - 0.5) < 1e-3)).alias("placed"))


@q("""SELECT event_type, round(avg(CASE WHEN e IS NOT NULL AND e <= 0.3 AND value / 5 <= 15 THEN 1.0 ELSE 0 END), 8) AS recall, round(median(e), 8) AS error_median, round(avg(CASE WHEN e IS NOT NULL THEN CAST(e <= 3 * s AS DOUBLE) END), 8) AS containment, round(median(CASE WHEN e IS NOT NULL THEN s / greatest(e, 1e-3) END), 6) AS tightness, round(avg(CAST(value > 90 AS DOUBLE)), 8) AS ambiguous
      FROM (SELECT *, CASE WHEN event_id % 9 > 0 THEN value / 200 END AS e, 0.05 + event_id % 5 / 50.0 AS s FROM events) GROUP BY 1""")
def locate_metrics(t):
    v, i = F.col("value"), F.col("event_id")
    rows = t("events").select("event_type", F.when(i % 9 > 0, v / 200).alias("error_m"), (v / 5).alias("error_deg"), (0.05 + i % 5 / 50.0).alias("sigma_m"), (v > 90).alias("ambiguous"))
    return X.locate(rows, ["event_type"]).select("event_type", *[F.round(c, 8).alias(c) for c in ("recall", "error_median", "containment")], F.round("tightness", 6).alias("tightness"), F.round("ambiguous", 8).alias("ambiguous"))


GRIDS = "g AS (SELECT l_suppkey AS r, l_linenumber AS c, CASE WHEN max(l_quantity) >= 49 THEN 2 ELSE 1 END AS s FROM lineitem GROUP BY 1, 2), h AS (SELECT l_suppkey AS r, l_linenumber AS c, CASE WHEN max(l_discount) >= 0.1 THEN 2 ELSE 1 END AS t FROM lineitem WHERE l_linenumber > 1 GROUP BY 1, 2)"


def _grids(t):
    cells = lambda rows, state: rows.groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).agg(F.when(state, 2).otherwise(1).alias("state"))
    l = t("lineitem")
    return cells(l, F.max("l_quantity") >= 49), cells(l.where("l_linenumber > 1"), F.max("l_discount") >= 0.1)


@q(f"WITH {GRIDS} SELECT round(avg(CAST(s = t AS DOUBLE)), 8) AS agreement, round(avg(CAST(s = t AS DOUBLE)) FILTER (t = 1), 8) AS free, round(avg(CAST(s = t AS DOUBLE)) FILTER (t = 2), 8) AS occupied, count(*) AS cells FROM g JOIN h USING (r, c)")
def grid_agreement(t):
    return X.grid_agreement(*_grids(t)).select(*[F.round(c, 8).alias(c) for c in ("agreement", "free", "occupied")], "cells")


@q(f"WITH {GRIDS} SELECT r AS row, c AS col FROM g JOIN h USING (r, c) WHERE s = 2 AND t = 1 AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = r AND l_linenumber = c AND l_returnflag = 'A')")
def false_obstacles(t):
    seen = t("lineitem").where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col"))
    return X.false_obstacles(*_grids(t), seen).select("row", "col")


@q("SELECT round(median(value), 8) AS centre_median, round(avg(CAST(event_type = 'view' AS DOUBLE)), 8) AS label_share, round(avg(s), 8) AS id_stability FROM (SELECT *, CAST(event_id % 3 = lag(event_id % 3) OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS s FROM events)")
def object_metrics(t):
    rows = t("events").select(F.col("user_id").alias("truth_id"), F.col("event_id").alias("version"), (F.col("event_id") % 3).alias("object_id"), F.col("value").alias("error_m"), F.col("event_type").alias("label"), F.lit("view").alias("truth_label"))
    return X.objects(rows).select(*[F.round(c, 8).alias(c) for c in ("centre_median", "label_share", "id_stability")])


@q("SELECT l_returnflag, round(max(abs(s - 1)), 8) AS worst, count(*) AS sectors FROM (SELECT l_returnflag, CAST(floor(l_orderkey % 180 / 45.0) AS INTEGER) AS k, sum(l_quantity) / sum(l_linenumber * 6) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def scale_metrics(t):
    rows = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("map_m"), (F.col("l_linenumber") * 6).alias("truth_m"), (F.col("l_orderkey") % 360).alias("direction_deg"))
    return X.scale(rows, ["l_returnflag"]).withColumn("worst", F.round("worst", 8))


@q("SELECT round(avg(CAST(NOT (o_custkey % 3 = 0) AS DOUBLE)) FILTER (o_totalprice >= 200000), 8) AS rejected_share, round(avg(CAST(o_custkey % 3 = 0 AS DOUBLE)) FILTER (o_totalprice < 200000), 8) AS accepted_share FROM orders")
def gate_metrics(t):
    rows = t("orders").select((F.col("o_totalprice") / 1000000).alias("slip_m"), (F.col("o_custkey") % 3 == 0).alias("accepted"))
    return X.gate(rows, 0.2).select(*[F.round(c, 8).alias(c) for c in ("rejected_share", "accepted_share")])


@q("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value) FILTER (event_id % 2 = 0), 6) AS idle, round(median(value) FILTER (event_id % 2 = 1), 6) AS busy, round(median(value) FILTER (event_id % 2 = 1) / median(value) FILTER (event_id % 2 = 0), 6) AS ratio, round(avg(CAST(abs(50 - value) <= 0.3 * value AS DOUBLE)), 8) AS eta_share FROM events GROUP BY 1")
def latency_metrics(t):
    rows = t("events").select("event_type", F.col("value").alias("seconds"), (F.col("event_id") % 2 == 1).alias("loaded"), F.lit(50.0).alias("eta"))
    return X.latency(rows, ["event_type"]).select("event_type", *[F.round(c, 6).alias(c) for c in ("p90", "idle", "busy", "ratio")], F.round("eta_share", 8).alias("eta_share"))


@q("SELECT coalesce(CASE WHEN event_type <> 'view' THEN event_type END, 'none') AS reason, round(avg(CAST(CASE WHEN value > 30 THEN event_type END IS NOT DISTINCT FROM CASE WHEN event_type <> 'view' THEN event_type END AS DOUBLE)), 8) AS share, count(*) AS n FROM events GROUP BY 1")
def reason_metrics(t):
    rows = t("events").select(F.when(F.col("value") > 30, F.col("event_type")).alias("said"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("true"))
    return X.agreement_of_reasons(rows, "said", "true").withColumn("share", F.round("share", 8))


@q("SELECT user_id, count(DISTINCT event_type) AS answers, count(*) AS reads, count(DISTINCT event_type) = 1 AS atomic FROM events GROUP BY 1")
def atomicity(t):
    return X.atomic(t("events"), "user_id", "event_type")


@q("SELECT count(*) AS kept, count(DISTINCT md5(text)) AS texts FROM (SELECT arg_min(text, doc_id) AS text FROM documents GROUP BY sha256(text))")
def content_dedup(t):
    """Content-addressed: one of each digest stays, the smallest id."""
    one = t("documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("key")).agg(F.min_by("text", "doc_id").alias("text"))
    return one.agg(F.count(F.lit(1)).alias("kept"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("texts"))


@q("SELECT l_partkey % 3 AS g, least(count(*), 500) AS n, count(*) > 500 AS truncated FROM lineitem WHERE l_quantity < 4 GROUP BY 1")
def truncation_flag(t):
    """Rows up to a limit and whether there were more."""
    g = t("lineitem").where("l_quantity < 4").groupBy((F.col("l_partkey") % 3).alias("g")).agg(F.count(F.lit(1)).alias("all"))
    return g.select("g", F.least("all", F.lit(500)).cast("long").alias("n"), (F.col("all") > 500).alias("truncated"))


@q("SELECT conv_id, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, '>' ORDER BY turn, role) AS roles FROM conversations GROUP BY 1")
def conversation_turns(t):
    g = t("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length("text")).alias("chars"), F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return g.select("conv_id", "turns", "chars", F.array_join(F.transform("r", lambda x: x["role"]), ">").alias("roles"))


@q("SELECT event_id, k, v FROM (SELECT event_id, unnest(['class', 'n']) AS k, unnest([event_type, CAST(user_id AS VARCHAR)]) AS v FROM events)")
def attribute_text(t):
    """`k=v,k=v` read into rows."""
    rows = t("events").select("event_id", F.concat(F.lit("class="), "event_type", F.lit(",n="), F.col("user_id").cast("string")).alias("a"))
    return rows.select("event_id", F.explode(T.attributes("a")).alias("k", "v"))
