"""Objects, registration rules, quality gate and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import evaluation as E
from atlasloom.operators import merging
from atlasloom.operators import objects as O
from atlasloom.operators import registration as R
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

def _boxes(t):
    return t("lineitem").select((F.col("l_orderkey") % 400).alias("frame"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("det_id"), F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").cast("double").alias("x0"), (F.col("l_discount") * 100).alias("y0"), (F.col("l_quantity") + 10.0).alias("x1"), (F.col("l_discount") * 100 + 5).alias("y1"))


@q()
def nms_greedy(t):
    return O.suppressed(_boxes(t), "frame", 0.5)


@q("""WITH b AS (SELECT l_orderkey % 400 AS frame, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS det_id, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10.0 AS x1, l_discount * 100 + 5 AS y1 FROM lineitem WHERE l_orderkey % 400 < 40),
      j AS (SELECT a.frame, a.det_id, c.det_id AS det_id_b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i FROM b a JOIN b c ON a.frame = c.frame AND a.det_id < c.det_id)
      SELECT frame, det_id, det_id_b, round(i / (100 - i), 6) AS iou FROM j WHERE i / (100 - i) >= 0.5""")
def overlapping_boxes(t):
    return O.overlapping(_boxes(t).where("frame < 40"), "frame", "det_id", 0.5).select("frame", "det_id", "det_id_b", F.round("iou", 6).alias("iou"))


@q("""WITH b AS (SELECT l_orderkey % 400 AS frame, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS det_id, l_quantity AS x0, l_discount * 100 AS y0, l_quantity + 10.0 AS x1, l_discount * 100 + 5 AS y1 FROM lineitem),
      j AS (SELECT a.frame, a.det_id, c.det_id AS det_id_b, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) * greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) AS i FROM b a JOIN b c ON a.frame = c.frame AND a.det_id < c.det_id)
      SELECT frame, det_id, det_id_b, round(i / (100 - i), 6) AS iou FROM j WHERE i / (100 - i) >= 0.5""")
def overlapping_boxes_all(t):
    """Pairs of every frame; `overlapping_boxes` has a tenth of the frames, as its SQL has."""
    return O.overlapping(_boxes(t), "frame", "det_id", 0.5).select("frame", "det_id", "det_id_b", F.round("iou", 6).alias("iou"))


@q("""WITH v AS (SELECT user_id AS object_id, event_id AS version, event_type = 'view' AS seen, CAST(floor(value) AS BIGINT) AS through, 100 AS judged FROM events), l AS (SELECT object_id, max(version) FILTER (seen) AS s FROM v GROUP BY 1),
      c AS (SELECT v.object_id, count(*) FILTER (through / judged >= 0.6) AS gone, count(*) FILTER (through / judged <= 0.4) AS in_place, bool_or(through / judged >= 0.7) AS sure FROM v JOIN l USING (object_id) WHERE s IS NULL OR version > s GROUP BY 1)
      SELECT l.object_id, coalesce(gone, 0) AS gone, coalesce(in_place, 0) AS in_place, coalesce(gone, 0) > coalesce(in_place, 0) AND (coalesce(gone, 0) >= 2 OR (coalesce(gone, 0) = 1 AND coalesce(sure, FALSE))) AS struck FROM l LEFT JOIN c USING (object_id)""")
def absence_verdicts(t):
    views = t("events").select(F.col("user_id").alias("object_id"), F.col("event_id").alias("version"), (F.col("event_type") == "view").alias("seen"), F.floor("value").alias("through"), F.lit(100).alias("judged"))
    return O.absence(views)


@q("""SELECT user_id, sightings, sightings >= 2 OR (sightings = 1 AND NOT truncated AND score >= 0.5 AND misses = 0) AS published FROM
      (SELECT user_id, count(*) FILTER (event_type = 'view') AS sightings, bool_or(event_type = 'error') AS truncated, max(value) / 100 AS score, count(*) FILTER (event_type = 'error') AS misses FROM events GROUP BY 1)""")
def publish_rule(t):
    g = t("events").groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "view", 1)).alias("sightings"), F.max(F.col("event_type") == "error").alias("truncated"), (F.max("value") / 100).alias("score"), F.count(F.when(F.col("event_type") == "error", 1)).alias("misses"))
    yes = O.published(g).select("user_id", F.lit(True).alias("published"))
    return g.join(yes, "user_id", "left").select("user_id", "sightings", F.coalesce("published", F.lit(False)).alias("published"))


@q("""SELECT vec_id, CASE WHEN i >= 0.5 AND f > 0.2 THEN CASE WHEN round(greatest(i, k, greatest(0, least(1, 1 - d / 0.65))), 4) >= 0.3 THEN round(greatest(i, k, greatest(0, least(1, 1 - d / 0.65))), 4) END END AS affinity
      FROM (SELECT vec_id, (vec_id % 11) / 10.0 AS i, (vec_id % 7) / 6.0 AS k, (vec_id % 13) / 10.0 AS d, 1.0 AS f FROM embeddings) WHERE i >= 0.5""")
def object_affinity(t):
    i, k, d = (F.col("vec_id") % 11) / 10.0, (F.col("vec_id") % 7) / 6.0, (F.col("vec_id") % 13) / 10.0
    return t("embeddings").where(i >= 0.5).select("vec_id", F.round(O.affinity(i, k, d, F.lit(1.0), F.lit(True), F.lit(False)), 4).alias("affinity"))


@q("""SELECT vec_id, round(CASE WHEN alike AND near >= 0.3 THEN near WHEN NOT alike AND least(i, k) >= 0.7 THEN least(i, k) WHEN cut AND i >= 0.5 THEN greatest(0.3, 0.7 * i) END, 4) AS affinity
      FROM (SELECT *, greatest(i, k, greatest(0, least(1, 1 - d / 0.65))) AS near FROM (SELECT vec_id, (vec_id % 11) / 10.0 AS i, (vec_id % 7) / 6.0 AS k, (vec_id % 13) / 10.0 AS d, vec_id % 3 > 0 AS alike, vec_id % 2 = 0 AS cut FROM embeddings))""")
def object_affinity_all(t):
    """Every row, with labels and image borders that reach each branch; `object_affinity` has the rows that its SQL has."""
    v = F.col("vec_id")
    return t("embeddings").select("vec_id", F.round(O.affinity((v % 11) / 10.0, (v % 7) / 6.0, (v % 13) / 10.0, F.lit(1.0), v % 3 > 0, v % 2 == 0), 4).alias("affinity"))


@q("""SELECT c_custkey AS id, s AS sid, round(c_acctbal / 1000 - h, 5) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(abs(c_acctbal / 1000 - h), 2), a DESC, s) AS r FROM
      (SELECT c_custkey, c_acctbal, s_suppkey AS s, s_acctbal / 1000 AS h, s_nationkey + 1.0 AS a FROM customer JOIN supplier ON c_nationkey + 0.5 BETWEEN s_nationkey AND s_nationkey + 1 AND 0.5 BETWEEN 0 AND 1 AND c_acctbal / 1000 - s_acctbal / 1000 BETWEEN -0.05 AND 0.3)) WHERE r = 1""")
def support_relations(t):
    objects = t("customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") + 0.5).alias("x"), F.lit(0.5).alias("y"), (F.col("c_acctbal") / 1000).alias("bottom"))
    surfaces = t("supplier").select(F.col("s_suppkey").alias("sid"), (F.col("s_acctbal") / 1000).alias("height"), (F.col("s_nationkey") + 1.0).alias("area"), F.col("s_nationkey").cast("double").alias("x0"), F.lit(0.0).alias("y0"), (F.col("s_nationkey") + 1.0).alias("x1"), F.lit(1.0).alias("y1"))
    return O.supports(objects, surfaces, reach=0.3).select("id", "sid", F.round("gap", 5).alias("gap"))


@q("""SELECT o_orderkey, CASE WHEN o_totalprice / 100000 < 0.3 THEN 'too_close' WHEN o_custkey % 100 / 1000.0 < 0.01 THEN 'plain' WHEN o_custkey % 90 / 1000.0 < 0.035 THEN 'blur' WHEN o_custkey % 80 < 15 THEN 'few_features' END AS failed FROM orders""")
def frame_checks(t):
    k = F.col("o_custkey")
    return t("orders").select("o_orderkey", R.frame_check(F.col("o_totalprice") / 100000, k % 100 / 1000.0, k % 90 / 1000.0, k % 80).alias("failed"))


STATUS = """SELECT o_orderkey, CASE WHEN c > 0.9 THEN 'rejected' WHEN f AND p THEN 'kept_at_prior' WHEN f THEN 'rejected' WHEN x AND m THEN 'rejected' WHEN x THEN 'kept_at_prior' WHEN NOT k AND p THEN 'kept_at_prior' WHEN NOT k THEN 'rejected' ELSE 'registered' END AS status FROM
  (SELECT o_orderkey, 0 AS c, o_custkey % 5 = 0 AS f, o_custkey % 2 = 0 AS p, o_custkey % 7 = 0 AS x, o_custkey % 3 = 0 AS m, o_custkey % 11 > 2 AS k FROM orders)"""


@q(f"SELECT status, count(*) AS n, count(*) FILTER (status = 'registered') AS reference FROM ({STATUS}) GROUP BY 1")
def status_rows(t):
    k = F.col("o_custkey")
    s = R.status(F.when(k % 5 == 0, "blur"), k % 2 == 0, k % 7 == 0, k % 3 == 0, k % 11 > 2)
    rows = t("orders").select(s.alias("s")).select("s.status", R.roles(F.col("s.status"), F.col("s.reason"), F.lit(False)).alias("roles"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("roles.reference"), 1)).alias("reference"))


@q("SELECT event_id, value / 10 > 3 * sqrt(1.5 * 1.5 + 1.0) OR value / 20 > 3 * sqrt(1.0 + 0.25) AS conflicts, value / 10 > 0.005 OR value / 20 > 0.1 AS moved, round(sqrt(0.04 + 0.01 + pow(0.1 * value, 2)), 6) AS sigma FROM events")
def conflict_rules(t):
    v = F.col("value")
    one = lambda *x: [F.lit(float(k)) for k in x]
    return t("events").select("event_id", R.conflict(v / 10, v / 20, one(1.5, 1), one(1, 0.5)).alias("conflicts"), R.moved(v / 10, v / 20).alias("moved"), F.round(R.drift_sigma(F.lit(0.2), F.lit(0.1), v), 6).alias("sigma"))


@q("""SELECT g, agree, through, occluded, outside, CASE WHEN agree >= 40 AND agree >= 0.9 * (agree + through) THEN 'confirmed' WHEN agree + through >= 40 AND agree < 0.9 * (agree + through) AND (agree < 0.75 * (agree + through) OR through >= 100) THEN 'failed' ELSE 'untested' END AS verdict FROM
      (SELECT l_suppkey AS g, count(*) FILTER (d > 0 AND abs(z - d) <= 0.1 * d + 0.02) AS agree, count(*) FILTER (d > 0 AND z < d - (0.1 * d + 0.02)) AS through, count(*) FILTER (d > 0 AND z > d + (0.1 * d + 0.02)) AS occluded, count(*) FILTER (d <= 0) AS outside FROM (SELECT l_suppkey, l_quantity / 10 AS z, 2.5 + l_discount * 10 AS d FROM lineitem) GROUP BY 1)""")
def depth_verdicts(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_quantity") / 10).alias("z"), (2.5 + F.col("l_discount") * 10).alias("d"))
    return R.depth_counts(rows, ["g"], "z", "d").withColumn("verdict", R.depth_verdict(F.col("agree"), F.col("through")))


@q("""WITH l AS (SELECT l_suppkey AS g, l_quantity AS x, l_extendedprice / 1500 AS y, ln(l_extendedprice / 1500 / l_quantity) AS r FROM lineitem), m AS (SELECT g, median(r) AS m FROM l GROUP BY 1), d AS (SELECT g, m, greatest(1.4826 * median(abs(r - m)), 0.02) AS s FROM l JOIN m USING (g) GROUP BY 1, 2),
      k AS (SELECT g, least(greatest(sum(x * y) / sum(x * x), 0.2), 5.0) AS scale, count(*) AS n, any_value(s) AS s FROM l JOIN d USING (g) WHERE abs(r - m) <= 3 * s GROUP BY 1)
      SELECT g, round(scale, 4) AS scale, round(s / sqrt(n), 5) AS sigma, n, round(CASE WHEN abs(ln(scale)) > 2 * sqrt(s * s / n + 0.0009) THEN scale ELSE 1 END, 4) AS target FROM k""")
def prior_scale(t):
    rows = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1500).alias("y"))
    return R.prior_scale(rows, ["g"], "x", "y").select("g", F.round("scale", 4).alias("scale"), F.round("sigma", 5).alias("sigma"), "n", F.round("target", 4).alias("target"))


@q("SELECT l_suppkey, round(median(l_discount * 60), 4) AS median_deg, round(max(l_discount * 60), 4) AS max_deg, count(*) AS pairs, median(l_discount * 60) > 3 OR max(l_discount * 60) > 10 AS inconsistent FROM lineitem WHERE l_quantity < 5 GROUP BY 1")
def rotation_check(t):
    rows = t("lineitem").where("l_quantity < 5").select("l_suppkey", (F.col("l_discount") * 60).alias("deg"))
    return R.rotation_check(rows, ["l_suppkey"], "deg").select("l_suppkey", F.round("median_deg", 4).alias("median_deg"), F.round("max_deg", 4).alias("max_deg"), "pairs", "inconsistent")


@q("SELECT user_id, event_id AS hypothesis, CAST(floor(value) AS BIGINT) AS inliers FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d NULLS LAST, floor(value) DESC, event_id) AS r FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_id % 17 END AS d, max(floor(value)) OVER (PARTITION BY user_id) AS b FROM events) WHERE floor(value) >= 0.25 * b) WHERE r = 1")
def locate_choice(t):
    rows = t("events").select("user_id", F.col("event_id").alias("hypothesis"), F.floor("value").alias("inliers"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 17).alias("prior_distance"))
    return R.choose_hypothesis(rows, ["user_id"]).select("user_id", "hypothesis", "inliers")


@q("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey AS b FROM lineitem WHERE l_quantity >= 49), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), w AS (SELECT 1 AS f, 0 AS k UNION SELECT u.b, k + 1 FROM w JOIN u ON u.a = w.f WHERE k < 14)
      SELECT CAST(f AS BIGINT) AS frame, CAST(min(k) AS INTEGER) AS round FROM w GROUP BY 1""")
def registered_rounds(t):
    e = t("lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1000000).alias("b")).distinct()
    frames = e.sparkSession.sql("SELECT CAST(1 AS BIGINT) AS frame, TRUE AS origin")
    return R.registered_rounds(frames, e)


@q("SELECT cut, count(*) AS crossing FROM (SELECT unnest(range(CAST(least(a, b) AS BIGINT), CAST(greatest(a, b) AS BIGINT))) AS cut FROM (SELECT l_suppkey AS a, (l_partkey * 7) % 100 AS b FROM lineitem WHERE l_quantity = 1)) GROUP BY 1 HAVING count(*) < 400")
def weak_cuts(t):
    pairs = t("lineitem").where("l_quantity = 1").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") * 7 % 100).alias("b")).where("a <> b")
    return R.weak_cuts(pairs, 400)


@q("SELECT g, CASE min(o) WHEN 1 THEN 'priors' WHEN 2 THEN 'depth' WHEN 3 THEN 'camera_height' WHEN 4 THEN 'baseline' ELSE 'monocular' END AS source FROM (SELECT user_id AS g, CASE WHEN event_type = 'view' AND value / 300 >= 0.3 THEN 1 WHEN event_type = 'click' AND value > 95 THEN 2 WHEN event_type = 'purchase' AND value > 80 THEN 3 WHEN event_type = 'signup' THEN 4 WHEN event_type = 'error' THEN 5 END AS o FROM events) WHERE o IS NOT NULL GROUP BY 1")
def scale_source(t):
    v, e = F.col("value"), F.col("event_type")
    source = F.when(e == "view", "priors").when((e == "click") & (v > 95), "depth").when((e == "purchase") & (v > 80), "camera_height").when(e == "signup", "baseline").when(e == "error", "monocular")
    rows = t("events").select(F.col("user_id").alias("g"), source.alias("source"), (v / 300).alias("span")).where("source IS NOT NULL")
    return R.scale_source(rows, ["g"])


@q("SELECT a.vec_id AS frame, min(b.vec_id) AS of FROM embeddings a, embeddings b WHERE b.vec_id < a.vec_id AND a.label = b.label AND sqrt(pow(a.embedding[1]::DOUBLE - b.embedding[1]::DOUBLE, 2) + pow(a.embedding[2]::DOUBLE - b.embedding[2]::DOUBLE, 2) + pow(a.embedding[3]::DOUBLE - b.embedding[3]::DOUBLE, 2)) <= 0.05 GROUP BY 1")
def pose_duplicates(t):
    frames = t("embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("camera"), *[F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")])
    return R.duplicates(frames, 0.05)


@q("""SELECT o_orderkey, list_filter([CASE WHEN o_totalprice > 300000 THEN 'max_residual' END, CASE WHEN o_custkey % 50 > 40 THEN 'max_gauge_shift' END, CASE WHEN o_custkey % 9 > 7 THEN 'max_rejected_share' END], x -> x IS NOT NULL) AS failed_checks,
      NOT (o_totalprice > 300000 OR o_custkey % 50 > 40 OR o_custkey % 9 > 7) AS accepted FROM orders""".replace("list_filter([", "array_to_string(list_filter([").replace("x -> x IS NOT NULL)", "lambda x: x IS NOT NULL), ',')"))
def gate_checks(t):
    k = F.col("o_custkey")
    rows = E.gate(t("orders"), {"max_residual": (F.col("o_totalprice"), 300000), "max_gauge_shift": (k % 50, 40), "max_rejected_share": (k % 9, 7)})
    return rows.select("o_orderkey", F.array_join("failed_checks", ",").alias("failed_checks"), "accepted")


TARGETS = "(VALUES ('click', '>=', 50.0, NULL, NULL, FALSE), ('view', 'between', NULL, 49.0, 50.0, FALSE), ('error', '<', 1.0, NULL, NULL, TRUE), ('signup', '<=', 50.0, NULL, NULL, FALSE)) v(metric_id, op, target, lo, hi, info)"


@q(f"""SELECT r.metric_id, r.value, CASE WHEN info THEN 'info' WHEN op IS NULL THEN 'no_target' WHEN CASE op WHEN '>=' THEN r.value >= target WHEN '<=' THEN r.value <= target WHEN '<' THEN r.value < target ELSE r.value BETWEEN lo AND hi END THEN 'pass' ELSE 'fail' END AS status
       FROM (SELECT event_type AS metric_id, round(avg(value), 8) AS value FROM events GROUP BY 1) r LEFT JOIN {TARGETS} USING (metric_id)""")
def metric_judge(t):
    e = t("events")
    targets = e.sparkSession.createDataFrame([("click", ">=", 50.0, None, None, False), ("view", "between", None, 49.0, 50.0, False), ("error", "<", 1.0, None, None, True), ("signup", "<=", 50.0, None, None, False)], "metric_id string, op string, target double, lo double, hi double, info boolean")
    return E.judge(e.groupBy(F.col("event_type").alias("metric_id")).agg(F.round(F.avg("value"), 8).alias("value")), targets)


@q("""WITH a AS (SELECT user_id::VARCHAR AS metric_id, avg(value) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id::VARCHAR AS metric_id, avg(value) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1)
      SELECT metric_id, round(a.v, 8) AS now, round(b.v, 8) AS before, coalesce(CASE WHEN metric_id LIKE '1%' THEN a.v - b.v ELSE b.v - a.v END > greatest(2.0, 0.05 * abs(b.v)), FALSE) AS regressed FROM a JOIN b USING (metric_id)""")
def regress_compare(t):
    half = lambda k: t("events").where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").cast("string").alias("metric_id")).agg(F.avg("value").alias("value"))
    return E.regressions(half(0), half(1), F.col("metric_id").startswith("1"), 2.0, 0.05).select("metric_id", F.round("now", 8).alias("now"), F.round("before", 8).alias("before"), "regressed")


@q("SELECT event_type, count(*) FILTER (event_id % 5 = 2) AS held, count(*) AS n FROM events GROUP BY 1")
def hold_out_plan(t):
    return E.hold_out(t("events"), "event_id", 5, 2).groupBy("event_type").agg(F.count(F.when(F.col("held_out"), 1)).alias("held"), F.count(F.lit(1)).alias("n"))


@q("SELECT event_type, user_id, round(avg(value), 8) AS mean, count(value) AS n FROM events GROUP BY GROUPING SETS ((event_type, user_id), (event_type))")
def pooled_metrics(t):
    return E.pooled(t("events"), "event_type", "user_id", "value").select("event_type", "user_id", F.round("mean", 8).alias("mean"), "n")


@q("SELECT round(12.5 + sum(n * m), 3) AS eta FROM (SELECT event_type, count(*) AS n, median(value) AS m FROM events GROUP BY 1)")
def duration_prediction(t):
    g = t("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.median("value").alias("median"))
    return R.eta(12.5, g).select(F.round("eta", 3).alias("eta"))


@q()
def object_merges(t):
    """Objects of orders, a block of cells and some sightings each, merged with their duplicates."""
    rows = t("lineitem").withColumn("id", F.floor(F.col("l_orderkey") / 40))
    jitter = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3))
    x = (F.col("id") % 60) * 3 + jitter(1) + F.col("l_linenumber") % 4
    y = F.floor(F.col("id") / 60) * 3 + jitter(2) + F.col("l_quantity").cast("long") % 4
    cells = rows.select("id", x.alias("x"), y.alias("y"), (F.col("l_partkey") % 3).alias("z"))
    sightings = rows.select("id", (F.col("l_suppkey") % 997).alias("frame"), F.when(F.col("id") % 3 == 0, F.col("l_returnflag")).otherwise("thing").alias("label"))
    marks = rows.select("id").distinct().select("id", (F.col("id") % 4 > 0).alias("touched"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("published"))
    return merging.merged(cells, sightings, marks)
