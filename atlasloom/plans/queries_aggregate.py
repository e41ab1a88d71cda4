"""Aggregations, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.functions import geometry as G
from atlasloom.functions import text as T
from atlasloom.operators import aggregates as A
from atlasloom.functions import codecs
from atlasloom.operators import grid, solvers
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

AXES = {"l_quantity": 5.0, "l_discount": 0.02}
CELLS = "CAST(floor(l_quantity / 5.0) AS BIGINT) AS i_l_quantity, CAST(floor(l_discount / 0.02) AS BIGINT) AS i_l_discount"


@q(f"SELECT {CELLS}, count(*) AS n, round(avg(l_extendedprice), 8) AS mean_price FROM lineitem GROUP BY 1, 2")
def voxel_mean(t):
    return A.voxel_mean(t("lineitem"), AXES, ["l_extendedprice"]).select("i_l_quantity", "i_l_discount", "n", F.round("mean_l_extendedprice", 8).alias("mean_price"))


@q(f"SELECT {CELLS}, count(*) AS n, round(sum(l_tax), 4) AS sum_tax FROM lineitem GROUP BY 1, 2")
def voxel_merge(t):
    """Partial states of two halves, added up."""
    rows = t("lineitem")
    halves = [A.voxel_state(rows.where(F.pmod("l_orderkey", F.lit(2)) == k), AXES, ["l_tax"]) for k in (0, 1)]
    return A.merge_states(*halves).select("i_l_quantity", "i_l_discount", "n", F.round("sum_l_tax", 4).alias("sum_tax"))


PICK = "SELECT i_l_quantity, i_l_discount, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, {cells}, row_number() OVER (PARTITION BY floor(l_quantity / 5.0), floor(l_discount / 0.02) ORDER BY l_orderkey {d}, l_linenumber {d}, l_partkey {d}, l_suppkey {d}, l_extendedprice {d}) AS r FROM lineitem {w}) WHERE r = 1"


def _pick(rows, keep):
    return A.voxel_pick(rows, AXES, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], keep).select("i_l_quantity", "i_l_discount", "l_orderkey", "l_linenumber", "l_extendedprice")


@q(PICK.format(cells=CELLS, d="ASC", w=""))
def voxel_first(t):
    return _pick(t("lineitem"), "first")


@q(PICK.format(cells=CELLS, d="DESC", w=""))
def voxel_last(t):
    return _pick(t("lineitem"), "last")


@q(PICK.format(cells=CELLS, d="DESC", w="WHERE l_quantity BETWEEN 10 AND 30 AND l_tax BETWEEN 0.02 AND 0.06"))
def box_thin_points(t):
    """Points in a box, the last of each voxel; the box reaches the scan as pushed filters."""
    return _pick(t("lineitem").where(F.col("l_quantity").between(10, 30) & F.col("l_tax").between(0.02, 0.06)), "last")


@q()
def budget_grid(t):
    """Smallest edge whose voxels fit the budget, and their first rows."""
    parts = t("part").withColumn("size", F.col("p_size").cast("double"))
    return A.budgeted(parts, ["size", "p_retailprice"], 200, ["p_partkey"]).select("p_partkey", "p_size", "p_retailprice", "edge")


@q("""SELECT o_orderpriority, round(m, 4) AS median, round(1.4826 * d, 4) AS sigma, n FROM
      (SELECT o_orderpriority, m, median(abs(o_totalprice - m)) AS d, count(*) AS n FROM (SELECT *, median(o_totalprice) OVER (PARTITION BY o_orderpriority) AS m FROM orders) GROUP BY 1, 2)""")
def mad_by_group(t):
    return A.mad(t("orders"), ["o_orderpriority"], "o_totalprice").select("o_orderpriority", F.round("median", 4).alias("median"), F.round("sigma", 4).alias("sigma"), "n")


LOGS = "SELECT *, ln(l_extendedprice / l_quantity) AS r FROM lineitem WHERE l_extendedprice > 0 AND l_quantity > 0"
GATED = f"l AS ({LOGS}), m AS (SELECT l_returnflag, median(r) AS m FROM l GROUP BY 1), d AS (SELECT l_returnflag, m, median(abs(r - m)) AS d FROM l JOIN m USING (l_returnflag) GROUP BY 1, 2)"


@q(f"WITH {GATED} SELECT l_returnflag, round(exp(median(r)), 4) AS ratio, count(*) AS n FROM l JOIN d USING (l_returnflag) WHERE abs(r - m) <= 3 * 1.4826 * d + 1e-9 GROUP BY 1")
def robust_ratio(t):
    return A.robust_ratio(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", F.round("ratio", 4).alias("ratio"), "n")


@q("""WITH l AS (SELECT l_partkey % 50 AS g, l_quantity AS x, l_extendedprice AS y, ln(l_extendedprice / l_quantity) AS r FROM lineitem),
      m AS (SELECT g, median(r) AS m FROM l GROUP BY 1), d AS (SELECT g, m, 1.4826 * median(abs(r - m)) AS s FROM l JOIN m USING (g) GROUP BY 1, 2),
      j AS (SELECT *, abs(r - m) <= 3 * greatest(s, 0.02) AS ok FROM l JOIN d USING (g))
      SELECT g, CASE WHEN count(*) FILTER (ok) >= 5 AND 2 * count(*) FILTER (ok) > count(*) THEN round(sum(x * y) FILTER (ok) / sum(x * x) FILTER (ok), 4) END AS slope, count(*) FILTER (ok) AS agreeing, count(*) AS n FROM j GROUP BY 1""")
def lsq_ratio_gate(t):
    rows = t("lineitem").select((F.col("l_partkey") % 50).alias("g"), "l_quantity", "l_extendedprice")
    return A.gated_least_squares(rows, ["g"], "l_quantity", "l_extendedprice").select("g", F.round("slope", 4).alias("slope"), "agreeing", "n")


@q("SELECT user_id, round(sum(value / (s * s)) / sum(1 / (s * s)), 4) AS fused, round(1 / sqrt(sum(1 / (s * s))), 6) AS fused_sigma FROM (SELECT *, 1.0 + event_id % 7 AS s FROM events) GROUP BY 1")
def inverse_variance(t):
    rows = t("events").withColumn("s", 1.0 + F.col("event_id") % 7)
    return A.inverse_variance(rows, ["user_id"], "value", "s").select("user_id", F.round("fused", 4).alias("fused"), F.round("fused_sigma", 6).alias("fused_sigma"))


@q("SELECT substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) AS month, round(quantile_cont(l_extendedprice, 0.02), 4) AS lo, round(quantile_cont(l_extendedprice, 0.98), 4) AS hi FROM lineitem GROUP BY 1")
def p2_p98_extent(t):
    rows = t("lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    return A.extent(rows, ["month"], "l_extendedprice").select("month", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@q("""WITH h AS (SELECT CAST(floor(o_totalprice / 10000.0) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1),
      s AS (SELECT bin + o AS bin, sum(n) / 3.0 AS smooth FROM h, (VALUES (-1), (0), (1)) v(o) GROUP BY 1),
      w AS (SELECT *, coalesce(CASE WHEN lag(bin) OVER (ORDER BY bin) = bin - 1 THEN lag(smooth) OVER (ORDER BY bin) END, 0) AS a, coalesce(CASE WHEN lead(bin) OVER (ORDER BY bin) = bin + 1 THEN lead(smooth) OVER (ORDER BY bin) END, 0) AS b FROM s)
      SELECT bin, round(smooth, 6) AS smooth FROM w WHERE smooth >= a AND smooth > b""")
def hist_peaks(t):
    return A.peaks(A.histogram(t("orders"), "o_totalprice", 10000.0)).select("bin", F.round("smooth", 6).alias("smooth"))


@q("""SELECT user_id, -v AS start, n FROM (SELECT user_id, max(ROW(n, -value)) AS b FROM (SELECT user_id, value, count(*) OVER (PARTITION BY user_id ORDER BY value RANGE BETWEEN CURRENT ROW AND 10.0 FOLLOWING) AS n FROM events) GROUP BY 1), LATERAL (SELECT b[1] AS n, b[2] AS v)""")
def densest_window(t):
    return A.densest_window(t("events").select("user_id", "value"), ["user_id"], "value", 10.0)


VOTES = "WITH s AS (SELECT user_id, event_type, count(DISTINCT ts::DATE) AS frames FROM events GROUP BY 1, 2), a AS (SELECT user_id, count(DISTINCT ts::DATE) AS n FROM events GROUP BY 1), v AS (SELECT user_id, event_type, frames, round_even(frames / n, 4) AS share FROM s JOIN a USING (user_id))"


def _shares(t):
    return A.vote_shares(t("events").withColumn("frame", F.to_date("ts")), "user_id", "event_type", "frame")


@q(f"{VOTES} SELECT * FROM v")
def vote_share(t):
    return _shares(t)


@q(f"""{VOTES}, b AS (SELECT *, event_type = 'purchase' AND share >= max(share) OVER (PARTITION BY user_id) - 0.15 - 1e-9 AS w FROM v)
       SELECT user_id, event_type, share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, share DESC, event_type) AS r FROM b) WHERE r = 1""")
def label_choice(t):
    return A.label_choice(_shares(t), "user_id", "event_type", F.col("event_type") == "purchase")


@q("""WITH s AS (SELECT user_id, event_type, sum(value) AS e FROM events GROUP BY 1, 2), j AS (SELECT *, event_type <> 'view' AND e >= 0.25 * sum(e) OVER (PARTITION BY user_id) AS sp FROM s)
      SELECT user_id, event_type, round(e, 4) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY sp DESC, e DESC, event_type) AS r FROM j) WHERE r = 1""")
def label_evidence(t):
    return A.label_evidence(t("events"), "user_id", "event_type", "value", ["view"]).select("user_id", "event_type", F.round("evidence", 4).alias("evidence"))


@q("SELECT event_type, round(median(value), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 50 GROUP BY 1")
def last_n_median_p90(t):
    return A.last_n(t("events"), ["event_type"], [F.desc("ts"), F.desc("event_id")], "value").select("event_type", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"), "n")


@q("SELECT cell, CAST(least(sum(w), 65535) AS BIGINT) AS weight, count(*) AS frames FROM (SELECT l_partkey % 100 AS cell, l_suppkey, max(CAST(greatest(1, least(4, round_even(4 / (l_quantity / 10), 0))) AS BIGINT)) AS w FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def saturating_weights(t):
    """Range-weighted votes per cell, the largest per frame, saturating like a 16-bit counter."""
    rows = t("lineitem").withColumn("cell", F.col("l_partkey") % 100)
    weight = G.clamp(F.bround(4 / (F.col("l_quantity") / 10)), 1, 4).cast("long")
    return A.saturating_weights(rows, ["cell"], "l_suppkey", weight)


@q("SELECT g, CASE WHEN count(*) >= 12 THEN max(l_extendedprice) FILTER (r = 3) END AS nth, count(*) AS support FROM (SELECT l_orderkey % 500 AS g, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey % 500 ORDER BY l_extendedprice DESC) AS r FROM lineitem) GROUP BY 1")
def nth_largest(t):
    return A.nth_largest(t("lineitem").withColumn("g", F.col("l_orderkey") % 500), ["g"], "l_extendedprice")


@q("SELECT user_id, count(DISTINCT least(floor(value / 100.0 * 8), 7) * 8 + least(floor((event_id % 1000) / 1000.0 * 8), 7)) / 64.0 AS coverage FROM events WHERE value >= 0 AND value <= 100 GROUP BY 1")
def coverage_ratio(t):
    rows = t("events").where(F.col("value").between(0, 100))
    return A.coverage(rows, ["user_id"], F.col("value") / 100.0, (F.col("event_id") % 1000) / 1000.0)


HOW = {"click": "median", "purchase": "p90", "view": "max", "signup": "sum"}


@q("SELECT event_type, CASE event_type WHEN 'click' THEN round(median(value), 4) WHEN 'purchase' THEN round(quantile_cont(value, 0.9), 4) WHEN 'view' THEN round(max(value), 4) WHEN 'signup' THEN round(sum(value), 4) END AS value, count(value) AS samples FROM events GROUP BY 1")
def metric_reduce(t):
    return A.reduce_metrics(t("events").select("event_type", "value"), HOW, "event_type").select("event_type", F.round("value", 4).alias("value"), "samples")


@q("SELECT CAST(floor(l_orderkey / 8.0) AS BIGINT) AS row, CAST(floor(l_linenumber / 8.0) AS BIGINT) AS col, max(l_quantity % 3) AS state, max(l_quantity) AS observations, max(l_extendedprice) AS height FROM lineitem GROUP BY 1, 2")
def grid_resample(t):
    cells = t("lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_linenumber").alias("col"), (F.col("l_quantity") % 3).alias("state"), F.col("l_quantity").alias("observations"), F.col("l_extendedprice").alias("height"))
    return A.worst_state(cells, 8)


@q("""WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem GROUP BY 1)
      SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 3) AS mean, count(*) AS n FROM lineitem JOIN b USING (l_returnflag) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def trimmed_mean(t):
    return A.trimmed_mean(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity").select("l_returnflag", F.round("mean", 3).alias("mean"), "n")


@q("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE user_id % 10 = user_id % 10),
      f AS (SELECT user_id, r, value AS h FROM e WHERE r = 1 UNION ALL SELECT e.user_id, e.r, CASE WHEN abs(e.value - f.h) > 25 THEN e.value ELSE f.h END FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1)
      SELECT user_id, arg_max(h, r) AS held FROM f GROUP BY 1""")
def floor_hysteresis(t):
    return A.hysteresis(t("events"), ["user_id"], "event_id", "value", 25.0)


@q("SELECT row, col, max(CASE WHEN hit > 0 AND hit >= 0.2 * (hit + free) AND z BETWEEN 0.05 AND 1.8 THEN 1 ELSE 0 END) AS o, round(max(CASE WHEN hit > 0 AND hit >= 0.2 * (hit + free) THEN z END), 6) AS height, CAST(sum(hit) AS BIGINT) AS observations FROM (SELECT l_suppkey AS row, CAST(floor(l_quantity) AS BIGINT) AS col, (l_linenumber * 5 + 0.5) * 0.05 AS z, CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS hit, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_linenumber END AS free FROM lineitem) GROUP BY 1, 2")
def volume_layers(t):
    """Occupied cells and surface heights of a voxel table."""
    v = t("lineitem").select(F.col("l_suppkey").alias("iy"), F.floor("l_quantity").alias("ix"), (F.col("l_linenumber") * 5).alias("iz"), F.when(F.col("l_returnflag") == "A", F.col("l_linenumber")).otherwise(0).alias("hit"), F.when(F.col("l_returnflag") == "A", 0).otherwise(F.col("l_linenumber")).alias("free"))
    g = grid.layers(v, 0.05, 1.8, 0.05)
    return g.select("row", "col", (F.col("state") == grid.OCCUPIED).cast("int").alias("o"), F.round("height", 6).alias("height"), "observations")


@q("""WITH o AS (SELECT DISTINCT l_suppkey AS r, l_linenumber AS c FROM lineitem WHERE l_quantity = 50), g AS (SELECT l_suppkey AS r, l_linenumber AS c, max(CASE WHEN l_quantity = 50 THEN 2 ELSE 1 END) AS s FROM lineitem GROUP BY 1, 2)
      SELECT g.r AS row, g.c AS col, CAST(CASE WHEN EXISTS (SELECT 1 FROM o WHERE abs(o.r - g.r) <= 1 AND abs(o.c - g.c) <= 1) THEN 2 ELSE g.s END AS INTEGER) AS state FROM g""")
def wall_inflation(t):
    cells = t("lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.max(F.when(F.col("l_quantity") == 50, 2).otherwise(1)).alias("state"))
    return grid.inflated(cells).select("row", F.col("col").cast("int").alias("col"), "state")


@q("SELECT CAST(floor(l_discount / 0.02) AS BIGINT) AS row, CAST(floor(l_quantity / 5.0) AS BIGINT) AS col, arg_max(l_orderkey, ROW(l_extendedprice, l_orderkey)) AS value, max(l_extendedprice) AS height FROM lineitem GROUP BY 1, 2")
def highest_per_pixel(t):
    """The bird's-eye raster: what stands highest in each pixel."""
    rows = t("lineitem").select((F.col("l_quantity") / 5.0).alias("x"), (F.col("l_discount") / 0.02).alias("y"), "l_extendedprice", "l_orderkey")
    return grid.highest(rows, 1.0, "x", "y", "l_extendedprice", F.col("l_orderkey"), "l_orderkey")


@q("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS mean FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
def rollup_metrics(t):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 6).alias("mean"))


@q("SELECT strftime(l_shipmode_day, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM (SELECT *, CAST(l_shipdate AS DATE) AS l_shipmode_day FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 20 AND NOT isnan(l_tax) AND NOT isinf(l_tax)) GROUP BY 1")
def finite_box_counts(t):
    """Finite points in a box, with exact distinct counts."""
    rows = t("lineitem").where(F.col("l_quantity").between(10, 20)).where(G.finite("l_tax"))
    return rows.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_suppkey").alias("suppliers"))


@q("SELECT event_id, round(180 - (((180 - value * 13) % 360) + 360) % 360, 6) AS wrapped, round_even(value, 1) AS even, CAST(greatest(10, least(50, value)) AS DOUBLE) AS clamped FROM events")
def scalar_angles(t):
    return t("events").select("event_id", F.round(G.wrap_degrees(F.col("value") * 13), 6).alias("wrapped"), G.half_even("value", 1).alias("even"), G.clamp("value", 10.0, 50.0).alias("clamped"))


@q("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT vec_id, list_transform(e[1:4], lambda x: x / sqrt(e[1] * e[1] + e[2] * e[2] + e[3] * e[3] + e[4] * e[4])) AS q FROM v)
      SELECT vec_id, round(1 - 2 * (q[2] * q[2] + q[3] * q[3]), 5) AS r0, round(2 * (q[1] * q[2] - q[3] * q[4]), 5) AS r1, round(degrees(acos(greatest(-1, least(1, (3 - 4 * (q[1] * q[1] + q[2] * q[2] + q[3] * q[3]) - 1) / 2)))), 3) AS angle FROM u""")
def quaternion_rotation(t):
    """Rotations of quaternions: two entries and the angle."""
    r = t("embeddings").select("vec_id", G.rotation_from_quaternion(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 4)).alias("r"))
    pose = F.array(*[F.col("r")[3 * i + j] if j < 3 else F.lit(0.0) for i in range(3) for j in range(4)], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    return r.select("vec_id", F.round(F.col("r")[0], 5).alias("r0"), F.round(F.col("r")[1], 5).alias("r1"), F.round(G.rotation_angle(pose), 3).alias("angle"))


@q("SELECT vec_id, TRUE AS same FROM embeddings")
def quaternion_round_trip(t):
    """A rotation's quaternion gives the rotation back."""
    qn = F.slice(F.transform("embedding", lambda x: x.cast("double")), 5, 4)
    r = t("embeddings").select("vec_id", G.rotation_from_quaternion(qn).alias("r"))
    back = G.rotation_from_quaternion(G.quaternion_from_rotation("r"))
    return r.select("vec_id", F.forall(F.zip_with("r", back, lambda a, b: F.abs(a - b) < 1e-9), lambda x: x).alias("same"))


@q("SELECT s_suppkey, TRUE AS same, round(10 + 2 * (s_acctbal / 100), 4) AS x FROM supplier")
def pose_algebra(t):
    """A pose composed with its inverse is the identity; a similarity moves a point."""
    a = F.radians(F.col("s_acctbal"))
    p = F.array(F.cos(a), -F.sin(a), F.lit(0.0), F.lit(1.0), F.sin(a), F.cos(a), F.lit(0.0), F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(3.0), *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
    rows = t("supplier").select("s_suppkey", "s_acctbal", p.alias("p"))
    eye = [float(i == j) for i in range(4) for j in range(4)]
    one = G.compose("p", G.inverse("p"))
    still = F.array(*[F.lit(x) for x in eye[:3]], F.lit(10.0), *[F.lit(x) for x in eye[4:]])
    x = G.apply(still, F.array(F.col("s_acctbal") / 100, F.lit(0.0), F.lit(0.0)), 2.0)[0]
    return rows.select("s_suppkey", F.forall(F.zip_with(one, F.array(*[F.lit(x) for x in eye]), lambda a, b: F.abs(a - b) < 1e-9), lambda v: v).alias("same"), F.round(x, 4).alias("x"))


@q("SELECT p_partkey, CASE WHEN p_size > 25 THEN round(270.0 * (p_retailprice / 1000) / (p_size - 25) + 320, 8) END AS u, round((160 - 320.0) * (p_size / 10.0) / 270.0, 6) AS x FROM part")
def project_unproject(t):
    point = F.array(F.col("p_retailprice") / 1000, F.lit(0.0), (F.col("p_size") - 25).cast("double"))
    f, cx, cy = F.lit(270.0), F.lit(320.0), F.lit(240.0)
    return t("part").select("p_partkey", F.round(G.project(point, f, f, cx, cy)["u"], 8).alias("u"), F.round(G.unproject(F.lit(160), F.lit(120), F.col("p_size") / 10.0, f, f, cx, cy)[0], 6).alias("x"))


@q("""SELECT p_partkey, round(0.2126 * lin(p_size * 5) + 0.7152 * lin(100) + 0.0722 * lin(p_size), 6) AS luminance, '#' || lower(lpad(printf('%X', p_size * 5), 2, '0')) || '6400' AS colour,
      CASE WHEN v <= b THEN b WHEN v <= 2 * b THEN 2 * b WHEN v <= 5 * b THEN 5 * b ELSE 10 * b END AS step
      FROM (SELECT *, p_retailprice AS v, pow(10.0, floor(log10(p_retailprice))) AS b FROM part)""".replace("lin(p_size * 5)", "CASE WHEN p_size * 5 / 255.0 <= 0.04045 THEN p_size * 5 / 255.0 / 12.92 ELSE pow((p_size * 5 / 255.0 + 0.055) / 1.055, 2.4) END").replace("lin(100)", "pow((100 / 255.0 + 0.055) / 1.055, 2.4)").replace("lin(p_size)", "CASE WHEN p_size / 255.0 <= 0.04045 THEN p_size / 255.0 / 12.92 ELSE pow((p_size / 255.0 + 0.055) / 1.055, 2.4) END"))
def colour_scale(t):
    return t("part").select("p_partkey", F.round(G.luminance(F.col("p_size") * 5, F.lit(100), F.col("p_size")), 6).alias("luminance"), T.hex_colour(F.col("p_size") * 5, F.lit(100), F.lit(0)).alias("colour"), G.nice_step("p_retailprice").alias("step"))


@q("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_type || '_ ' || p_brand), '_', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM part")
def normalize_label(t):
    return t("part").select("p_partkey", T.normalize_label(F.concat("p_type", F.lit("_ "), "p_brand")).alias("label"))


@q("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@q("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, length(html) AS n_chars, url LIKE 'https:%' AS secure FROM pages")
def html_extract(t):
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.length("html").cast("long").alias("n_chars"), F.col("url").startswith("https:").alias("secure"))


@q("SELECT event_id, sha256(event_type) AS digest, 'f' || lpad(CAST(event_id AS VARCHAR), greatest(6, length(CAST(event_id AS VARCHAR)))::INTEGER, '0') AS name FROM events")
def names_digests(t):
    return t("events").select("event_id", F.sha2("event_type", 256).alias("digest"), T.frame_name("event_id").alias("name"))


@q("SELECT user_id, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS area FROM events GROUP BY 1")
def rle_runs(t):
    """Area of a flag's run lengths: runs by islands, lengths in order, the odd ones added up."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = t("events").select("user_id", "event_id", (F.col("value") > 50).alias("set"))
    rows = rows.withColumn("run", F.sum((F.col("set") != F.lag("set", 1, False).over(w)).cast("long")).over(w))
    runs = rows.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("n"))
    # Runs begin with unset cells; a first run of set cells has number 1.
    counts = runs.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("run", "n"))).alias("c"))
    whole = F.when(F.col("c")[0]["run"] == 1, F.concat(F.array(F.lit(0).cast("long")), F.transform("c", lambda x: x["n"]))).otherwise(F.transform("c", lambda x: x["n"]))
    return counts.select("user_id", T.rle_area(whole).alias("area"))


@q("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, max(length(text)) AS longest FROM documents GROUP BY 1, 2")
def document_counts(t):
    return t("documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


def _matched(t, bx, by, bz):
    rows = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("ax"), (F.col("l_discount") * 100).alias("ay"), (F.col("l_tax") * 100).alias("az"))
    return rows.withColumns({"bx": bx, "by": by, "bz": bz})


@q("SELECT l_returnflag, count(*) AS n, 2.0 AS scale, TRUE AS turned, 3.0 AS tx FROM lineitem GROUP BY 1")
def similarity_fit(t):
    """A quarter turn about the up axis, twice the size, moved by three."""
    fit = solvers.similarity(_matched(t, -2 * F.col("ay") + 3, 2 * F.col("ax") + 1, 2 * F.col("az")), ["l_returnflag"])
    return fit.select("l_returnflag", "n", F.round("scale", 6).alias("scale"), (F.abs(F.col("rotation")[3] - 1) < 1e-9).alias("turned"), F.round(F.col("translation")[0], 6).alias("tx"))


@q("SELECT l_returnflag, count(*) AS n, 90.0 AS yaw_deg, 3.0 AS tx, 1.0 AS ty, 2.0 AS tz FROM lineitem GROUP BY 1")
def upright_fit(t):
    fit = solvers.upright(_matched(t, -F.col("ay") + 3, F.col("ax") + 1, F.col("az") + 2), ["l_returnflag"])
    return fit.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("yaw_deg", "tx", "ty", "tz")])


@q("SELECT l_returnflag, count(*) AS n, 2.0 AS a, 3.0 AS b, 1.0 AS c FROM lineitem GROUP BY 1")
def plane_fit(t):
    rows = t("lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y")).withColumn("z", 2 * F.col("x") + 3 * F.col("y") + 1)
    return solvers.plane(rows, ["l_returnflag"]).select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in "abc"])


@q("SELECT l_suppkey % 5 AS g, TRUE AS level FROM lineitem GROUP BY 1")
def robust_plane(t):
    """A level floor among a fifth of outliers."""
    rows = t("lineitem").select((F.col("l_suppkey") % 5).alias("g"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.when(F.col("l_orderkey") % 5 == 0, F.col("l_extendedprice") / 1000 + 5).otherwise(0.0).alias("z"))
    return solvers.robust_plane(rows, ["g"]).select("g", ((F.col("nz") > 0.999) & (F.abs("d") < 0.01)).alias("level"))


@q("""WITH c AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) * 37) AS c FROM documents), d AS (SELECT doc_id, list_transform(c, lambda x, i: CASE WHEN i > 3 THEN x - c[i - 2] ELSE x END) AS d FROM c),
      g AS (SELECT doc_id, list_transform(d, lambda x: array_to_string(list_transform(range(CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 WHEN x BETWEEN -16384 AND 16383 THEN 3 WHEN x BETWEEN -524288 AND 524287 THEN 4 ELSE 5 END),
        lambda k: chr(CAST(48 + CASE WHEN k + 1 < CASE WHEN x BETWEEN -16 AND 15 THEN 1 WHEN x BETWEEN -512 AND 511 THEN 2 WHEN x BETWEEN -16384 AND 16383 THEN 3 WHEN x BETWEEN -524288 AND 524287 THEN 4 ELSE 5 END THEN 32 ELSE 0 END + (x + 33554432) // CAST(pow(32, k) AS BIGINT) % 32 AS INTEGER))), '')) AS g FROM d)
      SELECT doc_id, sha256(array_to_string(g, '')) AS coded, TRUE AS same FROM g""")
def rle_codec(t):
    """Run lengths as text, and back."""
    counts = t("documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w) * 37).alias("counts"))
    coded = counts.withColumn("c", codecs.encode_rle("counts"))
    return coded.select("doc_id", F.sha2("c", 256).alias("coded"), (codecs.decode_rle("c") == F.col("counts")).alias("same"))


@q("""SELECT vec_id, base64(array_to_string(list_transform(embedding, lambda x: array_to_string(list_transform([25, 17, 9, 1], lambda k: substr(CAST(CAST(x AS FLOAT) AS BIT)::VARCHAR, CAST(k AS BIGINT), 8)), '')), '')::BIT::BLOB) AS coded, TRUE AS same FROM embeddings""")
def array_codec(t):
    """Floats as base64 text, and back."""
    coded = t("embeddings").withColumn("coded", codecs.encode_array("embedding"))
    return coded.select("vec_id", "coded", (codecs.decode_array("coded") == F.col("embedding")).alias("same"))
