"""Predicates, measures and small models as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.functions import geometry as G
from atlasloom.functions import text as T
from atlasloom.operators import checks as K
from atlasloom.operators import evaluation as E
from atlasloom.operators import grid
from atlasloom.operators import objects as O
from atlasloom.operators import registration as R
from atlasloom.operators import rules
from atlasloom.operators import windows as W
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


@q("SELECT l_suppkey, count(*) AS n, count(*) FILTER (z BETWEEN 0.05 AND 6.0) AS valid FROM (SELECT l_suppkey, CASE WHEN l_discount > 0 THEN l_quantity / (l_discount * 100) END AS z FROM lineitem) GROUP BY 1")
def valid_depths(t):
    z = F.when(F.col("l_discount") > 0, F.col("l_quantity") / (F.col("l_discount") * 100))
    return t("lineitem").select("l_suppkey", z.alias("z")).groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(K.valid_depth("z"), 1)).alias("valid"))


@q("SELECT event_id, CASE WHEN s >= 0.5 THEN 0.5 ELSE greatest(0, least(s, 0.05)) END AS floor FROM (SELECT event_id, value / 100 - 0.1 AS s FROM events)")
def request_floors(t):
    return t("events").select("event_id", K.request_floor(F.col("value") / 100 - 0.1).alias("floor"))


@q("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_extendedprice / 1e5 >= 0.5 AND least(l_quantity / 100, l_discount) >= 0.03 AND l_returnflag <> 'N'")
def sound_detections(t):
    rows = t("lineitem").withColumns({"score": F.col("l_extendedprice") / 1e5, "width": F.col("l_quantity") / 100, "height": F.col("l_discount"), "label": F.col("l_returnflag")})
    return K.sound_detections(rows, F.lit(K.TRUSTED_SCORE), ["N"]).select("l_orderkey", "l_linenumber", "l_partkey")


@q("SELECT l_partkey, round(t, 6) AS top, n AS points FROM (SELECT l_partkey, quantile_cont(l_discount, 0.9) AS t, count(*) AS n FROM lineitem GROUP BY 1) WHERE n >= 10 AND t < 0.3937 - 0.3")
def below_floor(t):
    return K.below_floor(t("lineitem"), ["l_partkey"], "l_discount", F.lit(0.3937)).select("l_partkey", F.round("top", 6).alias("top"), "points")


@q("""WITH w AS (SELECT vec_id, [embedding[1]::DOUBLE * 3, embedding[2]::DOUBLE * 3, embedding[3]::DOUBLE * 3] AS w FROM embeddings), a AS (SELECT *, sqrt(w[1] * w[1] + w[2] * w[2] + w[3] * w[3]) AS a FROM w)
      SELECT vec_id, round(1 - (1 - cos(a)) * (w[2] * w[2] + w[3] * w[3]) / (a * a), 6) AS r00, round((1 - cos(a)) * w[1] * w[2] / (a * a) - sin(a) * w[3] / a, 6) AS r01, round((1 - cos(a)) * w[2] * w[3] / (a * a) + sin(a) * w[1] / a, 6) AS r21, round(w[1], 6) AS x, round(w[2], 6) AS y, round(w[3], 6) AS z FROM a""")
def rotation_vectors(t):
    """Rotation vectors as rotations, and back."""
    w = F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double") * 3)
    rows = t("embeddings").select("vec_id", K.exp_so3(w).alias("r")).withColumn("w", K.log_so3("r"))
    named = {"r00": F.col("r")[0], "r01": F.col("r")[1], "r21": F.col("r")[7], "x": F.col("w")[0], "y": F.col("w")[1], "z": F.col("w")[2]}
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in named.items()])


@q("SELECT event_id, round(least(d, 360 - d), 5) AS yaw, round(abs(event_id % 30 - event_id % 17), 5) AS tilt FROM (SELECT event_id, abs(event_id % 360 - (event_id * 7) % 360) AS d FROM events)")
def yaw_tilt_split(t):
    """Turns about the up axis after tilts about x: the split gives their differences."""

    def turned(a, b):
        c, s, d, e = F.cos(F.radians(a)), F.sin(F.radians(a)), F.cos(F.radians(b)), F.sin(F.radians(b))
        return F.array(c, -s * d, s * e, s, c * d, -c * e, F.lit(0.0), e, d)

    k = F.col("event_id")
    rows = t("events").select("event_id", turned(k % 360, k % 30).alias("a"), turned(k * 7 % 360, k % 17).alias("b"))
    return rows.select("event_id", K.yaw_tilt("a", "b").alias("s")).select("event_id", F.round("s.yaw", 5).alias("yaw"), F.round("s.tilt", 5).alias("tilt"))


@q("""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity * 12 - 320) / 300 AS x, (l_discount * 4000 + 1 - 240) / 310 AS y FROM lineitem), r AS (SELECT *, 1 - 0.2 * (x * x + y * y) AS d FROM p), s AS (SELECT *, 1 + 0.8 * (x * x + y * y) / (d * d) AS e FROM r)
      SELECT l_orderkey, l_linenumber, l_partkey, round(x / d, 6) AS x, round(y / d, 6) AS y, round(2 / (1 + sqrt(e)) * x / d * 300 + 320, 5) AS u, round(2 / (1 + sqrt(e)) * y / d * 310 + 240, 5) AS v FROM s""")
def lens_model(t):
    """Rays of pixels under the division model, and the pixels that show them."""
    camera = [F.lit(v) for v in (300.0, 310.0, 320.0, 240.0, -0.2)]
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", K.lens_ray(F.col("l_quantity") * 12, F.col("l_discount") * 4000 + 1, *camera).alias("r"))
    rows = rows.withColumn("p", K.lens_pixel("r.x", "r.y", *camera))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.round("r.x", 6).alias("x"), F.round("r.y", 6).alias("y"), F.round("p.u", 5).alias("u"), F.round("p.v", 5).alias("v"))


@q("SELECT s_suppkey, greatest(0.06, 3.0 * (s_suppkey % 60) / 1000) AS band FROM supplier")
def floor_bands(t):
    return t("supplier").select("s_suppkey", K.floor_band((F.col("s_suppkey") % 60) / 1000).alias("band"))


@q("SELECT p_partkey, regexp_full_match(CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN '.' || p_brand ELSE repeat(p_brand, 7) END, '[A-Za-z0-9][A-Za-z0-9._-]{0,63}') AS sound FROM part")
def map_names(t):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.replace("p_name", F.lit(" "), F.lit("_"))).when(k == 2, F.concat(F.lit("."), "p_brand")).otherwise(F.repeat("p_brand", 7))
    return t("part").select("p_partkey", K.sound_name(name).alias("sound"))


@q("SELECT p_partkey, p_size % 5 = p_partkey % 5 AND coalesce(CASE WHEN p_size % 3 > 0 THEN p_size % 3 END, 1) = coalesce(CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 END, 1) AND nullif(p_size % 2, 0) IS NOT DISTINCT FROM nullif(p_partkey % 2, 0) AS same FROM part")
def camera_equality(t):
    described = lambda c: {"width": F.col(c).cast("long") % 5, "scale": F.when(F.col(c) % 3 > 0, F.col(c).cast("long") % 3), "k": F.nullif(F.col(c).cast("long") % 2, F.lit(0))}
    return t("part").select("p_partkey", K.same_camera(described("p_size"), described("p_partkey"), {"scale": F.lit(1).cast("long")}).alias("same"))


@q("SELECT event_id, coalesce(abs(value / 50 - 0.1 - 1.0) > 3 * sqrt(0.0004 + pow(event_id % 40 / 100.0, 2) / 3), FALSE) AS off FROM events")
def height_gate(t):
    return t("events").select("event_id", K.height_off(F.col("value") / 50, F.lit(0.1), F.lit(1.0), F.lit(0.02), F.col("event_id") % 40 / 100.0).alias("off"))


@q("""WITH f AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sensor' WHEN 1 THEN 'mono' ELSE 'none' END AS kind, CASE WHEN event_id % 5 > 0 THEN 1.0 END AS h, CASE WHEN event_id % 7 > 0 THEN 0.5 + value / 100 END AS own, event_id % 10 / 10.0 AS s FROM events),
      g AS (SELECT *, h IS NULL OR kind = 'none' OR own IS NULL AS plain, 3 * sqrt(0.0004 + 0.0001 * h * h + s * s / 3) AS bound FROM f)
      SELECT event_id, NOT (NOT plain AND kind = 'sensor' AND abs(own - h) > bound) AS content, round(CASE WHEN NOT plain AND kind = 'mono' AND abs(h / own - 1) <= 0.3 THEN h / own END, 6) AS factor, NOT (NOT plain AND kind = 'mono' AND abs(h / own - 1) > 0.3) AS judged FROM g""")
def floor_verdicts(t):
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "sensor").when(k % 3 == 1, "mono").otherwise("none")
    v = K.floor_verdict(kind, F.when(k % 5 > 0, 1.0), F.lit(0.0), k % 10 / 10.0, F.when(k % 7 > 0, 0.5 + F.col("value") / 100), F.lit(1.0))
    return t("events").select("event_id", v.alias("v")).select("event_id", "v.content", F.round("v.factor", 6).alias("factor"), "v.judged")


@q("SELECT l_orderkey, l_linenumber, (CAST(l_suppkey - 50 AS BIGINT) + 1048576) % 1048576 * 4398046511104 + CASE WHEN l_suppkey >= 50 THEN 4611686018427387904 ELSE 0 END + (CAST(l_linenumber AS BIGINT) + 1048576) * 2097152 + (CAST(-l_quantity AS BIGINT) + 1048576) AS key FROM lineitem")
def voxel_keys(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", G.voxel_key(F.col("l_suppkey") - 50, "l_linenumber", -F.col("l_quantity")).alias("key"))


@q("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN date_trunc('second', o_orderdate) END AS at FROM orders")
def name_times(t):
    """Times written in file names."""
    name = F.concat(F.lit("scan-"), F.date_format("o_orderdate", "yyyyMMdd-HHmmss"), F.lit(".jpg"))
    return t("orders").select("o_orderkey", T.time_in_name(F.when(F.col("o_orderkey") % 4 > 0, name).otherwise(F.lit("scan.jpg"))).cast("timestamp_ntz").alias("at"))


GROUPS = {"view": "look", "click": "look", "purchase": "pay"}


@q("WITH g AS (SELECT * FROM (VALUES ('view', 'look'), ('click', 'look'), ('purchase', 'pay')) v(label, grp)), e AS (SELECT event_id, event_type AS a, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT event_id, a = b OR coalesce(x.grp = y.grp, FALSE) AS alike FROM e LEFT JOIN g x ON x.label = a LEFT JOIN g y ON y.label = b WHERE b IS NOT NULL")
def compatible_labels(t):
    e = W.changes(t("events"), ["user_id"], ["event_id"], "event_type").where("previous IS NOT NULL")
    groups = e.sparkSession.createDataFrame(list(GROUPS.items()), "label string, grp string")
    side = lambda c, n: groups.select(F.col("label").alias(c), F.col("grp").alias(n))
    j = e.join(side("event_type", "x"), "event_type", "left").join(side("previous", "y"), "previous", "left")
    return j.select("event_id", O.compatible(F.col("event_type"), F.col("previous"), F.col("x"), F.col("y")).alias("alike"))


@q("""WITH g AS (SELECT DISTINCT l_suppkey AS row, CAST(l_quantity AS BIGINT) AS col FROM lineitem WHERE l_discount < 0.1), r AS (SELECT s_suppkey AS id, s_suppkey + 0.5 AS y, s_nationkey + 0.5 AS x, cos(s_suppkey) AS dx, sin(s_suppkey) AS dy FROM supplier),
      m AS (SELECT id, k * 0.25 AS t, CAST(floor(x + dx * k * 0.25) AS BIGINT) AS col, CAST(floor(y + dy * k * 0.25) AS BIGINT) AS row FROM r, range(81) v(k)) SELECT id, min(t) FILTER (g.row IS NULL) AS range FROM m LEFT JOIN g USING (row, col) GROUP BY 1""")
def ray_march(t):
    cells = t("lineitem").where("l_discount < 0.1").select(F.col("l_suppkey").alias("row"), F.col("l_quantity").cast("long").alias("col"), F.lit(grid.FREE).alias("state")).distinct()
    s = F.col("s_suppkey")
    rays = t("supplier").select(s.alias("id"), (F.col("s_nationkey") + 0.5).alias("x"), (s + 0.5).alias("y"), F.cos(s).alias("dx"), F.sin(s).alias("dy"))
    return grid.ray_hits(rays, cells, 0.25, 20.0, 1.0)


@q("""WITH d AS (SELECT l_suppkey AS row, CAST(l_linenumber AS BIGINT) AS col, CASE WHEN sum(l_quantity) % 11 > 0 THEN avg(l_extendedprice) END AS z FROM lineitem GROUP BY 1, 2)
      SELECT a.row, a.col, bool_or(b.z IS NULL) OR (max(b.z) - min(b.z)) / any_value(a.z) > 0.2 AS edge FROM d a JOIN d b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 WHERE a.z > 0 GROUP BY 1, 2""")
def edge_pixels(t):
    g = t("lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_linenumber").cast("long").alias("col")).agg(F.avg("l_extendedprice").alias("m"), F.sum("l_quantity").alias("s"))
    raster = g.select(F.lit(0).alias("frame"), "row", "col", F.when(F.col("s") % 11 > 0, F.col("m")).alias("z"))
    return grid.depth_edges(raster, ["frame"], 0.2).select("row", "col", "edge")


@q("SELECT s_suppkey, round(abs((s_nationkey + 1) * (s_acctbal / 100)) / 2, 6) AS area, s_suppkey % 7 + 3 AS cells FROM supplier")
def plane_areas(t):
    """Areas of triangles by their corners, of masks by their run lengths."""
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    zero = F.lit(0.0)
    shape = F.array(corner(zero, zero), corner(F.col("s_nationkey") + 1, zero), corner(F.col("s_suppkey"), F.col("s_acctbal") / 100))
    runs = F.array(F.lit(2), (F.col("s_suppkey") % 7).cast("int"), F.lit(5), F.lit(3))
    return t("supplier").select("s_suppkey", F.round(G.polygon_area(shape), 6).alias("area"), T.rle_area(runs).alias("cells"))


@q("SELECT vec_id, round(sqrt(pow(embedding[1]::DOUBLE, 2) + pow(embedding[2]::DOUBLE, 2) + 0.01), 6) AS sigma FROM embeddings")
def pose_sigma(t):
    e = [F.pow(F.col("embedding")[k].cast("double"), F.lit(2.0)) for k in range(2)]
    zero = F.lit(0.0)
    return t("embeddings").select("vec_id", F.round(R.sigma_of(F.array(e[0], zero, zero, zero, e[1], zero, zero, zero, F.lit(0.01))), 6).alias("sigma"))


@q("SELECT l_orderkey, count(*) AS pixels, count(*) FILTER (p_size <= 20) AS ignored FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count(*) FILTER (p_size <= 20) <= 0.5 * count(*)")
def unignored_detections(t):
    pixels = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    return K.unignored(pixels, ["l_orderkey"], F.col("p_size") <= 20)


@q("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events)
      SELECT user_id, event_id FROM r WHERE n <= 20 OR r IN (SELECT CAST(floor(k * ((n - 1) / 19.0)) AS BIGINT) FROM range(20) v(k))""")
def spread_rows(t):
    return W.spread_sample(t("events"), ["user_id"], ["event_id"], 20).select("user_id", "event_id")


@q("SELECT event_id, round(CASE WHEN event_type = 'view' THEN 50 + 1.2 * (value - 50) ELSE value END, 8) AS x FROM events")
def scaled_priors(t):
    return t("events").select("event_id", F.round(K.scaled_prior("value", F.lit(50.0), F.lit(1.2), F.col("event_type") == "view"), 8).alias("x"))


@q("SELECT user_id, round(sqrt(0.01 + pow(0.75, 2) * sum((event_id % 9 + 1) * value * value) / sum(event_id % 9 + 1)), 6) AS sigma FROM events GROUP BY 1")
def composed_sigmas(t):
    v = K.composed_sigma(t("events").select("user_id", (F.col("event_id") % 9 + 1).alias("inliers"), F.col("value").alias("sigma")), "user_id")
    return v.select("user_id", F.round(rules.reference_sigma(F.lit(0.1), F.lit(0.25), F.col("variance")), 6).alias("sigma"))


@q("""WITH e AS (SELECT user_id, ln(value) AS l, 1 / pow(event_id % 5 + 1, 2) AS w FROM events WHERE value > 0), c AS (SELECT *, sum(w) OVER (PARTITION BY user_id ORDER BY l) AS c, sum(w) OVER (PARTITION BY user_id) AS a FROM e), m AS (SELECT user_id, min(l) AS m FROM c WHERE 2 * c >= a GROUP BY 1)
      SELECT user_id, round(CASE WHEN 2 * count(*) FILTER (abs(l - m) <= 0.8) > count(*) THEN exp(sum(l * w) FILTER (abs(l - m) <= 0.8) / sum(w) FILTER (abs(l - m) <= 0.8)) END, 5) AS scale, count(*) FILTER (abs(l - m) <= 0.8) AS near, count(*) AS pairs FROM e JOIN m USING (user_id) GROUP BY 1""")
def keyframe_scales(t):
    rows = t("events").select("user_id", "value", (F.col("event_id") % 5 + 1.0).alias("sigma"))
    return rules.keyframe_scale(rows, ["user_id"], "value", "sigma", 0.8).withColumn("scale", F.round("scale", 5))


@q("SELECT p_partkey FROM part WHERE (p_size % 3 <> 1) AND (p_partkey % 4 IN (0, 2))")
def capable_metrics(t):
    """Metrics whose needs, each a list of alternatives, are all met by pose and depth."""
    size, part = F.col("p_size") % 3, F.col("p_partkey") % 4
    needs = F.array(F.when(size == 1, F.array(F.lit("mask"))).otherwise(F.array(F.lit("mask"), F.lit("pose"))), F.when(part.isin(0, 2), F.array(F.lit("depth"))).otherwise(F.array(F.lit("prior"))))
    return E.capable(t("part").withColumn("needs", needs), ["pose", "depth"]).select("p_partkey")


@q("""WITH g AS (SELECT DISTINCT l_suppkey AS row, CAST(l_quantity AS BIGINT) AS col FROM lineitem WHERE l_discount < 0.1), r AS (SELECT s_suppkey AS id, s_suppkey + 0.5 AS y, s_nationkey + 0.5 AS x, cos(s_suppkey) AS dx, sin(s_suppkey) AS dy FROM supplier),
      m AS (SELECT id, x, y, dx, dy, k * 0.25 AS t, CAST(floor(x + dx * k * 0.25) AS BIGINT) AS col, CAST(floor(y + dy * k * 0.25) AS BIGINT) AS row FROM r, range(1, 81) v(k)),
      k AS (SELECT id, x, y, dx, dy, min(CASE WHEN g.row IS NULL THEN {'t': t, 'r': m.row, 'c': m.col} END) AS k FROM m LEFT JOIN g ON g.row = m.row AND g.col = m.col GROUP BY ALL),
      b AS (SELECT id, x, y, dx, dy, k.k.t AS t, k.k.r AS row, k.k.c AS col FROM k)
      SELECT id, round(least(greatest(greatest(least((col - x) / dx, (col + 1 - x) / dx), least((row - y) / dy, (row + 1 - y) / dy)), t - 0.25), t), 6) AS range, row, col FROM b""")
def ray_entries(t):
    """Where rays enter the first cell that is not free, by its bounds."""
    cells = t("lineitem").where("l_discount < 0.1").select(F.col("l_suppkey").alias("row"), F.col("l_quantity").cast("long").alias("col"), F.lit(grid.FREE).alias("state")).distinct()
    s = F.col("s_suppkey")
    rays = t("supplier").select(s.alias("id"), (F.col("s_nationkey") + 0.5).alias("x"), (s + 0.5).alias("y"), F.cos(s).alias("dx"), F.sin(s).alias("dy"))
    return grid.ray_entries(rays, cells, 0.25, 20.0, 1.0).withColumn("range", F.round("range", 6))


@q("""WITH RECURSIVE s AS (SELECT l_suppkey AS r, CAST(l_quantity AS BIGINT) AS c, max(CASE WHEN l_discount >= 0.09 THEN 2 ELSE 1 END) AS s FROM lineitem GROUP BY 1, 2), o AS (SELECT r, c, r * 1000 + c AS id FROM s WHERE s = 2),
      u AS (SELECT a.id AS a, b.id AS b FROM o a JOIN o b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1 AND a.id <> b.id),
      g(node, root) USING KEY (node) AS (SELECT id, id FROM o UNION SELECT u.a, min(g.root) FROM u JOIN g ON u.b = g.node JOIN recurring.g h ON h.node = u.a WHERE g.root < h.root GROUP BY 1),
      l AS (SELECT root FROM o JOIN g ON g.node = o.id GROUP BY 1 HAVING greatest(max(r) - min(r), max(c) - min(c)) + 1 >= 6), w AS (SELECT r, c FROM o JOIN g ON g.node = o.id SEMI JOIN l USING (root)),
      d AS (SELECT i, j FROM range(-1, 2) a(i), range(-1, 2) b(j) WHERE i <> 0 OR j <> 0),
      n AS (SELECT DISTINCT r, c FROM (SELECT r, c, i, j FROM (SELECT w.r - m * i AS r, w.c - m * j AS c, i, j, m FROM w, d, range(1, 5) v(m)) GROUP BY r, c, i, j HAVING min(m) = 1 AND count(*) < 4)),
      b AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM s), k AS (SELECT r, c FROM n, b WHERE r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1)
      SELECT coalesce(s.r, k.r) AS row, coalesce(s.c, k.c) AS col, CASE WHEN k.r IS NOT NULL THEN 2 ELSE s.s END AS state FROM s FULL JOIN k ON s.r = k.r AND s.c = k.c""")
def thin_wall_inflation(t):
    """Long thin walls grow by a cell; other occupied cells stay as seen."""
    cells = t("lineitem").groupBy(F.col("l_suppkey").alias("row"), F.col("l_quantity").cast("long").alias("col")).agg(F.max(F.when(F.col("l_discount") >= 0.09, grid.OCCUPIED).otherwise(grid.FREE)).alias("state"))
    return grid.inflated_walls(cells, 0.25)
