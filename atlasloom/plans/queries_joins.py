"""Joins, similarity, graph fixed points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from atlasloom.functions import geometry as G
from atlasloom.operators import graph, joins
from atlasloom.operators import grid as grids
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

COSINE = "SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings b WHERE abs(a.vec_id - b.vec_id) > {gap}"
RANKED = "SELECT query_id, vec_id, score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM ({c})) WHERE r <= {k}"


@q("SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM (" + RANKED.format(c=COSINE.format(gap=0), k=5) + ")")
def topk_cosine(t):
    e = t("embeddings")
    return joins.nearest_vectors(e, e, 5).select("query_id", "vec_id", "score", "rank")


@q("SELECT DISTINCT least(query_id, vec_id) AS lo, greatest(query_id, vec_id) AS hi FROM (" + RANKED.format(c=COSINE.format(gap=20), k=3) + ")")
def min_gap_pairs(t):
    """Similar pairs that are not neighbours in sequence, each once."""
    e = t("embeddings")
    return joins.pair_set(joins.nearest_vectors(e, e, 3, gap=20), "query_id", "vec_id")


DIST = "SELECT a.vec_id AS query_id, b.vec_id, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS distance FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id"


@q(f"""WITH r AS (SELECT *, row_number() OVER w AS k, lead(distance) OVER w AS second FROM ({DIST}) WINDOW w AS (PARTITION BY query_id ORDER BY distance, vec_id)),
       s AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, query_id) AS t FROM r WHERE k = 1 AND distance < 0.97 * second) SELECT query_id, vec_id, distance FROM s WHERE t = 1""")
def ratio_test(t):
    e = t("embeddings")
    best = joins.nearest_vectors(e, e, 2, metric="euclidean").select("query_id", "vec_id", (-F.col("score")).alias("distance"))
    return joins.ratio_test(best, 0.97)


@q(f"SELECT label, e.vote, count(*) AS votes FROM (SELECT query_id, l.label AS vote FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS r FROM ({DIST})) JOIN embeddings l USING (vec_id) WHERE r = 1 AND distance < 1.3) e JOIN embeddings o ON o.vec_id = e.query_id GROUP BY 1, 2")
def nearest_label_votes(t):
    e = t("embeddings")
    best = joins.nearest_vectors(e, e, 1, metric="euclidean").where(F.col("score") > -1.3)
    own = e.select(F.col("vec_id").alias("query_id"), "label")
    return best.join(e.select("vec_id", F.col("label").alias("vote")), "vec_id").join(own, "query_id").groupBy("label", "vote").agg(F.count(F.lit(1)).alias("votes"))


@q("SELECT s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 4) AS distance FROM supplier, customer WHERE abs(s_acctbal - c_acctbal) <= 25")
def spatial_range_join(t):
    out = joins.range_join(t("supplier"), t("customer"), ["s_acctbal"], ["c_acctbal"], 25.0)
    return out.select("s_suppkey", "c_custkey", F.round("distance", 4).alias("distance"))


@q("SELECT s_suppkey, p_partkey, round(sqrt(pow(s_acctbal / 100 - p_size, 2) + pow(s_nationkey - p_retailprice / 100, 2)), 4) AS distance FROM supplier, part WHERE sqrt(pow(s_acctbal / 100 - p_size, 2) + pow(s_nationkey - p_retailprice / 100, 2)) <= 1.5")
def planar_range_join(t):
    a = t("supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("ax"), F.col("s_nationkey").cast("double").alias("ay"))
    b = t("part").select("p_partkey", F.col("p_size").cast("double").alias("bx"), (F.col("p_retailprice") / 100).alias("by"))
    return joins.range_join(a, b, ["ax", "ay"], ["bx", "by"], 1.5).select("s_suppkey", "p_partkey", F.round("distance", 4).alias("distance"))


@q("SELECT c_custkey, s_suppkey, round(d, 4) AS distance FROM (SELECT c_custkey, s_suppkey, d, row_number() OVER (PARTITION BY c_custkey ORDER BY d, s_suppkey) AS r FROM (SELECT c_custkey, s_suppkey, abs(c_acctbal - s_acctbal) AS d FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 400)) WHERE r <= 2")
def knn_bounded(t):
    """Up to two nearest places within a bound."""
    near = joins.nearest_on_line(t("customer"), t("supplier"), "c_acctbal", "s_acctbal", "s_suppkey", 400.0, 2)
    return near.select("c_custkey", "s_suppkey", F.round("distance", 4).alias("distance"))


@q("""SELECT event_id, CASE WHEN v.ts IS NOT NULL THEN round(v.value, 4) END AS matched FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_backward(t):
    e = t("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    out = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", "seen")
    return out.select("event_id", F.round("matched", 4).alias("matched"))


@q("""SELECT event_id, round(matched, 4) AS matched FROM (SELECT p.event_id, v.value AS matched, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)) NULLS LAST, v.ts) AS r FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id) WHERE r = 1""")
def asof_nearest(t):
    e = t("events")
    views = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("seen"))
    out = joins.asof(e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, ["user_id"], "ts", "ts", "seen", "nearest")
    return out.select("event_id", F.round("matched", 4).alias("matched"))


@q("""SELECT p.event_id, arg_min(v.event_id, ROW(abs(v.value - p.value), v.ts, v.event_id)) AS best FROM (SELECT * FROM events WHERE event_type = 'purchase') p
      LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON v.user_id = p.user_id AND v.ts BETWEEN p.ts - INTERVAL 3 DAY AND p.ts GROUP BY 1""")
def interval_join(t):
    """The cheapest view in the three days before each purchase."""
    e = t("events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", F.col("value").alias("own"), F.expr("ts - INTERVAL 3 DAYS").alias("lo"), F.col("ts").alias("hi"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), "ts", "value")
    return joins.interval_best(left, right, ["user_id"], "lo", "hi", "ts", F.abs(F.col("value") - F.col("own")), "view_id").select("event_id", "best")


@q("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 AS duplicate, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) AS labelled FROM documents")
def semi_anti_dupes(t):
    d = joins.first_of_duplicates(t("documents"), [F.md5(F.col("text").cast("binary"))], ["doc_id"])
    known = t("labels").select("doc_id").distinct().withColumn("labelled", F.lit(True))
    return d.join(known, "doc_id", "left").select("doc_id", "duplicate", F.coalesce("labelled", F.lit(False)).alias("labelled"))


POLYGONS = [(1, [(5.0, 1.0), (20.0, 2.0), (25.0, 7.0), (10.0, 9.0)]), (2, [(20.0, 0.5), (45.0, 3.0), (30.0, 4.0), (40.0, 8.5)])]


def _crossings(p):
    edges = list(zip(p, p[1:] + p[:1], strict=True))
    return " + ".join(f"CASE WHEN (({a[1]} > y) <> ({b[1]} > y)) AND x < ({b[0]} - {a[0]}) * (y - {a[1]}) / ({b[1]} - {a[1]}) + {a[0]} THEN 1 ELSE 0 END" for a, b in edges)


@q("SELECT * FROM (" + " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS area_id, l_orderkey, l_linenumber FROM (SELECT *, l_quantity AS x, l_discount * 100 AS y FROM lineitem) WHERE ({_crossings(p)}) % 2 = 1" for i, p in POLYGONS) + ")")
def pip_join(t):
    points = t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"))
    spark = points.sparkSession
    areas = spark.createDataFrame([(i, [{"x": a, "y": b} for a, b in p], *(f(v[k] for v in p) for f in (min, max) for k in (0, 1))) for i, p in POLYGONS], "area_id int, polygon array<struct<x: double, y: double>>, x0 double, y0 double, x1 double, y1 double")
    return joins.contained(points, areas, G.in_polygon("x", "y", "polygon"), "x", "y", ("x0", "y0", "x1", "y1"), 5.0).select("area_id", "l_orderkey", "l_linenumber")


@q("SELECT p_partkey, round(sqrt(pow(p_size - 10 - 30 * k, 2) + pow(p_retailprice / 100 - 5 - 10 * k, 2)), 5) AS distance FROM (SELECT *, greatest(0, least(1, ((p_size - 10) * 30 + (p_retailprice / 100 - 5) * 10) / 1000)) AS k FROM part)")
def segment_distance(t):
    return t("part").select("p_partkey", F.round(G.segment_distance(F.col("p_size"), F.col("p_retailprice") / 100, F.lit(10.0), F.lit(5.0), F.lit(40.0), F.lit(15.0)), 5).alias("distance"))


@q("SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(cos(radians(30)) * (l_quantity - 25) + sin(radians(30)) * (l_discount * 100 - 5)) <= 6.05 AND abs(-sin(radians(30)) * (l_quantity - 25) + cos(radians(30)) * (l_discount * 100 - 5)) <= 3.05 AND abs(l_tax * 100 - 4) <= 2.05")
def oriented_box(t):
    inside = G.in_oriented_box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, *[F.lit(float(x)) for x in (25, 5, 4, 12, 6, 4, 30)], margin=0.05)
    return t("lineitem").where(inside).select("l_orderkey", "l_linenumber")


@q("SELECT l_partkey, count(*) AS visible FROM (SELECT *, min(l_extendedprice) OVER (PARTITION BY l_partkey) AS m FROM lineitem) WHERE l_extendedprice <= m * 1.05 GROUP BY 1")
def visibility_join(t):
    return joins.nearest_visible(t("lineitem"), ["l_partkey"], "l_extendedprice").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("visible"))


@q("SELECT l_suppkey, l_linenumber, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity, l_extendedprice, l_orderkey) AS r FROM lineitem) WHERE r = 1")
def exclusive_owner(t):
    return joins.exclusive_owner(t("lineitem"), ["l_suppkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_orderkey"]).select("l_suppkey", "l_linenumber", "l_orderkey")


@q("SELECT user_id, event_id AS a, b FROM (SELECT user_id, event_id, unnest([lead(event_id, 1) OVER w, lead(event_id, 2) OVER w, lead(event_id, 3) OVER w]) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE b IS NOT NULL")
def sequential_pairs(t):
    return joins.sequential_pairs(t("events"), "event_id", ["user_id"], 3)


@q("""SELECT n_name, r_name, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
      WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1, 2""")
def star_join(t):
    """Equi-joins along a star, the fact table filtered at its scan."""
    o = t("orders").where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")).select("o_orderkey", "o_custkey")
    j = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.countDistinct("o_orderkey").alias("orders"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@q("SELECT c_custkey, coalesce(n, 0) AS orders, coalesce(n, 0) > 0 AS active FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def left_default(t):
    n = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return t("customer").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), (F.coalesce("n", F.lit(0)) > 0).alias("active"))


@q()
def greedy_match(t):
    c = t("lineitem").groupBy((F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 60).alias("b")).agg(F.sum("l_quantity").alias("w")).withColumn("g", F.lit(0))
    return joins.greedy_match(c, ["g"], "a", "b", "w").select("a", "b", "w")


EDGES = "SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem WHERE l_quantity >= 49"


@q(f"""WITH RECURSIVE e AS ({EDGES}), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
       r(node, root) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM u GROUP BY 1 UNION SELECT u.a, min(r.root) FROM u JOIN r ON u.b = r.node JOIN recurring.r c ON c.node = u.a WHERE r.root < c.root GROUP BY 1)
       SELECT node, root AS component FROM r""")
def conn_components(t):
    e = t("lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct()
    return graph.connected_components(e)


@q("""WITH RECURSIVE e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem WHERE l_quantity = 50), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
      w AS (SELECT 's1' AS node, 0 AS hops UNION SELECT u.dst, hops + 1 FROM w JOIN u ON u.src = w.node WHERE hops < 4) SELECT 's1' AS start, node, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY node""")
def link_path4(t):
    e = t("lineitem").where("l_quantity = 50").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()
    both = e.union(e.select("dst", "src"))
    start = both.sparkSession.sql("SELECT 's1' AS start")
    return graph.bounded_paths(both, start, 4)


@q()
def span_forest(t):
    e = t("lineitem").groupBy(F.col("l_suppkey").cast("long").alias("src"), (F.col("l_partkey") % 97 + 100000).alias("dst")).agg(F.sum("l_quantity").alias("w"))
    return graph.spanning_forest(e, "w").select("a", "b", "w")


@q("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst FROM lineitem WHERE l_quantity >= 49), u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
      n AS (SELECT DISTINCT a FROM u), g AS (SELECT a AS node, 0 AS steps FROM n WHERE a <= 5 UNION SELECT u.b, steps + 1 FROM g JOIN u ON u.a = g.node WHERE steps < 12)
      SELECT node, CAST(min(steps) AS INTEGER) AS steps FROM g GROUP BY 1""")
def geodesic_steps(t):
    """Steps from the nearest of five labelled cells."""
    e = t("lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1000000).alias("dst")).distinct()
    both = e.union(e.select("dst", "src"))
    cells = both.select(F.col("src").alias("node")).distinct().withColumn("label", F.when(F.col("node") <= 5, F.col("node")))
    return graph.reachable_labels(cells, both, "node", "label").select("node", "steps")


@q("""WITH RECURSIVE f AS (SELECT DISTINCT l_suppkey AS r, l_linenumber AS c FROM lineitem WHERE l_quantity >= 48), k AS (SELECT *, r * 10 + c AS id FROM f), u AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON abs(a.r - b.r) + abs(a.c - b.c) = 1),
      g(node, root) USING KEY (node) AS (SELECT id, id FROM k UNION SELECT u.a, min(g.root) FROM u JOIN g ON u.b = g.node JOIN recurring.g h ON h.node = u.a WHERE g.root < h.root GROUP BY 1)
      SELECT CAST(root // 10 AS BIGINT) AS root_row, CAST(root % 10 AS INTEGER) AS root_col, count(*) AS cells FROM g GROUP BY root""")
def grid_regions(t):
    """Cells of 4-connected pieces."""
    cells = t("lineitem").where("l_quantity >= 48").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).distinct()
    return grids.components(cells, corners=False).groupBy("root_row", "root_col").agg(F.count(F.lit(1)).alias("cells"))


@q("SELECT r AS row, c AS col FROM (SELECT DISTINCT l_suppkey AS r, l_linenumber AS c FROM lineitem WHERE l_quantity >= 45) f WHERE (SELECT count(*) FROM (SELECT DISTINCT l_suppkey AS r, l_linenumber AS c FROM lineitem WHERE l_quantity >= 45) o WHERE abs(o.r - f.r) + abs(o.c - f.c) = 1) < 4")
def frontier_cells(t):
    cells = t("lineitem").where("l_quantity >= 45").select(F.col("l_suppkey").alias("row"), F.col("l_linenumber").alias("col")).distinct()
    known = cells.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"))
    return grids.neighbours(cells, corners=False).join(known, ["n_row", "n_col"], "left_anti").select("row", "col").distinct()
