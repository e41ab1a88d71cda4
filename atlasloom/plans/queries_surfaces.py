"""Nearest places, normals and upright boxes as queries; the vectors of `embeddings` are points, depth grids and point groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import boxes as B
from atlasloom.operators import quantiles
from atlasloom.operators import surfaces as S
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

_POINTS = "SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings"


def _points(t):
    return t("embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")])


@q(f"""WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) AS d2 FROM p a, p b),
      r AS (SELECT vec_id, d2, row_number() OVER (PARTITION BY vec_id ORDER BY d2) AS r FROM d)
      SELECT vec_id, count(*) AS neighbours, round(sqrt(max(d2)), 9) AS farthest, round(sum(sqrt(d2)), 7) AS total FROM r WHERE r <= 16 GROUP BY vec_id""")
def nearest_neighbourhoods(t):
    """The exact sixteen nearest points of each point: how many, how far the last, how far in all."""
    p = _points(t)
    at = S.places(p)
    near = S.nearest_places(at, at, 16, 0.05)
    total = lambda f: F.aggregate("near", F.lit(0.0), lambda s, v: s + f(v))
    out = p.join(near, ["x", "y", "z"])
    return out.select("vec_id", total(lambda v: v["n"]).cast("long").alias("neighbours"), F.round(F.sqrt(F.element_at("near", -1)["d2"]), 9).alias("farthest"), F.round(total(lambda v: F.sqrt(v["d2"]) * v["n"]), 7).alias("total"))


@q(f"""WITH p AS ({_POINTS}), d AS (SELECT a.vec_id, b.x, b.y, b.z, row_number() OVER (PARTITION BY a.vec_id ORDER BY pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2), b.x, b.y, b.z) AS r FROM p a, p b),
      c AS (SELECT vec_id, var_pop(x) AS a, var_pop(y) AS b, var_pop(z) AS c, covar_pop(x, y) AS d, covar_pop(y, z) AS e, covar_pop(x, z) AS f FROM d WHERE r <= 16 GROUP BY vec_id),
      m AS (SELECT *, (a + b + c) / 3 AS m FROM c), s AS (SELECT *, sqrt((pow(a - m, 2) + pow(b - m, 2) + pow(c - m, 2) + 2 * (d * d + e * e + f * f)) / 6) AS s FROM m),
      h AS (SELECT *, ((a - m) * ((b - m) * (c - m) - e * e) - d * (d * (c - m) - e * f) + f * (d * e - (b - m) * f)) / (2 * s * s * s) AS h FROM s),
      l AS (SELECT *, m + 2 * s * cos(acos(greatest(-1, least(1, h))) / 3 + 2 * pi() / 3) AS l FROM h),
      v AS (SELECT vec_id, l, d * e - f * (b - l) AS i, f * d - (a - l) * e AS j, (a - l) * (b - l) - d * d AS k FROM l),
      w AS (SELECT p.*, e.x AS ex, e.y AS ey, e.z + 2 AS ez FROM p, p e WHERE e.vec_id % 50 = 7 QUALIFY row_number() OVER (PARTITION BY p.vec_id ORDER BY pow(p.x - e.x, 2) + pow(p.y - e.y, 2) + pow(p.z - e.z - 2, 2)) = 1),
      n AS (SELECT *, CASE WHEN i * (ex - x) + j * (ey - y) + k * (ez - z) < 0 THEN -1 ELSE 1 END / sqrt(i * i + j * j + k * k) AS n FROM v JOIN w USING (vec_id))
      SELECT vec_id, round(sqrt(greatest(0, l)), 6) AS residual, round(i * n, 4) + 0 AS nx, round(j * n, 4) + 0 AS ny, round(k * n, 4) + 0 AS nz FROM n""")
def point_normals(t):
    """The direction in which each point's sixteen nearest spread least, turned to the nearest of some viewpoints, and their spread along it."""
    views = _points(t).where("vec_id % 50 = 7").select("x", "y", (F.col("z") + 2).alias("z"))
    out = S.point_normals(_points(t), views, 16, 0.05)
    return out.select("vec_id", F.round("residual", 6).alias("residual"), *[(F.round(F.col("normal")[i], 4) + 0.0).alias(c) for i, c in enumerate(("nx", "ny", "nz"))])


@q("""WITH g AS (SELECT vec_id // 16 AS frame, vec_id % 16 AS v, CAST(unnest(range(64)) AS BIGINT) AS u, embedding FROM embeddings),
      z AS (SELECT frame, u, v, CASE WHEN embedding[u + 1] > -0.2 THEN 2 + embedding[u + 1]::DOUBLE ELSE 0 END AS z FROM g),
      p AS (SELECT *, CASE WHEN z > 0 THEN (u - 31.5) * z / 60 END AS x, CASE WHEN z > 0 THEN (v - 7.5) * z / 60 END AS y, CASE WHEN z > 0 THEN z END AS d FROM z),
      n AS (SELECT *, lead(x) OVER r AS rx, lead(y) OVER r AS ry, lead(d) OVER r AS rz, lag(x) OVER r AS lx, lag(y) OVER r AS ly, lag(d) OVER r AS lz, lead(x) OVER c AS dx, lead(y) OVER c AS dy, lead(d) OVER c AS dz, lag(x) OVER c AS ux, lag(y) OVER c AS uy, lag(d) OVER c AS uz FROM p WINDOW r AS (PARTITION BY frame, v ORDER BY u), c AS (PARTITION BY frame, u ORDER BY v)),
      f AS (SELECT *, coalesce(abs(rz - d), 1e308) <= coalesce(abs(lz - d), 1e308) AS ahead, coalesce(abs(dz - d), 1e308) <= coalesce(abs(uz - d), 1e308) AS below FROM n),
      t AS (SELECT *, CASE WHEN ahead THEN rx - x ELSE x - lx END AS ax, CASE WHEN ahead THEN ry - y ELSE y - ly END AS ay, CASE WHEN ahead THEN rz - d ELSE d - lz END AS az, CASE WHEN below THEN dx - x ELSE x - ux END AS vx, CASE WHEN below THEN dy - y ELSE y - uy END AS vy, CASE WHEN below THEN dz - d ELSE d - uz END AS vz FROM f),
      k AS (SELECT *, ay * vz - az * vy AS i, az * vx - ax * vz AS j, ax * vy - ay * vx AS k FROM t),
      w AS (SELECT *, sqrt(i * i + j * j + k * k) AS l, sqrt(x * x + y * y + d * d) AS away FROM k),
      o AS (SELECT frame, u, v, x, y, d, CASE WHEN l > 0 THEN i / l ELSE -x / away END AS i, CASE WHEN l > 0 THEN j / l ELSE -y / away END AS j, CASE WHEN l > 0 THEN k / l ELSE -d / away END AS k FROM w)
      SELECT frame, u, v, round(coalesce(CASE WHEN i * x + j * y + k * d > 0 THEN -i ELSE i END, 0), 6) + 0 AS nx, round(coalesce(CASE WHEN i * x + j * y + k * d > 0 THEN -j ELSE j END, 0), 6) + 0 AS ny, round(coalesce(CASE WHEN i * x + j * y + k * d > 0 THEN -k ELSE k END, 0), 6) + 0 AS nz FROM o""")
def depth_grid_normals(t):
    """Normals of depth grids of 64 by 16 pixels, some of them without depth."""
    grid = t("embeddings").select(F.floor(F.col("vec_id") / 16).cast("long").alias("frame"), (F.col("vec_id") % 16).alias("v"), F.posexplode("embedding").alias("u", "e"))
    grid = grid.select("frame", F.col("u").cast("long").alias("u"), "v", F.when(F.col("e") > -0.2, 2 + F.col("e").cast("double")).otherwise(0.0).alias("z"))
    out = S.depth_normals(grid, ["frame"], 60.0, 60.0, 31.5, 7.5)
    return out.select("frame", "u", "v", *[(F.round(F.col("normal")[i], 6) + 0.0).alias(c) for i, c in enumerate(("nx", "ny", "nz"))])


_GROUPS = "SELECT vec_id, i, embedding[4 * i + 1]::DOUBLE AS x, embedding[4 * i + 2]::DOUBLE AS y, embedding[4 * i + 3]::DOUBLE AS z FROM (SELECT vec_id, embedding, unnest(range(16)) AS i FROM embeddings)"
_BOX_SQL = f"""WITH p AS ({_GROUPS}),
      e AS (SELECT DISTINCT vec_id, round(a - floor(a / (pi() / 2)) * (pi() / 2), 4) AS yaw FROM (SELECT a.vec_id, atan2(b.y - a.y, b.x - a.x) AS a FROM p a JOIN p b USING (vec_id) JOIN p c USING (vec_id) WHERE a.i <> b.i GROUP BY a.vec_id, a.i, b.i, a.x, a.y, b.x, b.y HAVING min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) >= 0)),
      q AS (SELECT vec_id, yaw, quantile_cont(cos(yaw) * x + sin(yaw) * y, [0.02, 0.98]) AS a, quantile_cont(cos(yaw) * y - sin(yaw) * x, [0.02, 0.98]) AS b, quantile_cont(z, [0.02, 0.98]) AS c FROM p JOIN e USING (vec_id) GROUP BY ALL),
      s AS (SELECT *, a[2] - a[1] AS w, b[2] - b[1] AS d, (a[1] + a[2]) / 2 AS ma, (b[1] + b[2]) / 2 AS mb FROM q),
      o AS (SELECT *, degrees(yaw) + CASE WHEN d > w THEN 90 ELSE 0 END AS turn FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(w * d, 12), yaw) = 1),
      b AS (SELECT vec_id, ma * cos(yaw) - mb * sin(yaw) AS cx, ma * sin(yaw) + mb * cos(yaw) AS cy, (c[1] + c[2]) / 2 AS cz, greatest(w, d, 0.01) AS width, greatest(least(w, d), 0.01) AS depth, greatest(c[2] - c[1], 0.01) AS height, CASE WHEN turn > 90 THEN turn - 180 ELSE turn END AS yaw FROM o)"""


def _boxes(t):
    e = F.col("embedding")
    rows = t("embeddings").select("vec_id", F.explode(F.array(*[F.struct(*[e[4 * i + j].cast("double").alias(c) for j, c in enumerate("xyz")]) for i in range(16)])).alias("p")).select("vec_id", "p.*")
    return B.upright(rows, ["vec_id"])


@q(_BOX_SQL + " SELECT vec_id, CAST(16 AS BIGINT) AS points, round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz, round(width, 6) AS width, round(depth, 6) AS depth, round(height, 6) AS height, round(yaw, 4) AS yaw FROM b")
def upright_boxes(t):
    """The upright box of the sixteen points of each vector."""
    return _boxes(t).select("vec_id", "points", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "width", "depth", "height")], F.round("yaw", 4).alias("yaw"))


@q(_BOX_SQL + """, g AS (SELECT *, cz - height / 2 AS low, cz + height / 2 AS top, -0.3::DOUBLE AS floor, -0.45::DOUBLE AS level FROM b),
      f AS (SELECT *, low - floor > 0 AND low - floor <= 0.15 AND top > floor AND height >= 0.6 * (top - floor) AND greatest(width, depth, height) >= 0.1 AS stands FROM g),
      h AS (SELECT *, CASE WHEN stands THEN floor ELSE low END AS foot FROM f)
      SELECT vec_id, stands, round((top + CASE WHEN rests THEN level ELSE foot END) / 2, 6) AS cz, round(top - CASE WHEN rests THEN level ELSE foot END, 6) AS height FROM (SELECT *, NOT stands AND low > level AND height >= 0.9 * (top - level) AS rests FROM h)""")
def grounded_boxes(t):
    """The boxes that end little over the floor brought down to it, and of the others those that end little over a lower surface."""
    b = _boxes(t)
    g = B.grounded(b.withColumn("was", F.col("height")), F.lit(-0.3), 0.15, 0.6).withColumn("stands", F.col("height") != F.col("was"))
    out = B.rested(g, F.when(~F.col("stands"), -0.45), 0.9)
    return out.select("vec_id", "stands", F.round("cz", 6).alias("cz"), F.round("height", 6).alias("height"))


@q("SELECT l_returnflag AS flag, count(*) AS n, round(quantile_cont(l_extendedprice::DOUBLE, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS q50, round(quantile_cont(l_extendedprice::DOUBLE, 0.999), 4) AS q999 FROM lineitem GROUP BY 1")
def merged_quantiles(t):
    """Exact quantiles of three large groups, of which no task sorts over 500 values."""
    out = quantiles.exact(t("lineitem"), ["l_returnflag"], "l_extendedprice", (0.01, 0.5, 0.999), most=500)
    return out.select(F.col("l_returnflag").alias("flag"), "n", *[F.round(F.col("q")[i], 4).alias(c) for i, c in enumerate(("q01", "q50", "q999"))])
