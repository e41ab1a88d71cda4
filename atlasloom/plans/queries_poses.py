"""Frame placement as queries: correspondences, sequential hypotheses with planted rivals, guards."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from atlasloom.operators import hypotheses as H
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


def _split(columns: str) -> list[str]:
    """Columns apart; commas inside brackets stay."""
    return re.split(r", (?![^(]*\))", columns)


_MATCH = "l_suppkey AS frame, l_partkey % 300 AS feature, CAST(l_quantity AS DOUBLE) AS u, l_linenumber AS v, l_orderkey % 40 AS candidate, (l_orderkey % 40 * 7) % 11 AS rank, l_linenumber % 2 AS guided, l_partkey % 50 AS point"


@q(f"""WITH m AS (SELECT {_MATCH} FROM lineitem), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame, feature ORDER BY rank, guided, point, candidate, u, v) AS n FROM m) WHERE n = 1),
      r AS (SELECT *, (candidate * 3 + point - 60) / 50.0 AS rx, (point * 2 - candidate - 30) / 40.0 AS ry, CASE WHEN (candidate + point) % 7 > 0 THEN (1 + candidate * point % 5) * (1 + candidate % 3 / 10.0) END AS z, cos(candidate / 7.0) AS c, sin(candidate / 7.0) AS s FROM b)
      SELECT frame, feature, u, v, candidate, round(candidate / 4.0 + (c * rx - s * ry) * z, 5) AS x0, round(1 + (s * rx + c * ry) * z, 5) AS x1, round(2 + z, 5) AS x2, round((c * rx - s * ry) / sqrt(rx * rx + ry * ry + 1), 5) AS d0, round(1 / sqrt(rx * rx + ry * ry + 1), 5) AS d2 FROM r""")
def correspondence_assembly(t):
    """One lifted point for each keypoint of a frame."""
    rows = t("lineitem")
    points = rows.selectExpr("l_orderkey % 40 AS candidate", "l_partkey % 50 AS point").distinct().selectExpr("candidate", "point", "CAST(100 + candidate * 3 + point AS DOUBLE) AS ru", "CAST(100 + point * 2 - candidate AS DOUBLE) AS rv", "IF((candidate + point) % 7 > 0, 1.0D + candidate * point % 5, double('NaN')) AS depth")
    turn = "array(cos(candidate / 7.0D), -sin(candidate / 7.0D), 0D, sin(candidate / 7.0D), cos(candidate / 7.0D), 0D, 0D, 0D, 1D)"
    frames = rows.selectExpr("l_orderkey % 40 AS candidate").distinct().selectExpr("candidate", "50D AS fx", "40D AS fy", "160D AS cx", "130D AS cy", f"{turn} AS r", "array(candidate / 4.0D, 1D, 2D) AS c", "1 + candidate % 3 / 10.0D AS factor")
    out = H.correspondences(rows.selectExpr(*_split(_MATCH)), points, frames)
    places = {f"x{k}": F.round(F.col("x")[k], 5) for k in range(3)} | {"d0": F.round(F.col("d")[0], 5), "d2": F.round(F.col("d")[2], 5)}
    return out.select("frame", "feature", "u", "v", "candidate", *[c.alias(n) for n, c in places.items()])


#: A scene of map points, two cameras for each supplier, and which of them a row was seen by (others: noise).
_SCENE = "l_suppkey, (l_partkey % 97) / 10.0 AS x, (l_orderkey % 89) / 10.0 AS y, 4 + ((l_orderkey * 7 + l_partkey * 3 + l_linenumber) % 61) / 10.0 AS z, (l_orderkey + l_linenumber) % 20 AS kind, (l_suppkey % 63) / 10.0 AS turn, 4 + (l_suppkey % 5) * 0.3 AS cx, 4 + (l_suppkey % 7) * 0.2 AS cy, ((l_orderkey * 7919 + l_linenumber) % 1000) / 1000.0 - 0.5 AS nu, ((l_partkey * 104729 + l_orderkey) % 1000) / 1000.0 - 0.5 AS nv"
_A = ("turn", "cx", "cy", "-3")
_B = ("turn + 0.5", "cx + 1.5", "cy - 1", "-2.5")


def _seen(turn, cx, cy, cz) -> tuple[str, str]:
    return f"(cos({turn}) * (x - ({cx})) + sin({turn}) * (y - ({cy}))) / (z - ({cz}))", f"(cos({turn}) * (y - ({cy})) - sin({turn}) * (x - ({cx}))) / (z - ({cz}))"


def _double(columns: str) -> list[str]:
    return [f"CAST({a} AS DOUBLE) AS {b}" if " AS " in c and b not in ("kind",) else c for c in _split(columns) for a, _, b in [c.partition(" AS ")]]


_OBSERVED = f"CASE WHEN kind < 12 THEN {_seen(*_A)[0]} WHEN kind < 17 THEN {_seen(*_B)[0]} ELSE nu END AS bu, CASE WHEN kind < 12 THEN {_seen(*_A)[1]} WHEN kind < 17 THEN {_seen(*_B)[1]} ELSE nv END AS bv"
_ERROR = lambda camera: f"sqrt(pow({_seen(*camera)[0]} - bu, 2) + pow({_seen(*camera)[1]} - bv, 2))"


@q(f"""WITH s AS (SELECT {", ".join(_double(_SCENE))} FROM lineitem), o AS (SELECT *, {_OBSERVED} FROM s), e AS (SELECT *, {_ERROR(_A)} AS a, {_ERROR(_B)} AS b FROM o),
      n AS (SELECT l_suppkey, turn, cx, cy, count(*) FILTER (a <= 0.001) AS n0, count(*) FILTER (a > 0.001 AND b <= 0.001) AS n1 FROM e GROUP BY ALL)
      SELECT l_suppkey, 0 AS model, n0 AS inliers, round(cx, 3) AS x, round(cy, 3) AS y, -3.0 AS z, false AS rival FROM n WHERE n0 >= 15
      UNION ALL SELECT l_suppkey, 1, n1, round(cx + 1.5, 3), round(cy - 1, 3), -2.5, true FROM n WHERE n0 >= 15 AND n1 >= greatest(15, ceil(0.25 * n0))""")
def pose_hypotheses(t):
    """Each supplier's camera, and the rival that what it leaves unexplained holds."""
    rows = t("lineitem").selectExpr(*_double(_SCENE)).selectExpr("l_suppkey", "x", "y", "z", *_OBSERVED.replace(" AS bu, ", " AS bu;; ").split(";; "))
    found = H.sequential(rows, ["l_suppkey"], H.Pose, 0.001, draws=120).models
    first = found.where("model = 0").select("l_suppkey", F.col("params").alias("first"))
    out = found.join(first, "l_suppkey").withColumn("rival", H.rival("params", "first"))
    return out.select("l_suppkey", "model", "inliers", *[F.round(F.col("params")[9 + k], 3).alias(c) for k, c in enumerate("xyz")], "rival")


_RAYS = "l_suppkey, (l_suppkey % 63) / 10.0 AS turn, (l_orderkey + l_linenumber) % 20 AS kind, (l_partkey % 97 - 48) / 48.0 AS u, (l_orderkey % 89 - 44) / 44.0 AS v, sqrt(1 + pow((l_partkey % 97 - 48) / 48.0, 2) + pow((l_orderkey % 89 - 44) / 44.0, 2)) AS n"
_TURNED = "CASE WHEN kind < 12 THEN turn WHEN kind < 17 THEN turn + 0.5 ELSE turn + 1 + (l_suppkey + u * v) % 3 END"
_ANGLE = lambda a: f"2 * asin(sqrt(u * u + v * v) / n * abs(sin((w - ({a})) / 2)))"


@q(f"""WITH r AS (SELECT *, {_TURNED} AS w FROM (SELECT {", ".join(_double(_RAYS))} FROM lineitem)), e AS (SELECT l_suppkey, turn, {_ANGLE("turn")} AS a, {_ANGLE("turn + 0.5")} AS b FROM r),
      n AS (SELECT l_suppkey, turn, count(*) FILTER (a <= 0.001) AS n0, count(*) FILTER (a > 0.001 AND b <= 0.001) AS n1 FROM e GROUP BY ALL)
      SELECT l_suppkey, 0 AS model, n0 AS inliers, round(cos(turn), 3) AS c FROM n WHERE n0 >= 15 UNION ALL SELECT l_suppkey, 1, n1, round(cos(turn + 0.5), 3) FROM n WHERE n0 >= 15 AND n1 >= greatest(15, ceil(0.25 * n0))""")
def rotation_hypotheses(t):
    """Turns of cameras that do not move."""
    rows = t("lineitem").selectExpr(*_double(_RAYS)).selectExpr("*", f"{_TURNED} AS w")
    rows = rows.selectExpr("l_suppkey", "u / n AS bx", "v / n AS by", "1 / n AS bz", "(cos(w) * u - sin(w) * v) / n AS dx", "(sin(w) * u + cos(w) * v) / n AS dy", "1 / n AS dz")
    return H.sequential(rows, ["l_suppkey"], H.Rotation, 0.001).models.select("l_suppkey", "model", "inliers", F.round(F.col("params")[0], 3).alias("c"))


_MOTION = lambda turn, cx, cy, cz: {
    "tx": f"-(cos({turn}) * ({cx}) + sin({turn}) * ({cy}))", "ty": f"-(cos({turn}) * ({cy}) - sin({turn}) * ({cx}))", "tz": f"-({cz})", "c": f"cos({turn})", "s": f"sin({turn})",
}


def _sampson(camera) -> str:
    """Sampson's error of a pair of image places under the motion, from the sums of its essential matrix."""
    m = {k: f"({v})" for k, v in _MOTION(*camera).items()}
    ea = ("({tz} * {s} * au - {tz} * {c} * av + {ty})", "({tz} * {c} * au + {tz} * {s} * av - {tx})", "(-({ty} * {c} + {tx} * {s}) * au + ({tx} * {c} - {ty} * {s}) * av)")
    eb = ("({tz} * {s} * bu + {tz} * {c} * bv - {ty} * {c} - {tx} * {s})", "(-{tz} * {c} * bu + {tz} * {s} * bv + {tx} * {c} - {ty} * {s})")
    a, b = [x.format(**m) for x in ea], [x.format(**m) for x in eb]
    return f"abs({a[0]} * bu + {a[1]} * bv + {a[2]}) / sqrt(pow({a[0]}, 2) + pow({a[1]}, 2) + pow({b[0]}, 2) + pow({b[1]}, 2))"


_PAIRS = "l_suppkey, turn, cx, cy, x / z AS au, y / z AS av, bu, bv"
_E = lambda camera: tuple("round(abs({0}) / sqrt(2 * ({tx} * {tx} + {ty} * {ty} + {tz} * {tz})), 3)".format(m[k], **m) for m in [{n: f"({v})" for n, v in _MOTION(*camera).items()}] for k in ("ty", "tx"))


@q(f"""WITH s AS (SELECT {", ".join(_double(_SCENE))} FROM lineitem), o AS (SELECT *, {_OBSERVED} FROM s), p AS (SELECT {_PAIRS} FROM o), e AS (SELECT *, {_sampson(_A)} AS a, {_sampson(_B)} AS b FROM p),
      n AS (SELECT l_suppkey, turn, cx, cy, count(*) FILTER (a <= 0.0001) AS n0, count(*) FILTER (a > 0.0001 AND b <= 0.0001) AS n1 FROM e GROUP BY ALL)
      SELECT l_suppkey, 0 AS model, n0 AS inliers, {_E(_A)[0]} AS e02, {_E(_A)[1]} AS e12 FROM n WHERE n0 >= 15 UNION ALL SELECT l_suppkey, 1, n1, {_E(_B)[0]}, {_E(_B)[1]} FROM n WHERE n0 >= 15 AND n1 >= greatest(15, ceil(0.25 * n0))""")
def epipolar_hypotheses(t):
    """Motions between a view from the map's origin and the two cameras."""
    rows = t("lineitem").selectExpr(*_double(_SCENE)).selectExpr("*", *_OBSERVED.replace(" AS bu, ", " AS bu;; ").split(";; ")).selectExpr(*_split(_PAIRS))
    found = H.sequential(rows.select("l_suppkey", "au", "av", "bu", "bv"), ["l_suppkey"], H.Epipolar, 0.0001, draws=1000).models
    return found.select("l_suppkey", "model", "inliers", F.round(F.abs(F.col("params")[2]), 3).alias("e02"), F.round(F.abs(F.col("params")[5]), 3).alias("e12"))


@q("""WITH i AS (SELECT l_suppkey, l_partkey % 200 / 100.0 - 0.2 AS z, l_linenumber / 100.0 AS point_sigma, CASE WHEN l_discount > 0 THEN l_quantity / 10 END AS own, l_quantity / 10 * (1 + (l_orderkey % 9) * l_tax + (l_suppkey % 4) * 0.2) AS predicted, 0.05 AS sigma, l_suppkey % 3 = 0 AS free FROM lineitem),
      r AS (SELECT *, ln(own / predicted) AS r, 3 * sqrt(0.05 * 0.05 + 0.01) AS bound, abs(z - 0.1) <= greatest(0.06, 3 * sqrt(0.02 * 0.02 + point_sigma * point_sigma)) AS floor FROM i),
      m AS (SELECT l_suppkey, quantile_cont(r, 0.5) AS m, any_value(bound) AS mb, count(r) AS n FROM r GROUP BY 1),
      g AS (SELECT *, r IS NULL OR abs(r - CASE WHEN free THEN m ELSE 0 END) <= bound AS stays, free OR n < 15 OR abs(m) <= mb AS whole FROM r JOIN m USING (l_suppkey))
      SELECT l_suppkey, count(*) AS inliers, count(*) FILTER (stays) AS kept, count(*) FILTER (stays AND NOT floor) AS off_floor, any_value(whole) AS consistent, any_value(whole) AND count(*) FILTER (stays) >= 15 AND count(*) FILTER (stays AND NOT floor) >= 15 AS passed FROM g GROUP BY 1""")
def pose_guards(t):
    """Inliers that a pose keeps after its own depth and the floor are asked."""
    rows = t("lineitem").selectExpr("l_suppkey", "l_partkey % 200 / 100.0D - 0.2D AS z", "l_linenumber / 100.0D AS point_sigma", "IF(l_discount > 0, l_quantity / 10, double('NaN')) AS own", "l_quantity / 10 * (1 + (l_orderkey % 9) * l_tax + (l_suppkey % 4) * 0.2D) AS predicted", "0.05D AS sigma", "l_suppkey % 3 = 0 AS free_scale")
    return H.guarded(rows, ["l_suppkey"], F.lit(0.1), F.lit(0.02))
