"""Depth contradictions as queries: `lineitem` counts points, in rooms of three stored and five new frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import contradictions as C
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql

#: Frames of a room, and how many of them are stored.
_SIZE, _STORED = 8, 3


def _counts(t):
    """Points of each pair of a room's frames, with planted faults: a stored frame that is wrong, a new one that is, two new ones."""
    i, j, kind = F.col("i"), F.col("j"), F.col("l_suppkey") % 5
    rows = t("lineitem").select("l_suppkey", "l_quantity", "l_discount", (F.col("l_partkey") % _SIZE).alias("p"), (F.col("l_orderkey") % _SIZE).alias("r")).where("p <> r")
    rows = rows.select("*", F.least("p", "r").alias("i"), F.greatest("p", "r").alias("j"), (F.col("p") < F.col("r")).alias("ahead"))
    faulty = ((kind == 0) & (i == 0) & (j >= _STORED)) | ((kind == 1) & (i == 1) & (j == 4)) | ((kind == 2) & (i == 5) & (j == 6))
    agrees = F.when(faulty, F.col("l_quantity") > 45).otherwise(F.col("l_quantity") > 1)
    points = lambda ahead, yes: F.sum(F.when((F.col("ahead") == ahead) & (agrees == yes), 20).otherwise(0)).cast("long")
    return rows.groupBy(F.col("l_suppkey").alias("room"), "i", "j").agg(points(True, True).alias("agree_ab"), points(True, False).alias("through_ab"), points(False, True).alias("agree_ba"), points(False, False).alias("through_ba"))


@q("""WITH r AS (SELECT l_suppkey AS room, least(l_partkey % 8, l_orderkey % 8) AS i, greatest(l_partkey % 8, l_orderkey % 8) AS j, l_partkey % 8 < l_orderkey % 8 AS ahead, l_suppkey % 5 AS kind, l_quantity AS q FROM lineitem WHERE l_partkey % 8 <> l_orderkey % 8),
      g AS (SELECT room, i, j, ahead, q > CASE WHEN (kind = 0 AND i = 0 AND j >= 3) OR (kind = 1 AND i = 1 AND j = 4) OR (kind = 2 AND i = 5 AND j = 6) THEN 45 ELSE 1 END AS yes FROM r),
      c AS (SELECT room, i, j, 20 * count(*) FILTER (ahead AND yes) AS ag, 20 * count(*) FILTER (ahead AND NOT yes) AS th, 20 * count(*) FILTER (NOT ahead AND yes) AS ga, 20 * count(*) FILTER (NOT ahead AND NOT yes) AS ht FROM g GROUP BY ALL),
      v AS (SELECT *, (ag + th >= 40 AND ag < 0.9 * (ag + th) AND (ag < 0.75 * (ag + th) OR th >= 400)) OR (ga + ht >= 40 AND ga < 0.9 * (ga + ht) AND (ga < 0.75 * (ga + ht) OR ht >= 400)) AS fails FROM c)
      SELECT room, i, j, fails, NOT fails AND (ag + th >= 40 OR ga + ht >= 40) AS agrees, CASE WHEN ag + th >= 40 THEN round(ag / (ag + th), 6) END AS ratio_ab, CASE WHEN ga + ht >= 40 THEN round(ga / (ga + ht), 6) END AS ratio_ba FROM v""")
def depth_pair_verdicts(t):
    """Which pairs of frames contradict each other's depth, and which agree."""
    return C.judged(_counts(t)).select("room", "i", "j", "fails", "agrees", F.round("ratio_ab", 6).alias("ratio_ab"), F.round("ratio_ba", 6).alias("ratio_ba"))


@q()
def depth_contradictions(t):
    """Stored frames that are marked suspect and new ones that are rejected, round by round, in one update of all rooms."""
    name = lambda room, slot: F.concat_ws("-", F.format_string("%06d", room), slot.cast("string"))
    pairs = _counts(t).where(f"j >= {_STORED}").select(name(F.col("room").cast("long"), F.col("i")).alias("a"), name(F.col("room").cast("long"), F.col("j")).alias("b"), "agree_ab", "through_ab", "agree_ba", "through_ba")
    rooms = t("lineitem").select(F.col("l_suppkey").cast("long").alias("room")).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(_SIZE - 1))))
    room, slot = F.col("room"), F.col("slot")
    refs = F.when(slot == 7, F.array(name(room, F.lit(5)), name(room, F.lit(6)))).otherwise(F.array(name(room, F.lit(1))))
    frames = rooms.select(name(room, slot).alias("name"), (slot >= _STORED).alias("new"), (slot < _STORED).alias("fixed"), F.when(slot >= _STORED, refs).alias("refs"))
    return C.resolved(pairs, frames)
