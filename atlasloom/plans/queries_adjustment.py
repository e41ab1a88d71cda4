"""Global scale adjustment as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlasloom.operators import adjustment as A
from atlasloom.plans.base import Registry

q = Registry()
QUERIES, ORACLE_SQL = q.queries, q.sql


@q("""WITH p AS (SELECT l_suppkey AS src, l_suppkey + 1 + l_linenumber % 2 AS dst, (l_discount - 0.05) * 9 AS ratio, ln(1 + l_quantity) AS ls, ln(1 + l_quantity + l_tax * 10) AS lt FROM lineitem),
      g AS (SELECT *, count(*) OVER w AS n FROM p WHERE abs(ratio) <= 0.4 WINDOW w AS (PARTITION BY src, dst)),
      r AS (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY ls, ratio, lt) - 1 AS r, greatest(1, least(n // 60, 6)) AS k FROM g WHERE n >= 100),
      b AS (SELECT *, CASE WHEN r < (n % k) * (n // k + 1) THEN r // (n // k + 1) ELSE n % k + (r - (n % k) * (n // k + 1)) // (n // k) END AS bin FROM r)
      SELECT src, dst, CAST(bin AS BIGINT) AS bin, round(median(ratio), 6) AS ratio, round(median(ls), 6) AS log_src, round(median(lt), 6) AS log_dst, round(count(*) * least(1, any_value(n) / 2000) / any_value(n), 8) AS weight FROM b GROUP BY ALL HAVING count(*) >= 30""")
def scale_pair_bins(t):
    """Median depth ratios of each pair of frames, in bins of equal count by depth."""
    rows = t("lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_suppkey") + 1 + F.col("l_linenumber") % 2).alias("dst"), ((F.col("l_discount") - 0.05) * 9).alias("ratio"), F.log(1 + F.col("l_quantity")).alias("log_src"), F.log(1 + F.col("l_quantity") + F.col("l_tax") * 10).alias("log_dst"))
    places = {c: F.round(c, 6).alias(c) for c in ("ratio", "log_src", "log_dst")}
    return A.pair_bins(rows, least_pair=100).select("src", "dst", "bin", *places.values(), F.round("weight", 8).alias("weight"))


def _planted(t, noise):
    """Every row ties two frames whose corrections are known, but for the noise."""
    k = F.col("s_suppkey")
    frames = t("supplier").select(k.alias("frame"), (k % 3 * 0.1).alias("pivot"), (k == 0).alias("fixed"), (k % 10 == 5).alias("held"), F.when(k % 5 == 0, 0.0).otherwise(F.sin(k) * 0.2).alias("a"), F.when(k == 0, 0.0).otherwise(F.cos(k) * 0.1).alias("b"))
    rows = t("lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_orderkey"), ((F.col("l_quantity") % 7 - 3) / 5).alias("log_src"), ((F.col("l_linenumber") % 5 - 2) / 5.0).alias("log_dst"), (1 + F.col("l_tax") * 10).alias("weight"), noise.alias("noise"))
    span = t("supplier").agg(F.max("s_suppkey").alias("last"))
    rows = rows.crossJoin(span).withColumn("dst", F.col("l_orderkey") * 31 % (F.col("last") + 1))
    end = lambda name: frames.select(F.col("frame").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("pivot", "a", "b")])
    shift = lambda name: F.col(f"{name}_a") + F.col(f"{name}_b") * (F.col(f"log_{name}") - F.col(f"{name}_pivot"))
    bins = rows.join(end("src"), "src").join(end("dst"), "dst").withColumn("ratio", shift("dst") - shift("src") + F.col("noise"))
    return bins.select("src", "dst", "ratio", "log_src", "log_dst", "weight"), frames.drop("a", "b")


@q("SELECT s_suppkey AS frame, round(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE sin(s_suppkey) * 0.2 END, 5) + 0 AS a, round(CASE WHEN s_suppkey = 0 THEN 0 ELSE cos(s_suppkey) * 0.1 END, 5) + 0 AS b FROM supplier")
def scale_adjustment(t):
    """Scales and slopes of all frames from all their pairs, where one solution fits every row."""
    bins, frames = _planted(t, F.lit(0.0))
    out = A.adjusted(bins, frames, losses=(float("inf"),), ridge=0.0, prior=0.0)
    return out.select("frame", *[(F.round(c, 5) + 0.0).alias(c) for c in "ab"])


@q()
def scale_adjustment_robust(t):
    """The same with a twentieth of all rows far off, under the priors and one reweighting by Cauchy's loss."""
    bins, frames = _planted(t, F.when(F.col("l_partkey") % 20 == 0, 2.0).otherwise((F.col("l_partkey") % 7 - 3) * 0.002))
    return A.adjusted(bins, frames, iterations=1).select("frame", *[F.round(c, 4).alias(c) for c in "ab"])
