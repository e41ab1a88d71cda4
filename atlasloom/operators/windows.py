"""Ordered analytics: runs, sessions, steps, interpolation, retention."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col


def islands(rows: DataFrame, by: list[str], index: str) -> DataFrame:
    """Maximal runs of consecutive integers: (by..., run_start, run_end, n)."""
    w = Window.partitionBy(*by).orderBy(index)
    keyed = rows.select(*by, index).distinct().withColumn("_g", F.col(index) - F.row_number().over(w))
    return keyed.groupBy(*by, "_g").agg(F.min(index).alias("run_start"), F.max(index).alias("run_end"), F.count(F.lit(1)).alias("n")).drop("_g")


def ranked(rows: DataFrame, order: list[str], rank: str = "rank") -> DataFrame:
    """Places from 1 in an order over all rows, without one window over them: rows are dealt by range, numbered in their part, and follow all parts before."""
    dealt = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()).checkpoint()
    sizes = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return dealt.withColumn(rank, own).join(before, "_p").withColumn(rank, (F.col(rank) + F.col("_b")).cast("long")).drop("_p", "_b")


def sessions(rows: DataFrame, by: list[str], order: list[str], breaks: Column) -> DataFrame:
    """Rows with a `session` number that grows where `breaks` is true; inside it, `lag` columns may be used."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_new", F.coalesce(breaks, F.lit(False)).cast("long")).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def gap_sessions(rows: DataFrame, by: list[str], time: str, tie: str, seconds: float) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(time, tie)
    gap = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    return sessions(rows.withColumn("_gap", gap), by, [time, tie], F.col("_gap") > seconds * 1e6).drop("_gap")


def steps(rows: DataFrame, by: list[str], order: list[str], axes: list[str]) -> DataFrame:
    """Distance of each row from the one before it; null for the first."""
    w = Window.partitionBy(*by).orderBy(*order)
    square = sum((F.pow(F.col(a) - F.lag(a).over(w), F.lit(2.0)) for a in axes), F.lit(0.0))
    return rows.withColumn("step", F.sqrt(square))


def sliding_count(rows: DataFrame, by: list[str], key: str, reach: int) -> DataFrame:
    """Rows of the group whose key lies at most `reach` away."""
    w = Window.partitionBy(*by).orderBy(key).rangeBetween(-reach, reach)
    return rows.withColumn("near", F.count(F.lit(1)).over(w))


def interpolated(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Nulls filled linearly between the known neighbours, held flat at the ends."""
    back = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("t"), F.col(value).cast("double").alias("v")))
    a, b = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
    j = rows.withColumns({"_a": a, "_b": b})
    t = (F.col(order).cast("double") - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0.0))
    return j.withColumn("filled", F.coalesce(F.col("_a.v") + t * (F.col("_b.v") - F.col("_a.v")), F.col("_a.v"), F.col("_b.v"))).drop("_a", "_b")


def spread_sample(rows: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows per group, evenly spaced by rank, first and last included."""
    w = Window.partitionBy(*by).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    j = rows.withColumns({"_r": F.row_number().over(w) - 1, "_n": n})
    if most < 2:
        return j.where(F.col("_r") < most).drop("_r", "_n")
    step = (F.col("_n") - 1) / F.lit(most - 1)
    # The slot whose place rounds down to this rank is the next at or after it; one either side allows for rounding.
    slots = [F.ceil(F.col("_r") / step) + k for k in (-1, 0, 1)]
    hit = functools.reduce(Column.__or__, [(F.floor(s * step) == F.col("_r")) & (s >= 0) & (s < most) for s in slots])
    return j.where((F.col("_n") <= most) | hit).drop("_r", "_n")


def retained(rows: DataFrame, by: list[str], order: list, newest: int, held: Column | None = None) -> DataFrame:
    """The newest rows of each group, and those that are held."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where((F.col("_r") <= newest) | (col(held) if held is not None else F.lit(False))).drop("_r")


def ranked_support(rows: DataFrame, by: list[str], support: str, share: float = 0.25) -> DataFrame:
    """Hypotheses with at least a share of the best one's support."""
    best = Window.partitionBy(*by)
    return rows.withColumn("_best", F.max(support).over(best)).where(F.col(support) >= share * F.col("_best")).drop("_best")


def changes(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Each row against the one before it in its group: `previous` and `changed`."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("previous", F.lag(value).over(w)).withColumn("changed", ~F.col(value).eqNullSafe(F.col("previous")) & F.lag(F.lit(1)).over(w).isNotNull())


def sweep_span(rows: DataFrame, by: list[str], order: list[str], degrees: str) -> DataFrame:
    """Span of an unwrapped heading: steps are wrapped into half a turn and added up."""
    from atlasloom.functions.geometry import wrap_degrees

    w = Window.partitionBy(*by).orderBy(*order)
    j = rows.withColumn("_d", F.coalesce(wrap_degrees(F.col(degrees) - F.lag(degrees).over(w)), F.lit(0.0)))
    j = j.withColumn("_u", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return j.groupBy(*by).agg((F.max("_u") - F.min("_u")).alias("span"))
