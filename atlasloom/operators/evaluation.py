"""Quality gate, targets and regressions over metric tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def failed_checks(checks: dict[str, tuple[Column, float]]) -> Column:
    """Names of the checks whose value is strictly over its limit, in order; a null value passes."""
    named = F.array(*[F.when(F.coalesce(value > limit, F.lit(False)), F.lit(name)) for name, (value, limit) in checks.items()])
    return F.array_compact(named)


def gate(rows: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    out = rows.withColumn("failed_checks", failed_checks(checks))
    return out.withColumn("accepted", F.size("failed_checks") == 0)


def holds(value: Column, op: Column, target: Column, lo: Column, hi: Column) -> Column:
    return F.when(op == ">=", value >= target).when(op == "<=", value <= target).when(op == ">", value > target).when(op == "<", value < target).when(op == "between", value.between(lo, hi))


def judge(results: DataFrame, targets: DataFrame) -> DataFrame:
    """Status per metric part: info, no_target, no_samples, pass or fail. `targets`: metric_id, op, target, lo, hi, info."""
    j = results.join(targets, "metric_id", "left")
    ok = holds(F.col("value"), F.col("op"), F.col("target"), F.col("lo"), F.col("hi"))
    return j.withColumn("status", F.when(F.col("info"), "info").when(F.col("op").isNull(), "no_target").when(F.col("value").isNull(), "no_samples").when(ok, "pass").otherwise("fail")).select(*results.columns, "status")


def judge_whole(parts: DataFrame, metric: str = "metric_id") -> DataFrame:
    """A metric passes if all its parts do."""
    return parts.groupBy(metric).agg(F.min(F.when(F.col("status") == "fail", 0).otherwise(1)).alias("_ok"), F.max(F.col("status").isin("pass", "fail")).alias("_any")).select(metric, F.when(~F.col("_any"), "no_samples").when(F.col("_ok") == 1, "pass").otherwise("fail").alias("status"))


def regressions(now: DataFrame, before: DataFrame, lower_is_better: Column, absolute: float, relative: float) -> DataFrame:
    """Metrics that are worse than before by more than the tolerance; one that can't be compared is none."""
    j = now.select("metric_id", F.col("value").alias("now")).join(before.select("metric_id", F.col("value").alias("before")), "metric_id")
    worse = F.when(lower_is_better, F.col("now") - F.col("before")).otherwise(F.col("before") - F.col("now"))
    return j.withColumn("regressed", F.coalesce(worse > F.greatest(F.lit(absolute), relative * F.abs("before")), F.lit(False)))


def capable(metrics: DataFrame, capabilities: list[str]) -> DataFrame:
    """Metrics all of whose needs are met; a need is a list of alternatives."""
    have = F.array(*[F.lit(c) for c in capabilities])
    return metrics.where(F.forall("needs", lambda any_of: F.arrays_overlap(any_of, have)))


def hold_out(rows: DataFrame, index: str, every: int, offset: int = 0) -> DataFrame:
    return rows.withColumn("held_out", F.pmod(F.col(index), F.lit(every)) == offset)


def pooled(samples: DataFrame, metric: str, run: str, value: str) -> DataFrame:
    """Mean and count by run and over all runs, from one pass with grouping sets."""
    return samples.rollup(metric, run).agg(F.avg(value).alias("mean"), F.count(value).alias("n"), F.grouping_id().alias("level")).where(F.col(metric).isNotNull())
