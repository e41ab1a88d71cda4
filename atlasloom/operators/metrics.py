"""Evaluation metrics: one aggregate query each, over rows that hold an estimate beside its truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locate(rows: DataFrame, by: list[str], metres: float = 0.3, degrees: float = 15.0) -> DataFrame:
    """Recall within bounds, median error, containment in three sigmas, tightness, share of ambiguous answers. A frame without an answer has null error."""
    found = F.col("error_m").isNotNull()
    good = found & (F.col("error_m") <= metres) & (F.col("error_deg") <= degrees)
    return rows.groupBy(*by).agg(
        F.avg(good.cast("double")).alias("recall"),
        F.median("error_m").alias("error_median"),
        F.avg(F.when(found, (F.col("error_m") <= 3 * F.col("sigma_m")).cast("double"))).alias("containment"),
        F.median(F.when(found, F.col("sigma_m") / F.greatest(F.col("error_m"), F.lit(1e-3)))).alias("tightness"),
        F.avg(F.col("ambiguous").cast("double")).alias("ambiguous"),
    )


def grid_agreement(grid: DataFrame, truth: DataFrame) -> DataFrame:
    """Over cells that both know: share of equal states, and shares of free and occupied truth that are right."""
    j = grid.select("row", "col", F.col("state").alias("s")).join(truth.select("row", "col", F.col("state").alias("t")), ["row", "col"]).where("s > 0 AND t > 0")
    right = (F.col("s") == F.col("t")).cast("double")
    return j.agg(F.avg(right).alias("agreement"), F.avg(F.when(F.col("t") == 1, right)).alias("free"), F.avg(F.when(F.col("t") == 2, right)).alias("occupied"), F.count(F.lit(1)).alias("cells"))


def false_obstacles(grid: DataFrame, truth: DataFrame, seen: DataFrame) -> DataFrame:
    """Occupied cells on the truth's open floor that some view saw."""
    floor = truth.where("state = 1").select("row", "col")
    return grid.where("state = 2").join(floor, ["row", "col"], "left_semi").join(seen.select("row", "col"), ["row", "col"], "left_semi")


def objects(matches: DataFrame) -> DataFrame:
    """Centre error, label share, and stability of ids over versions: the share of consecutive sightings of a truth object that keep its id."""
    from pyspark.sql import Window

    w = Window.partitionBy("truth_id").orderBy("version")
    j = matches.withColumn("_same", (F.col("object_id") == F.lag("object_id").over(w)).cast("double"))
    return j.agg(F.median("error_m").alias("centre_median"), F.avg((F.col("label") == F.col("truth_label")).cast("double")).alias("label_share"), F.avg("_same").alias("id_stability"))


def scale(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Largest difference of the scale from 1 over direction sectors of 45 degrees (opposite directions are one), from distances of pairs in map and truth."""
    sector = F.floor(F.pmod(F.col("direction_deg"), F.lit(180.0)) / 45).cast("int")
    each = pairs.where("truth_m > 0").groupBy(*by, sector.alias("sector")).agg((F.sum("map_m") / F.sum("truth_m")).alias("s"))
    return each.groupBy(*by).agg(F.max(F.abs(F.col("s") - 1)).alias("worst"), F.count(F.lit(1)).alias("sectors"))


def gate(runs: DataFrame, slip_m: float = 0.3) -> DataFrame:
    """Of warped updates (slip from a bound on) the share that was rejected, of the others the share accepted."""
    warped = F.col("slip_m") >= slip_m
    return runs.agg(F.avg(F.when(warped, (~F.col("accepted")).cast("double"))).alias("rejected_share"), F.avg(F.when(~warped, F.col("accepted").cast("double"))).alias("accepted_share"))


def latency(samples: DataFrame, by: list[str]) -> DataFrame:
    """90th percentile and median under load, idle median, their ratio, and the share of predictions within 30 %."""
    idle = F.median(F.when(~F.col("loaded"), F.col("seconds")))
    busy = F.median(F.when(F.col("loaded"), F.col("seconds")))
    near = (F.abs(F.col("eta") - F.col("seconds")) <= 0.3 * F.col("seconds")).cast("double")
    return samples.groupBy(*by).agg(F.percentile("seconds", F.lit(0.9)).alias("p90"), idle.alias("idle"), busy.alias("busy"), (busy / idle).alias("ratio"), F.avg(near).alias("eta_share"))


def agreement_of_reasons(rows: DataFrame, reason: str, truth: str) -> DataFrame:
    """Share of rows per true reason whose stated reason is the same; no reason is one too."""
    return rows.groupBy(F.coalesce(truth, F.lit("none")).alias("reason")).agg(F.avg(F.col(reason).eqNullSafe(F.col(truth)).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))


def atomic(reads: DataFrame, version: str, digest: str) -> DataFrame:
    """Versions all of whose reads gave one answer."""
    return reads.groupBy(version).agg(F.countDistinct(digest).alias("answers"), F.count(F.lit(1)).alias("reads")).withColumn("atomic", F.col("answers") == 1)
