"""Rules that decide on poses, scales and evidence; row-wise, or over aggregated counts."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col, half_even
from atlasloom.operators.aggregates import MAD_SIGMA, mad
from atlasloom.operators.graph import spanning_forest

#: Standard deviations of a conflict.
K_SIGMA = 3.0
#: Checks of one frame, first failing first (fixed values).
TOO_CLOSE_M, PLAIN, BLUR, FEW_FEATURES = 0.30, 0.01, 0.035, 15


def conflict(dp, dr, sigmas_p: list, sigmas_r: list) -> Column:
    """Differences beyond three joint sigmas in position or rotation."""
    joint = lambda s: F.sqrt(sum((col(x) * col(x) for x in s), F.lit(0.0)))
    return (col(dp) > K_SIGMA * joint(sigmas_p)) | (col(dr) > K_SIGMA * joint(sigmas_r))


def moved(dp, dr, metres: float = 0.005, degrees: float = 0.1) -> Column:
    return (col(dp) > metres) | (col(dr) > degrees)


def frame_check(depth, texture, sharpness, features, inliers=None) -> Column:
    """Name of the first failing check, null if all pass; enough inliers excuse closeness."""
    near = col(depth) < TOO_CLOSE_M
    if inliers is not None:
        near = near & (F.coalesce(col(inliers), F.lit(0)) < 300)
    return F.when(near, "too_close").when(col(texture) < PLAIN, "plain").when(col(sharpness) < BLUR, "blur").when(col(features) < FEW_FEATURES, "few_features")


def status(failed: Column, has_prior: Column, conflicts: Column, measurable: Column, confirmed: Column) -> Column:
    """(status, reason) of a frame: an unreadable check keeps or rejects it, then conflicts, then what is unconfirmed."""
    make = lambda s, r: F.struct(F.lit(s).alias("status"), (r if isinstance(r, Column) else F.lit(r).cast("string")).alias("reason"))
    return (
        F.when(failed == "unusable_image", make("rejected", "unusable_image"))
        .when(failed.isNotNull() & has_prior, make("kept_at_prior", failed))
        .when(failed.isNotNull(), make("rejected", failed))
        .when(conflicts & measurable, make("rejected", "prior_conflict"))
        .when(conflicts, make("kept_at_prior", "conflict_unsupported"))
        .when(~confirmed & has_prior, make("kept_at_prior", "no_overlap"))
        .when(~confirmed, make("rejected", "no_overlap"))
        .otherwise(make("registered", None))
    )


def roles(status_: Column, reason: Column, metric: Column) -> Column:
    """What a frame may be used for; kept frames give nothing, but for close ones under a metric prior."""
    registered = status_ == "registered"
    close = (status_ == "kept_at_prior") & (reason == "too_close") & metric
    return F.struct(registered.alias("reference"), (registered | close).alias("content"), (registered | close).alias("detects"), registered.alias("scale_evidence"))


def depth_counts(pairs: DataFrame, by: list[str], z: str, d: str, tolerance: float = 0.10, margin: float = 0.02) -> DataFrame:
    """Samples that agree with a depth, see through it, or lie behind it, per pair of frames."""
    band = tolerance * F.col(d) + margin
    valid = F.col(d) > 0
    return pairs.groupBy(*by).agg(F.count(F.when(valid & (F.abs(F.col(z) - F.col(d)) <= band), 1)).alias("agree"), F.count(F.when(valid & (F.col(z) < F.col(d) - band), 1)).alias("through"), F.count(F.when(valid & (F.col(z) > F.col(d) + band), 1)).alias("occluded"), F.count(F.when(~F.coalesce(valid, F.lit(False)), 1)).alias("outside"))


def depth_verdict(agree: Column, through: Column) -> Column:
    """confirmed, failed or untested; by the counts' fixed limits."""
    n = agree + through
    return F.when((agree >= 40) & (agree >= 0.90 * n), "confirmed").when((n >= 40) & (agree < 0.90 * n) & ((agree < 0.75 * n) | (through >= 100)), "failed").otherwise("untested")


def prior_scale(baselines: DataFrame, by: list[str], prior: str, image: str) -> DataFrame:
    """Scale of the priors against image baselines, clipped to 0.2 to 5, with sigma and the target: 1 unless the scale is clearly off."""
    logs = baselines.where((F.col(prior) > 0) & (F.col(image) > 0)).withColumn("_l", F.log(F.col(image) / F.col(prior)))
    m = mad(logs, by, "_l").select(*by, "median", F.greatest(F.col("mad") * MAD_SIGMA, F.lit(0.02)).alias("_g"))
    kept = logs.join(m, by).where(F.abs(F.col("_l") - F.col("median")) <= K_SIGMA * F.col("_g"))
    s = kept.groupBy(*by).agg((F.sum(F.col(prior) * F.col(image)) / F.sum(F.col(prior) * F.col(prior))).alias("_s"), F.count(F.lit(1)).alias("n"), F.first("_g").alias("_g"))
    s = s.withColumns({"scale": F.least(F.greatest("_s", F.lit(0.2)), F.lit(5.0)), "sigma": F.col("_g") / F.sqrt("n")})
    off = F.abs(F.log("scale")) > 2 * F.hypot(F.col("sigma"), F.lit(0.03))
    return s.select(*by, "scale", "sigma", "n", F.when(off, F.col("scale")).otherwise(1.0).alias("target"))


def drift_sigma(own, fit, metres, rate: float = 0.10) -> Column:
    """A prior's sigma grown with the distance from its nearest support."""
    return F.sqrt(F.pow(col(own), F.lit(2.0)) + F.pow(col(fit), F.lit(2.0)) + F.pow(rate * col(metres), F.lit(2.0)))


def rotation_check(pairs: DataFrame, by: list[str], degrees: str) -> DataFrame:
    """Inconsistent where the median difference is over 3 degrees or any is over 10."""
    return pairs.groupBy(*by).agg(F.median(degrees).alias("median_deg"), F.max(degrees).alias("max_deg"), F.count(F.lit(1)).alias("pairs")).withColumn("inconsistent", (F.col("median_deg") > 3) | (F.col("max_deg") > 10))


def choose_hypothesis(rows: DataFrame, by: list[str], inliers: str = "inliers", distance: str = "prior_distance", index: str = "hypothesis") -> DataFrame:
    """Of hypotheses with a quarter of the best support: the nearest to the prior if there is one, else the best supported; then more inliers, then the index."""
    best = Window.partitionBy(*by)
    sound = rows.withColumn("_b", F.max(inliers).over(best)).where(F.col(inliers) >= 0.25 * F.col("_b"))
    order = Window.partitionBy(*by).orderBy(F.col(distance).asc_nulls_last(), F.desc(inliers), F.asc(index))
    return sound.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_b", "_r")


def registered_rounds(frames: DataFrame, links: DataFrame) -> DataFrame:
    """(frame, round): from frames of round 0, all that share a link with a registered frame register together, until none does.

    `links` has a and b; `frames` frame and `origin`.
    """
    both = links.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(links.select("b", "a"))
    done = frames.where("origin").select("frame", F.lit(0).alias("round")).checkpoint()
    front = done
    for k in itertools.count(1):
        step = front.join(both, front["frame"] == both["src"]).select(F.col("dst").alias("frame")).distinct()
        front = step.join(done, "frame", "left_anti").withColumn("round", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        done = done.union(front).checkpoint()
    return done


def scale_source(rows: DataFrame, by: list[str]) -> DataFrame:
    """The first source that has evidence: priors with a span of 0.3 m, depth images, camera height, baselines, monocular."""
    order = F.when((F.col("source") == "priors") & (F.col("span") >= 0.3), 1).when(F.col("source") == "depth", 2).when(F.col("source") == "camera_height", 3).when(F.col("source") == "baseline", 4).when(F.col("source") == "monocular", 5)
    return rows.withColumn("_o", order).where("_o IS NOT NULL").groupBy(*by).agg(F.min_by("source", "_o").alias("source"))


def weak_cuts(pairs: DataFrame, least: int, a: str = "a", b: str = "b") -> DataFrame:
    """Places of an ordered sequence that fewer than `least` pairs cross: (cut, crossing); a cut k lies between k and k + 1."""
    over = pairs.select(F.explode(F.sequence(F.least(a, b), F.greatest(a, b) - 1)).alias("cut"))
    return over.groupBy("cut").agg(F.count(F.lit(1)).alias("crossing")).where(F.col("crossing") < least)


def duplicates(frames: DataFrame, metres: float = 0.02) -> DataFrame:
    """Frames of one camera with an earlier one at most that far away: (frame, of). Cells of the distance's edge and their neighbours meet."""
    from atlasloom.operators.joins import range_join

    a = frames.select("frame", "camera", "x", "y", "z")
    b = frames.select(F.col("frame").alias("of"), F.col("camera").alias("o_camera"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"))
    near = range_join(a, b, ["x", "y", "z"], ["ox", "oy", "oz"], metres, (("camera", "o_camera"),)).where(F.col("of") < F.col("frame"))
    return near.groupBy("frame").agg(F.min("of").alias("of"))


def forest_residuals(edges: DataFrame, weight: str) -> DataFrame:
    """Edges that the maximum spanning forest leaves out: the ones that close cycles."""
    kept = spanning_forest(edges, weight).select("a", "b")
    e = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), weight)
    return e.join(kept, ["a", "b"], "left_anti")


def eta(overhead: float, rows: DataFrame, kind: str = "kind", count: str = "n", median: str = "median") -> DataFrame:
    """Predicted seconds: overhead and each kind's count times its median."""
    return rows.agg((F.lit(overhead) + F.coalesce(F.sum(F.col(count) * F.col(median)), F.lit(0.0))).alias("eta"))


def sigma_of(covariance) -> Column:
    """Root of the trace of a 3x3 covariance."""
    c = col(covariance)
    return F.sqrt(c[0] + c[4] + c[8])


def rounded(c, digits: int) -> Column:
    return half_even(c, digits)
