"""Fits that need linear algebra. Sums are aggregated in Spark; what is solved is a handful of numbers for each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

A, B = ("ax", "ay", "az"), ("bx", "by", "bz")


def moments(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Sums over matched points that any similarity fit needs, partially aggregated; rows with a null or NaN coordinate don't count."""
    sound = pairs.dropna(subset=[*A, *B])
    return sound.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s_{c}") for c in (*A, *B)], *[F.sum(F.col(a) * F.col(b)).alias(f"s_{a}_{b}") for a in A for b in B], F.sum(sum((F.col(a) * F.col(a) for a in A), F.lit(0.0))).alias("s_aa"))


def umeyama(m: dict, scaled: bool = True) -> tuple[float, np.ndarray, np.ndarray] | None:
    """Scale, rotation and translation from the moments; None for fewer than three points or points without extent."""
    n = m["n"]
    if n < 3:
        return None
    ca, cb = (np.array([m[f"s_{c}"] for c in axes]) / n for axes in (A, B))
    h = np.array([[m[f"s_{a}_{b}"] for a in A] for b in B]) / n - np.outer(cb, ca)
    u, s, vt = np.linalg.svd(h)
    flip = np.diag([1.0, 1.0, np.sign(np.linalg.det(u) * np.linalg.det(vt)) or 1.0])
    r = u @ flip @ vt
    spread = m["s_aa"] / n - ca @ ca
    if spread <= 0:
        return None
    scale = float((s * np.diag(flip)).sum() / spread) if scaled else 1.0
    return scale, r, cb - scale * r @ ca


def similarity(pairs: DataFrame, by: list[str], scaled: bool = True) -> DataFrame:
    """Per group the least-squares similarity that takes points a to points b: scale, rotation (9, row-major), translation (3)."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema.fields}

    def solve(batches):
        for pdf in batches:
            fits = [umeyama(row, scaled) for row in pdf.to_dict("records")]
            out = pdf[list(by)].copy()
            out["n"] = pdf["n"]
            out["scale"] = [f[0] if f else None for f in fits]
            out["rotation"] = [f[1].ravel().tolist() if f else None for f in fits]
            out["translation"] = [f[2].tolist() if f else None for f in fits]
            yield out

    return moments(pairs, by).mapInPandas(solve, ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n bigint, scale double, rotation array<double>, translation array<double>"]))


def upright(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Yaw and planar translation in closed form, wholly in SQL."""
    m = moments(pairs, by)
    n = F.col("n")
    cov = lambda a, b: F.col(f"s_{a}_{b}") / n - F.col(f"s_{a}") * F.col(f"s_{b}") / (n * n)
    yaw = F.atan2(cov("ax", "by") - cov("ay", "bx"), cov("ax", "bx") + cov("ay", "by"))
    mean = lambda c: F.col(f"s_{c}") / n
    return m.where("n >= 2").select(*by, "n", F.degrees(yaw).alias("yaw_deg"), (mean("bx") - F.cos(yaw) * mean("ax") + F.sin(yaw) * mean("ay")).alias("tx"), (mean("by") - F.sin(yaw) * mean("ax") - F.cos(yaw) * mean("ay")).alias("ty"), (mean("bz") - mean("az")).alias("tz"))


def plane(points: DataFrame, by: list[str]) -> DataFrame:
    """z = a x + b y + c by least squares per group, from its normal equations, wholly in SQL; null for degenerate points."""
    s = lambda e: F.sum(e)
    x, y, z = (F.col(c) for c in "xyz")
    m = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], s(x * x).alias("xx"), s(x * y).alias("xy"), s(y * y).alias("yy"), s(x * z).alias("xz"), s(y * z).alias("yz"))
    c = lambda p, q: F.col(p + q) - F.col("n") * F.col(f"m{p}") * F.col(f"m{q}")
    det = F.nullif(c("x", "x") * c("y", "y") - c("x", "y") * c("x", "y"), F.lit(0.0))
    out = m.withColumn("a", (c("x", "z") * c("y", "y") - c("y", "z") * c("x", "y")) / det).withColumn("b", (c("y", "z") * c("x", "x") - c("x", "z") * c("x", "y")) / det)
    return out.select(*by, "n", "a", "b", (F.col("mz") - F.col("a") * F.col("mx") - F.col("b") * F.col("my")).alias("c"))


def _hypotheses(rounds: int, seed: int, by: list[str]):
    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.repeat(pdf[["x", "y", "z"]].to_numpy(float), pdf["_copies"].to_numpy(np.int64), axis=0)
        p = p[np.lexsort(p.T[::-1])]
        rng = np.random.default_rng(seed)
        drawn = p[np.array([rng.choice(len(p), 3, replace=False) for _ in range(rounds if len(p) >= 3 else 0)], np.int64).reshape(-1, 3)]
        a = drawn[:, 0]
        normal = np.cross(drawn[:, 1] - a, drawn[:, 2] - a)
        size = np.linalg.norm(normal, axis=1)
        sound = np.flatnonzero(size > 1e-12)
        out = pdf[by].iloc[np.zeros(len(sound), np.int64)].reset_index(drop=True)
        return out.assign(_h=sound, **{f"_{c}": a[sound, k] for k, c in enumerate("xyz")}, **{f"n{c}": normal[sound, k] / size[sound] for k, c in enumerate("xyz")})

    return draw


def _refit(by: list[str]):
    """The plane of least squares through points, from their sums about a point of theirs, with an upward normal."""

    def fit(batches):
        for pdf in batches:
            out = pdf[by].copy()
            s = {c: pdf[c].to_numpy(float) for c in pdf.columns if c not in by}
            mean = np.stack([s[f"s{c}"] / s["n"] for c in "xyz"], -1).reshape(-1, 3)
            spread = np.stack([s["s" + min(p, q) + max(p, q)] / s["n"] for p in "xyz" for q in "xyz"], -1).reshape(-1, 3, 3) - mean[:, :, None] * mean[:, None, :]
            normal = np.linalg.eigh(spread)[1][:, :, 0]
            normal = normal * np.where(normal[:, 2] < 0, -1.0, 1.0)[:, None]
            mean = mean + np.stack([s[f"_{c}"] for c in "xyz"], -1).reshape(-1, 3)
            yield out.assign(**{f"n{c}": normal[:, k] for k, c in enumerate("xyz")}, **{f"_{c}": mean[:, k] for k, c in enumerate("xyz")})

    return fit


def robust_plane(points: DataFrame, by: list[str], tolerance: float = 0.02, rounds: int = 300, most: int = 20_000, seed: int = 42) -> DataFrame:
    """Seeded RANSAC plane per group, refitted on its inliers, with an upward normal; rows with a null or NaN coordinate don't count.

    Hypotheses are drawn from about `most` points of a group: of a place's copies their share, rounded by its hash, so a
    place that holds much of a group stays. Each hypothesis meets every place once, with its number of points; the refit's
    sums and the inliers that are returned, which are those of the refitted plane, are partial aggregates over every row.
    """
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    keys = [f"`{c}` {kinds[c]}" for c in by]
    cast = points.select(*by, *[F.col(c).cast("double").alias(c) for c in "xyz"])
    sound = cast.dropna(subset=["x", "y", "z"])

    def met(rows: DataFrame, planes: DataFrame, how: str = "inner") -> DataFrame:
        other = planes.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], *[c for c in planes.columns if c not in by])
        same = F.lit(True)
        for k, c in enumerate(by):
            same = same & rows[c].eqNullSafe(other[f"_by{k}"])
        return rows.join(other, same, how).drop(*[f"_by{k}" for k in range(len(by))])

    away = lambda c: F.col(c) - F.col(f"_{c}")
    inside = F.abs(sum((away(c) * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))) <= tolerance
    sizes = sound.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    places = sound.groupBy(*by, "x", "y", "z").agg(F.count(F.lit(1)).alias("_count"))
    by_hash = F.pmod(F.xxhash64("x", "y", "z", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    copies = F.floor(F.col("_count") * F.least(F.lit(1.0), most / F.col("_n")) + by_hash).cast("long")
    drawn = met(places, sizes).select(*by, "x", "y", "z", copies.alias("_copies")).where("_copies > 0").groupBy(*by)
    spot = [f"{c} double" for c in ("_x", "_y", "_z", "nx", "ny", "nz")]
    tried = drawn.applyInPandas(_hypotheses(rounds, seed, list(by)), ", ".join([*keys, "_h int", *spot]))
    plane = ["_h", "_x", "_y", "_z", "nx", "ny", "nz"]
    counts = met(places, tried).where(inside).groupBy(*by, *plane).agg(F.sum("_count").alias("_n"))
    best = counts.groupBy(*by).agg(F.max_by(F.struct(*plane[1:]), F.struct("_n", -F.col("_h"))).alias("_p")).select(*by, "_p.*")
    sums = [F.sum(away(c)).alias(f"s{c}") for c in "xyz"] + [F.sum(away(p) * away(q)).alias(f"s{p}{q}") for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")]
    fitted = met(sound, best).where(inside).groupBy(*by, "_x", "_y", "_z").agg(F.count(F.lit(1)).alias("n"), *sums).mapInPandas(_refit(list(by)), ", ".join([*keys, *spot[3:], *spot[:3]]))
    found = met(sound, fitted).groupBy(*by, *plane[1:]).agg(F.count(F.when(inside, 1)).alias("inliers"))
    found = found.select(*by, "nx", "ny", "nz", (-sum((F.col(f"_{c}") * F.col(f"n{c}") for c in "xyz"), F.lit(0.0))).alias("d"), "inliers")
    groups = cast.select(*by).distinct()
    return met(groups, found, "left").select(*by, "nx", "ny", "nz", "d", F.coalesce("inliers", F.lit(0)).cast("long").alias("inliers"))
