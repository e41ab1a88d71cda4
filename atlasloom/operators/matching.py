"""Two-view geometry over rows of matches: rays, parallax, triangulation, epipolar residuals, covisibility, constrained groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.functions.geometry import angle_between, col, dot, let

#: Pairs of frames that a task makes and counts, where no single point has more.
PAIRS_OF_TASK = 2_000_000


def cross(a, b) -> Column:
    a, b = col(a), col(b)
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def minus(a, b) -> Column:
    return F.zip_with(col(a), col(b), lambda x, y: x - y)


def midpoint(p, u, q, v) -> Column:
    """The point midway between two rays p + s u and q + t v; null for parallel ones."""
    w, uu, vv, uv = minus(p, q), dot(u, u), dot(v, v), dot(u, v)
    down = F.nullif(uu * vv - uv * uv, F.lit(0.0))
    s, t = (uv * dot(v, w) - vv * dot(u, w)) / down, (uu * dot(v, w) - uv * dot(u, w)) / down
    return F.when(down.isNotNull(), F.transform(F.arrays_zip(col(p).alias("p"), col(u).alias("u"), col(q).alias("q"), col(v).alias("v")), lambda x: (x["p"] + s * x["u"] + x["q"] + t * x["v"]) / 2))


def triangulated(pairs: DataFrame, least_degrees: float = 2.0) -> DataFrame:
    """Midpoints of matched rays (p, u, q, v) whose parallax is large enough, with it in degrees."""
    return pairs.withColumn("parallax", angle_between("u", "v")).where(F.col("parallax") >= least_degrees).withColumn("point", midpoint("p", "u", "q", "v"))


def sampson(x, y, e) -> Column:
    """Sampson residual of homogeneous matches under an essential matrix (9, row-major)."""
    x, y, e = col(x), col(y), col(e)
    ex = F.array(*[e[3 * i] * x[0] + e[3 * i + 1] * x[1] + e[3 * i + 2] * x[2] for i in range(3)])
    ety = F.array(*[e[i] * y[0] + e[3 + i] * y[1] + e[6 + i] * y[2] for i in range(3)])
    return let(ex, lambda a: let(ety, lambda b: F.pow(dot(y, a), F.lit(2.0)) / (a[0] * a[0] + a[1] * a[1] + b[0] * b[0] + b[1] * b[1])))


def parallax_test(rows: DataFrame, by: list[str], residual: str, sine: str, noise: float = 1.0, relative: float = 0.25, k: float = 2.0) -> DataFrame:
    """Median residual over the floored sine of the turn; moved where it is beyond the noise."""
    p = F.median(F.col(residual) / F.greatest(F.col(sine), F.lit(0.3)))
    return rows.groupBy(*by).agg(p.alias("parallax")).withColumn("moved", F.col("parallax") > k * F.hypot(F.lit(noise), relative * F.col("parallax")))


def covisible(tracks: DataFrame, frame: str = "frame", point: str = "point", least: int = 1) -> DataFrame:
    """Pairs of frames and how many points they share. A point seen by very many frames makes their pairs once each, as the graph needs them.

    The sightings are few bytes and many pairs to come: they are dealt out by the number of their pairs, as tasks merged by bytes
    would be too few, and each would count too many pairs. The pairs of one point are one task's.
    """
    seen = tracks.select(frame, point).where(F.col(frame).isNotNull() & F.col(point).isNotNull())
    pairs = seen.distinct().groupBy(point).count().agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).first()[0] or 0.0
    parts = max(1, math.ceil(pairs / PAIRS_OF_TASK))
    side = lambda name: seen.repartition(parts, point).select(F.col(frame).alias(name), point).distinct()
    return side("a").join(side("b"), point).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def frustum(points: DataFrame, frames: DataFrame, cell_m: float, reach: float) -> DataFrame:
    """Points inside frames' images: cells within reach first, then the projection. Frames: frame, pose (map from camera, 16), fx, fy, cx, cy, width, height."""
    from atlasloom.functions.geometry import apply, inverse, project, voxel

    span = int(reach // cell_m) + 1
    o = F.sequence(F.lit(-span), F.lit(span))
    f = frames.withColumn("_i", F.explode(o)).withColumn("_j", F.explode(o)).withColumns({"_x": voxel(F.col("pose")[3], cell_m) + F.col("_i"), "_y": voxel(F.col("pose")[7], cell_m) + F.col("_j"), "_inv": inverse("pose")})
    j = points.withColumns({"_x": voxel("x", cell_m), "_y": voxel("y", cell_m)}).join(f, ["_x", "_y"])
    j = j.withColumn("_c", apply("_inv", F.array("x", "y", "z"))).where((F.col("_c")[2] > 0.05) & (F.col("_c")[2] <= reach))
    j = j.withColumn("pixel", project("_c", "fx", "fy", "cx", "cy")).withColumn("depth", F.col("_c")[2])
    return j.where((F.col("pixel.u") >= 0) & (F.col("pixel.u") < F.col("width")) & (F.col("pixel.v") >= 0) & (F.col("pixel.v") < F.col("height"))).drop("_x", "_y", "_i", "_j", "_inv", "_c")


def _grouped(by: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}
        frames: dict = {}
        ends = {**dict(zip(pdf["a"], pdf["frame_a"], strict=True)), **dict(zip(pdf["b"], pdf["frame_b"], strict=True))}
        for n, f in ends.items():
            root[n], frames[n] = n, {f}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for e in pdf.sort_values(["strength", "a", "b"], ascending=[False, True, True]).itertuples():
            x, y = sorted((find(e.a), find(e.b)))
            if x != y and not frames[x] & frames[y]:
                root[y] = x
                frames[x] |= frames[y]
        nodes = sorted(root)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in by}, "node": nodes, "group_id": [find(n) for n in nodes]})

    return run


def constrained_groups(edges: DataFrame, by: list[str]) -> DataFrame:
    """Strongest edges first, two groups merge unless they would hold two nodes of one frame: (by..., node, group_id).

    `edges`: by..., a, b, frame_a, frame_b, strength. The order matters, so a group of `by` is solved in one task;
    connected components of the edges are a `by` that loses nothing and keeps such tasks small.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    return edges.groupBy(*by).applyInPandas(_grouped(by), ", ".join([*[f"`{c}` {kinds[c]}" for c in by], f"node {kinds['a']}, group_id {kinds['a']}"]))


def gauss_newton_pose(points: np.ndarray, pixels: np.ndarray, pose: np.ndarray, k: tuple[float, float, float, float], huber: float = 2.0, rounds: int = 15) -> np.ndarray:
    """Camera pose (camera from map, 4x4) that fits pixels, by Gauss-Newton with Huber weights from a start."""
    t = pose.copy()
    for _ in range(rounds):
        p = points @ t[:3, :3].T + t[:3, 3]
        x, y, z = p.T
        fx, fy, cx, cy = k
        r = np.stack([fx * x / z + cx, fy * y / z + cy], 1) - pixels
        one, nil = np.ones_like(z), np.zeros_like(z)
        d = np.stack([np.stack([fx / z, nil, -fx * x / z**2], 1), np.stack([nil, fy / z, -fy * y / z**2], 1)], 1)
        turn = np.stack([np.stack([nil, z, -y], 1), np.stack([-z, nil, x], 1), np.stack([y, -x, nil], 1)], 1)
        j = np.concatenate([d, d @ turn], 2)
        w = np.minimum(one, huber / np.maximum(np.linalg.norm(r, axis=1), 1e-12))
        h = np.einsum("nij,n,nik->jk", j, w, j) + 1e-9 * np.eye(6)
        step = -np.linalg.solve(h, np.einsum("nij,n,ni->j", j, w, r))
        a = np.linalg.norm(step[3:])
        s = np.array([[0, -step[5], step[4]], [step[5], 0, -step[3]], [-step[4], step[3], 0]])
        rot = np.eye(3) + s if a < 1e-12 else np.eye(3) + np.sin(a) / a * s + (1 - np.cos(a)) / a**2 * s @ s
        t[:3, :3], t[:3, 3] = rot @ t[:3, :3], rot @ t[:3, 3] + step[:3]
        if np.abs(step).max() < 1e-10:
            break
    return t


def refined_poses(matches: DataFrame, start: list[float], k: tuple[float, float, float, float], inlier_px: float = 4.0) -> DataFrame:
    """Per frame the refined pose and its inliers. `matches`: frame, x, y, z, u, v; at least six are needed, else null."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {"frame": [pdf["frame"].iloc[0]], "matches": [len(pdf)], "pose": [None], "inliers": [0]}
        if len(pdf) >= 6:
            p, uv = pdf[["x", "y", "z"]].to_numpy(float), pdf[["u", "v"]].to_numpy(float)
            t = gauss_newton_pose(p, uv, np.array(start, float).reshape(4, 4), k)
            q = p @ t[:3, :3].T + t[:3, 3]
            err = np.hypot(k[0] * q[:, 0] / q[:, 2] + k[2] - uv[:, 0], k[1] * q[:, 1] / q[:, 2] + k[3] - uv[:, 1])
            out |= {"pose": [t.ravel().tolist()], "inliers": [int(((err <= inlier_px) & (q[:, 2] > 0)).sum())]}
        return pd.DataFrame(out)

    kind = matches.schema["frame"].dataType.simpleString()
    return matches.groupBy("frame").applyInPandas(solve, f"frame {kind}, matches bigint, pose array<double>, inliers bigint")
