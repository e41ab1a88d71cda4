"""Frame placement: correspondences, poses by sequential RANSAC over every row, and the guards that a pose must pass.

Hypotheses are drawn from a bounded sample of a group's rows. They are scored, refitted and judged over all rows: a group of
up to `part_rows` rows in one task, a larger one in parts of that size that meet its hypotheses, and counts and normal
equations of parts are added. The inliers of the best model are then taken out, and the next model is looked for among what is left.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col, finite

#: Least inliers of a pose, share of the best model's that a rival needs, distance and turn that make it another (fixed values).
LEAST_INLIERS, RIVAL_SHARE, RIVAL_METRES, RIVAL_DEGREES = 15, 0.25, 0.10, 5.0
#: Sigmas and noise of the guards (fixed values).
K_SIGMA, POINT_NOISE, FLOOR_BAND = 3.0, 0.10, 0.06
NEAREST = 0.05
#: Robust sigmas of the inliers' errors up to which a row counts in a refit, and the least such bound as a share of the threshold.
REFIT_SIGMAS, REFIT_LEAST = 3.0, 1e-6
#: Errors of models in rows that are computed at once; arrays of this size stay in a core's cache.
CELLS = 1 << 15


def correspondences(matches: DataFrame, points: DataFrame, frames: DataFrame) -> DataFrame:
    """One lifted point for each keypoint of a frame, from its first candidate; an unguided match goes before a guided one.

    `matches`: frame, feature, u, v, candidate, rank (the candidate's place), guided, point. `points`: candidate, point, ru, rv,
    depth. `frames`: candidate, fx, fy, cx, cy, r (rotation, row-major), c (centre), factor (of its depth now).
    Gives frame, feature, u, v, candidate, x (null without a sound depth) and d, the ray's direction in the map.
    """
    first = matches.groupBy("frame", "feature").agg(F.min(F.struct("rank", "guided", "point", "candidate", "u", "v")).alias("m")).select("frame", "feature", "m.u", "m.v", "m.candidate", "m.point")
    j = first.join(points, ["candidate", "point"]).join(frames, "candidate")
    ray = [(F.col("ru") - F.col("cx")) / F.col("fx"), (F.col("rv") - F.col("cy")) / F.col("fy"), F.lit(1.0)]
    turned = [sum((F.col("r")[3 * i + k] * ray[k] for k in range(1, 3)), F.col("r")[3 * i] * ray[0]) for i in range(3)]
    z = F.col("depth") * F.col("factor")
    j = j.withColumns({"_d": F.array(*turned), "_z": F.when(finite("depth") & (F.col("depth") > 0), z)})
    length = F.sqrt(sum((F.col("_d")[i] * F.col("_d")[i] for i in range(3)), F.lit(0.0)))
    x = F.when(F.col("_z").isNotNull(), F.array(*[F.col("c")[i] + F.col("_d")[i] * F.col("_z") for i in range(3)]))
    return j.select("frame", "feature", "u", "v", "candidate", x.alias("x"), F.array(*[F.col("_d")[i] / length for i in range(3)]).alias("d"))


def _turn(cross: np.ndarray) -> np.ndarray:
    """Rotations nearest the given 3x3 sums of (to, from) products."""
    u, _, vt = np.linalg.svd(cross)
    flip = np.sign(np.linalg.det(u @ vt))
    u[..., :, 2] *= flip[..., None]
    return u @ vt


def _exp(w: np.ndarray) -> np.ndarray:
    a = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    return np.eye(3) + k if a < 1e-12 else np.eye(3) + np.sin(a) / a * k + (1 - np.cos(a)) / (a * a) * k @ k


class Pose:
    """Camera poses (rotation to the map, row-major, and centre) from map points x, y, z and image places bu, bv on the plane at distance 1."""

    columns, draws, size, terms = ("x", "y", "z", "bu", "bv"), 4, 12, 42

    @staticmethod
    def fit(rows: np.ndarray) -> np.ndarray:
        """From four rows each: distances of three points by the quartic of their law of cosines; the fourth chooses among the roots."""
        if not len(rows):
            return np.empty((0, 12))
        p, f = rows[..., :3], np.concatenate([rows[..., 3:], np.ones((*rows.shape[:-1], 1))], -1)
        f = f / np.linalg.norm(f, axis=-1, keepdims=True)
        a, b, c = (((p[:, i] - p[:, j]) ** 2).sum(-1) for i, j in ((1, 2), (0, 2), (0, 1)))
        sound = np.minimum(np.minimum(a, b), c) >= 1e-12
        p, f, a, b, c, fourth = p[sound], f[sound], a[sound], b[sound], c[sound], rows[sound, 3]
        ca, cb, cc = ((f[:, i] * f[:, j]).sum(-1) for i, j in ((1, 2), (0, 2), (0, 1)))
        k, s = (a - c) / b, (a + c) / b
        quartic = np.stack([
            (k - 1) ** 2 - 4 * c / b * ca**2,
            4 * (k * (1 - k) * cb - (1 - s) * ca * cc + 2 * c / b * ca**2 * cb),
            2 * (k**2 - 1 + 2 * k**2 * cb**2 + 2 * (b - c) / b * ca**2 - 4 * s * ca * cb * cc + 2 * (b - a) / b * cc**2),
            4 * (-k * (1 + k) * cb + 2 * a / b * cc**2 * cb - (1 - s) * ca * cc),
            (1 + k) ** 2 - 4 * a / b * cc**2,
        ], -1)
        fine = np.flatnonzero(np.isfinite(quartic).all(-1) & (np.abs(quartic[:, 0]) >= 1e-14))
        companion = np.zeros((len(fine), 4, 4))
        companion[:, 0] = -quartic[fine, 1:] / quartic[fine, :1]
        companion[:, [1, 2, 3], [0, 1, 2]] = 1.0
        roots = np.linalg.eigvals(companion)
        with np.errstate(all="ignore"):
            v = roots.real
            of = lambda x: x[fine][:, None]
            below, near = 2 * (of(cc) - v * of(ca)), 1 + v * v - 2 * v * of(cb)
            u = ((of(k) - 1) * v * v - 2 * of(k) * of(cb) * v + 1 + of(k)) / below
            good = (np.abs(roots.imag) < 1e-6) & (v > 0) & (np.abs(below) >= 1e-12) & (near > 0) & (u > 0)
        row, root = np.nonzero(good)
        d = fine[row]
        reach = np.sqrt(b[d] / near[row, root])[:, None] * np.stack([np.ones(len(row)), u[row, root], v[row, root]], -1)
        cam = f[d, :3] * reach[..., None]
        middle, seen = p[d, :3].mean(1), cam.mean(1)
        turn = _turn(np.swapaxes(p[d, :3] - middle[:, None], 1, 2) @ (cam - seen[:, None]))
        models = np.concatenate([turn.reshape(-1, 9), middle - (turn @ seen[..., None])[..., 0]], -1)
        at = ((fourth[d, :3] - models[:, 9:])[:, None] @ turn)[:, 0]
        z = np.where(at[:, 2] > NEAREST, at[:, 2], np.nan)
        off = np.hypot(at[:, 0] / z - fourth[d, 3], at[:, 1] / z - fourth[d, 4])
        off = np.where(np.isnan(off), np.inf, off)
        # Of a draw's roots the first of least error; none in front of the camera, no model.
        order = np.lexsort((np.arange(len(d)), off, d))
        first = np.append(True, d[order][1:] != d[order][:-1])[: len(d)] if len(d) else np.zeros(0, bool)
        return models[[i for i in order[first] if np.isfinite(off[i])]]

    @staticmethod
    def _seen(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (rows[:, :3] - model[9:]) @ model[:9].reshape(3, 3)

    @staticmethod
    def errors(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(models), len(rows)))
        for k, m in enumerate(models):
            p = Pose._seen(m, rows)
            z = np.where(p[:, 2] > NEAREST, p[:, 2], np.nan)
            out[k] = np.hypot(p[:, 0] / z - rows[:, 3], p[:, 1] / z - rows[:, 4])
        return np.where(np.isnan(out), np.inf, out)

    @staticmethod
    def sums(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Normal equations of a small turn and step of the camera."""
        p = Pose._seen(model, rows)
        x, y, z = p.T
        o = np.zeros_like(z)
        project = np.stack([np.stack([1 / z, o, -x / z**2], -1), np.stack([o, 1 / z, -y / z**2], -1)], -2)
        across = np.stack([np.stack([o, -z, y], -1), np.stack([z, o, -x], -1), np.stack([-y, x, o], -1)], -2)
        j = np.concatenate([project @ across, -project], -1).reshape(-1, 6)
        r = np.stack([x / z - rows[:, 3], y / z - rows[:, 4]], -1).ravel()
        return np.concatenate([(j.T @ j).ravel(), j.T @ r])

    @staticmethod
    def update(model: np.ndarray, sums: np.ndarray) -> np.ndarray:
        step = -np.linalg.lstsq(sums[:36].reshape(6, 6), sums[36:], rcond=None)[0]
        turn = model[:9].reshape(3, 3)
        return np.concatenate([(turn @ _exp(step[:3])).ravel(), model[9:] + turn @ step[3:]])


class Rotation:
    """Rotations to the map (row-major) from unit rays: dx, dy, dz in the map, bx, by, bz in the camera. Errors are angles."""

    columns, draws, size, terms = ("dx", "dy", "dz", "bx", "by", "bz"), 2, 9, 9

    @staticmethod
    def fit(rows: np.ndarray) -> np.ndarray:
        """From two rays each; rays within a degree of each other fix no turn."""
        apart = np.sum(rows[:, 0, 3:] * rows[:, 1, 3:], -1) <= np.cos(np.radians(1.0))
        rows = rows[apart]
        return _turn(np.einsum("nki,nkj->nij", rows[..., :3], rows[..., 3:])).reshape(-1, 9)

    @staticmethod
    def errors(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        off = models.reshape(-1, 3, 3) @ rows[:, 3:].T - rows[:, :3].T
        return 2 * np.arcsin(np.minimum(np.sqrt(off[:, 0] ** 2 + off[:, 1] ** 2 + off[:, 2] ** 2) / 2, 1))

    @staticmethod
    def sums(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return (rows[:, :3].T @ rows[:, 3:]).ravel()

    @staticmethod
    def update(model: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return _turn(sums.reshape(3, 3)).ravel()


class Epipolar:
    """Essential matrices (row-major, b' E a = 0) from image places au, av and bu, bv on the planes at distance 1. Errors are Sampson's."""

    columns, draws, size, terms = ("au", "av", "bu", "bv"), 8, 9, 81

    @staticmethod
    def _design(rows: np.ndarray) -> np.ndarray:
        a, b = (np.concatenate([rows[..., k : k + 2], np.ones((*rows.shape[:-1], 1))], -1) for k in (0, 2))
        return (b[..., :, None] * a[..., None, :]).reshape(*rows.shape[:-1], 9)

    @staticmethod
    def _essential(e: np.ndarray) -> np.ndarray:
        """The nearest matrix with two equal singular values and a zero."""
        u, _, vt = np.linalg.svd(e.reshape(-1, 3, 3))
        return (u[..., :, :2] @ vt[..., :2, :] / np.sqrt(2)).reshape(-1, 9)

    @staticmethod
    def fit(rows: np.ndarray) -> np.ndarray:
        if not len(rows):
            return np.empty((0, 9))
        # The last direction is at right angles to all eight rows.
        return Epipolar._essential(np.linalg.qr(np.swapaxes(Epipolar._design(rows), 1, 2), mode="complete")[0][..., -1])

    @staticmethod
    def errors(models: np.ndarray, rows: np.ndarray) -> np.ndarray:
        e = models.reshape(-1, 3, 3)
        a, b = (np.column_stack([rows[:, k : k + 2], np.ones(len(rows))]).T for k in (0, 2))
        off = np.abs(models @ Epipolar._design(rows).T)
        ends = sum((m @ x) ** 2 for m, x in ((e[:, 0], a), (e[:, 1], a), (e[:, :, 0], b), (e[:, :, 1], b)))
        return off / np.sqrt(np.maximum(ends, 1e-300))

    @staticmethod
    def sums(model: np.ndarray, rows: np.ndarray) -> np.ndarray:
        d = Epipolar._design(rows)
        return (d.T @ d).ravel()

    @staticmethod
    def update(model: np.ndarray, sums: np.ndarray) -> np.ndarray:
        return Epipolar._essential(np.linalg.eigh(sums.reshape(9, 9))[1][:, 0])[0]


@dataclass
class Found:
    """`models`: by..., model (from 0, most inliers first), params, inliers. `rows`: the rows with the model that they are inliers of (null: none)."""

    models: DataFrame
    rows: DataFrame


def sequential(rows: DataFrame, by: list[str], kind, threshold: float, models: int = 2, least: int = LEAST_INLIERS, share: float = RIVAL_SHARE, draws: int = 200, sample: int = 400, refits: int = 2, part_rows: int = 20_000, seed: int = 42) -> Found:
    """Up to `models` models of `kind` for each group, one after another, each from the rows that the ones before leave.

    The first needs `least` inliers, the others that and `share` of the first's. Rows with a null or NaN among the model's
    columns are no inliers. Groups are rows of equal `by`, nulls too; a group without a model has none in `models`.
    """
    kinds = dict(rows.dtypes)
    keys = [f"_g{k}" for k in range(len(by))]
    key_schema = ", ".join(f"{k} {kinds[b]}" for k, b in zip(keys, by, strict=True))
    values = list(kind.columns)
    sound = F.lit(True)
    for c in values:
        sound = sound & finite(c)
    # Row numbers are checkpointed before use, so parts and samples stay what they are when a task runs again.
    numbered = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()
    plain = numbered.where(F.coalesce(sound, F.lit(False))).select(*[F.col(b).alias(k) for k, b in zip(keys, by, strict=True)], *[F.col(c).cast("double").alias(c) for c in values], "_row")
    taken, found, first = None, [], None

    def met(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
        b = b.withColumnsRenamed({k: f"_o{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_o{k}"))
        return a.join(b, same, how).drop(*[f"_o{k}" for k in keys])

    # Groups of one part go through all models in one pass; only the others are met part by part.
    large = plain.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > part_rows).select(*keys).checkpoint()
    some = not large.isEmpty()
    left = met(plain, large, "left_semi") if some else plain.limit(0)
    whole = met(plain, large, "left_anti") if some else plain
    chances = [F.pmod(F.xxhash64("_row", F.lit(seed + k)), F.lit(1 << 30)).alias(f"_s{k}") for k in range(models)]
    solved = whole.select("*", *chances).groupBy(*keys).applyInArrow(_solved(kind, keys, values, threshold, models, least, share, draws, sample, refits, seed), f"{key_schema}, model int, params array<double>, inliers bigint, _rows array<bigint>").checkpoint()
    for number in range(models if some else 0):
        sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        if first is not None:
            sizes = met(sizes, first.select(*keys, F.col("inliers").alias("_first")), "left_outer").where(F.col("_first").isNotNull())
        need = F.greatest(F.lit(least), F.ceil(share * F.col("_first"))).cast("long") if first is not None else F.lit(least).cast("long")
        sizes = sizes.select(*keys, "_n", need.alias("_need")).where(F.col("_n") >= F.col("_need")).checkpoint()
        if sizes.isEmpty():
            break
        dealt = met(left, sizes.select(*keys, F.ceil(F.col("_n") / part_rows).alias("_parts"), "_n")).withColumn("_part", F.pmod(F.xxhash64("_row"), F.col("_parts"))).checkpoint()
        drawn = dealt.where(F.pmod(F.xxhash64("_row", F.lit(seed + number)), F.lit(1 << 30)) < F.col("_n").cast("double") ** -1 * (sample * (1 << 30)))
        tried = drawn.groupBy(*keys).applyInPandas(_drawn(kind, keys, values, draws, sample, seed + number), f"{key_schema}, params array<double>").checkpoint()
        parts = sizes.select(*keys, F.explode(F.sequence(F.lit(0), (F.ceil(F.col("_n") / part_rows) - 1).cast("int"))).alias("_part"))

        def passed(params: DataFrame, f, schema: str) -> DataFrame:
            own = [f"_a{k}" for k in keys]
            at = met(parts, params).select(*[F.col(k).alias(a) for k, a in zip(keys, own, strict=True)], F.col("_part").cast("long").alias("_at"), "params")
            return dealt.groupBy(*keys, "_part").cogroup(at.groupBy(*own, "_at")).applyInPandas(f, schema)

        array = f"{key_schema}, params array<double>"
        counts = passed(tried, _counted(kind, keys, values, threshold), f"{array}, _h int, _c bigint")
        total = counts.groupBy(*keys, "_h").agg(F.sum("_c").alias("_c"), F.first("params").alias("params"))
        best = total.groupBy(*keys).agg(F.max_by("params", F.struct("_c", -F.col("_h"))).alias("params"))
        for _ in range(refits):
            sums = passed(best, _summed(kind, keys, values, threshold), f"{array}, sums array<double>")
            added = sums.groupBy(*keys).agg(F.first("params").alias("params"), F.array(*[F.sum(F.col("sums")[k]) for k in range(kind.terms)]).alias("sums"), F.sum(F.col("sums")[kind.terms]).alias("_c"))
            best = added.groupBy(*keys).applyInPandas(_updated(kind, keys, kind.draws), array)
        best = best.checkpoint()
        inside = passed(best, _inside(kind, keys, values, threshold), f"{key_schema}, _row bigint").checkpoint()
        count = met(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("inliers")), best)
        new = met(count, sizes.select(*keys, "_need")).where(F.col("inliers") >= F.col("_need")).select(*keys, F.lit(number).alias("model"), "params", "inliers").checkpoint()
        first = new if first is None else first
        inside = met(inside, new.select(*keys)).select("_row", F.lit(number).alias("model"))
        taken = inside if taken is None else taken.union(inside)
        found.append(new)
        left = met(left, new.select(*keys)).join(inside, "_row", "left_anti")
    out = solved.drop("_rows")
    for new in found:
        out = out.union(new)
    alone = solved.select(F.explode("_rows").alias("_row"), "model")
    taken = alone if taken is None else taken.union(alone)
    return Found(out.withColumnsRenamed(dict(zip(keys, by, strict=True))), numbered.drop("model").join(taken, "_row", "left").drop("_row"))


def _frame(key, keys: list[str], n: int, **columns) -> pd.DataFrame:
    """n rows of a group; an empty frame has no types that could clash with the schema."""
    columns = {**{k: [v] * n for k, v in zip(keys, key, strict=False)}, **columns}
    return pd.DataFrame(columns if n else {c: pd.Series([], dtype=object) for c in columns})


def _tried(kind, rows: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """Models through draws of a group's sampled rows."""
    if len(rows) < kind.draws:
        return np.empty((0, kind.size))
    rng = np.random.default_rng(seed)
    models = kind.fit(rows[np.argpartition(rng.random((draws, len(rows))), kind.draws - 1, axis=1)[:, : kind.draws]])
    return models[np.isfinite(models).all(axis=1)]


def _fitted(errors: np.ndarray, threshold: float) -> np.ndarray:
    """Rows that a refit counts: inliers whose error is like the others'. A row that is within the threshold by chance alone would pull an exact model."""
    near = errors <= threshold
    if not near.any():
        return near
    return errors <= min(threshold, max(REFIT_SIGMAS * 1.4826 * float(np.median(errors[near])), REFIT_LEAST * threshold))


def _solved(kind, keys, values, threshold, models, least, share, draws, sample, refits, seed):
    """All models of a group of one part, and the rows that are inliers of each."""

    def run(key, table):
        row = table["_row"].to_numpy()
        order = np.argsort(row)
        row, data = row[order], np.column_stack([table[c].to_numpy() for c in values])[order]
        chance = [table[f"_s{k}"].to_numpy()[order] for k in range(models)]
        left, first, found = np.arange(len(row)), None, []
        for number in range(models):
            need = least if first is None else max(least, math.ceil(share * first))
            if len(left) < need or not len(left):
                break
            rows = data[left]
            tried = _tried(kind, rows[chance[number][left] < 1 / len(left) * (sample * (1 << 30))][: 2 * sample], draws, seed + number)
            if not len(tried):
                break
            step = max(1, CELLS // len(rows))
            count = np.concatenate([(kind.errors(tried[k : k + step], rows) <= threshold).sum(1) for k in range(0, len(tried), step)])
            model = tried[int(np.argmax(count))]
            for _ in range(refits):
                near = rows[_fitted(kind.errors(model[None], rows)[0], threshold)]
                new = kind.update(model, kind.sums(model, near)) if len(near) >= kind.draws else model
                model = new if np.isfinite(new).all() else model
            inside = kind.errors(model[None], rows)[0] <= threshold
            n = int(inside.sum())
            if n < need:
                break
            first = n if first is None else first
            found.append((number, model, n, row[left[inside]]))
            left = left[~inside]
        parts = list(zip(*found, strict=True)) or [[]] * 4
        one = [pa.array([k.as_py()] * len(found), k.type) for k in key]
        rest = [pa.array(parts[0], pa.int32()), pa.array(list(parts[1]), pa.list_(pa.float64())), pa.array(parts[2], pa.int64()), pa.array(list(parts[3]), pa.list_(pa.int64()))]
        return pa.Table.from_arrays([*one, *rest], names=[*keys, "model", "params", "inliers", "_rows"])

    return run


def _drawn(kind, keys, values, draws, sample, seed):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        models = _tried(kind, pdf.sort_values("_row")[values].to_numpy(float)[: 2 * sample], draws, seed)
        n = min(1, len(models))
        return _frame(key, keys, n, params=[models.ravel()] * n)

    return run


def _counted(kind, keys, values, threshold):
    def run(key, rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        models = np.array(params["params"].iloc[0]).reshape(-1, kind.size) if len(params) else np.empty((0, kind.size))
        n = (kind.errors(models, rows[values].to_numpy(float)) <= threshold).sum(1) if len(models) else []
        return _frame(key, keys, len(models), params=list(models), _h=np.arange(len(models)), _c=n)

    return run


def _summed(kind, keys, values, threshold):
    def run(key, rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        if not len(params):
            return _frame(key, keys, 0, params=[], sums=[])
        model, data = np.array(params["params"].iloc[0]), rows[values].to_numpy(float)
        near = data[_fitted(kind.errors(model[None], data)[0], threshold)]
        return _frame(key, keys, 1, params=[model], sums=[np.append(kind.sums(model, near), len(near))])

    return run


def _updated(kind, keys, least):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        model = np.array(pdf["params"].iloc[0])
        if pdf["_c"].iloc[0] >= least:
            new = kind.update(model, np.array(pdf["sums"].iloc[0]))
            model = new if np.isfinite(new).all() else model
        return _frame(key, keys, 1, params=[model])

    return run


def _inside(kind, keys, values, threshold):
    def run(key, rows: pd.DataFrame, params: pd.DataFrame) -> pd.DataFrame:
        if not len(params):
            return _frame(key, keys, 0, _row=[])
        inside = rows["_row"].to_numpy()[kind.errors(np.array(params["params"].iloc[0])[None], rows[values].to_numpy(float))[0] <= threshold]
        return _frame(key, keys, len(inside), _row=inside)

    return run


def rival(a: Column, b: Column) -> Column:
    """Whether two poses (params) are places of their own: farther apart, or turned more, than the fixed bounds."""
    step = F.sqrt(sum(((col(a)[k] - col(b)[k]) * (col(a)[k] - col(b)[k]) for k in range(9, 12)), F.lit(0.0)))
    trace = sum((col(a)[k] * col(b)[k] for k in range(9)), F.lit(0.0))
    return (step > RIVAL_METRES) | (F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2)))) > RIVAL_DEGREES)


def on_floor(z, floor, floor_sigma, point_sigma) -> Column:
    """Points within the band of the map's floor; none without a floor or a height."""
    band = F.greatest(F.lit(FLOOR_BAND), K_SIGMA * F.hypot(col(floor_sigma), col(point_sigma)))
    return F.coalesce(F.abs(col(z) - col(floor)) <= band, F.lit(False))


def guarded(inliers: DataFrame, by: list[str], floor, floor_sigma, least: int = LEAST_INLIERS) -> DataFrame:
    """The guards of each pose over its inliers: (by..., inliers, kept, off_floor, consistent, passed).

    `inliers`: by..., z (height), point_sigma, own and predicted (depths), sigma (of both depths' scales), free_scale. An
    inlier whose own depth contradicts the predicted one leaves (one without either stays); a pose whose median ratio is
    beyond the median bound is inconsistent, once enough inliers have both depths. A monocular frame's ratios count about
    their median, and it is not judged as a whole. What stays must have enough inliers, and enough off the floor.
    """
    both = finite("own") & finite("predicted") & (F.col("own") > 0) & (F.col("predicted") > 0)
    rows = inliers.withColumns({"_r": F.when(F.coalesce(both, F.lit(False)), F.log(F.col("own") / F.col("predicted"))), "_bound": K_SIGMA * F.hypot(F.col("sigma"), F.lit(POINT_NOISE)), "_floor": on_floor("z", floor, floor_sigma, "point_sigma")})
    middle = rows.groupBy(*by).agg(F.percentile("_r", F.lit(0.5)).alias("_m"), F.percentile(F.when(F.col("_r").isNotNull(), F.col("_bound")), F.lit(0.5)).alias("_mb"), F.count("_r").alias("_both"), F.max("free_scale").alias("_free"))
    j = rows.join(middle, by)
    stays = F.col("_r").isNull() | (F.abs(F.col("_r") - F.when(F.col("_free"), F.col("_m")).otherwise(0.0)) <= F.col("_bound"))
    whole = F.col("_free") | (F.col("_both") < least) | (F.abs(F.col("_m")) <= F.col("_mb"))
    out = j.groupBy(*by).agg(F.count(F.lit(1)).alias("inliers"), F.count(F.when(stays, 1)).alias("kept"), F.count(F.when(stays & ~F.col("_floor"), 1)).alias("off_floor"), F.first(whole).alias("consistent"))
    return out.withColumn("passed", F.col("consistent") & (F.col("kept") >= least) & (F.col("off_floor") >= least))
