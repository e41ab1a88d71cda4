"""Sequential hypotheses: planted models, their inliers over every row, groups in parts, nulls."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from atlasloom.operators import hypotheses as H
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def turned(w):
    return H._exp(np.array(w, float))


def views(rng, turn, centre, n):
    """Points in front of a camera, and where it sees them."""
    cam = np.column_stack([rng.uniform(-1, 1, (n, 2)), np.ones(n)]) * rng.uniform(2, 8, n)[:, None]
    return np.column_stack([centre + cam @ turn.T, cam[:, :2] / cam[:, 2:]])


@pytest.mark.parametrize("part_rows", [20_000, 37])
def test_poses_of_planted_cameras(spark, part_rows):
    rng = np.random.default_rng(1)
    poses = {("a", 0): (turned([0.2, -0.4, 1.0]), np.array([1.0, 2.0, 3.0]), 300), ("a", 1): (turned([0.2, -0.4, 1.4]), np.array([4.0, 2.0, 3.0]), 120), (None, 0): (turned([0, 0, 3.0]), np.zeros(3), 60), ("few", 0): (np.eye(3), np.zeros(3), 14)}
    data = [(f, m, *map(float, v)) for (f, m), (r, c, n) in poses.items() for v in views(rng, r, c, n)]
    data += [("a", -1, *map(float, [*rng.uniform(0, 5, 3), *rng.uniform(-1, 1, 2)])) for _ in range(80)]
    data += [("a", -2, float("nan"), 0.0, 1.0, 0.0, 0.0), ("a", -2, None, 0.0, 1.0, 0.0, 0.0), ("flat", -1, 1.0, 1.0, 1.0, 0.0, 0.0)]
    rows = spark.createDataFrame(data, "frame string, planted int, x double, y double, z double, bu double, bv double").repartition(3)
    found = H.sequential(rows, ["frame"], H.Pose, 1e-4, models=3, part_rows=part_rows)
    models = {(r.frame, r.model): r for r in found.models.collect()}
    assert set(models) == {("a", 0), ("a", 1), (None, 0)}
    for key, r in models.items():
        turn, centre, n = poses[key]
        assert r.inliers == n and np.allclose(r.params[9:], centre, atol=1e-6) and np.allclose(np.reshape(r.params[:9], (3, 3)), turn, atol=1e-6)
    got = found.rows.toPandas()
    assert len(got) == len(data)
    assert all((r.model == r.planted) if (r.frame if isinstance(r.frame, str) else None, r.planted) in models else pd.isna(r.model) for r in got.itertuples())


def test_rotations_and_motions(spark):
    rng = np.random.default_rng(2)
    turn, step = turned([0.3, 0.1, -0.5]), np.array([0.5, -0.2, 0.1])
    rays = rng.normal(size=(200, 3))
    rays /= np.linalg.norm(rays, axis=1)[:, None]
    other = rng.normal(size=(40, 3))
    data = np.vstack([np.hstack([rays @ turn.T, rays]), np.hstack([other / np.linalg.norm(other, axis=1)[:, None], rays[:40]])])
    rows = spark.createDataFrame(pd.DataFrame(data, columns=list(H.Rotation.columns)).assign(f=1))
    [r] = H.sequential(rows, ["f"], H.Rotation, 1e-4).models.collect()
    assert r.inliers == 200 and np.allclose(np.reshape(r.params, (3, 3)), turn, atol=1e-6)
    p = np.column_stack([rng.uniform(-1, 1, (150, 2)), np.ones(150)]) * rng.uniform(2, 8, 150)[:, None]
    b = p @ turn.T + step
    data = np.vstack([np.hstack([p[:, :2] / p[:, 2:], b[:, :2] / b[:, 2:]]), rng.uniform(-1, 1, (30, 4))])
    rows = spark.createDataFrame(pd.DataFrame(data, columns=list(H.Epipolar.columns)).assign(f=1))
    [r] = H.sequential(rows, ["f"], H.Epipolar, 1e-6, models=1, draws=400).models.collect()
    cross = np.array([[0, -step[2], step[1]], [step[2], 0, -step[0]], [-step[1], step[0], 0]]) @ turn
    e, want = np.reshape(r.params, (3, 3)), cross / np.linalg.norm(cross)
    assert r.inliers == 150 and min(np.abs(e - want).max(), np.abs(e + want).max()) < 1e-6


def test_noise_is_fitted_over_all_inliers(spark):
    """The refit comes from every row of every part, so it is nearer than any minimal fit."""
    rng = np.random.default_rng(3)
    turn, centre = turned([0.1, 0.2, 0.3]), np.array([1.0, -1.0, 0.5])
    v = views(rng, turn, centre, 3000)
    v[:, 3:] += rng.normal(scale=1e-3, size=(3000, 2))
    rows = spark.createDataFrame(pd.DataFrame(v, columns=list(H.Pose.columns)).assign(f=1))
    [r] = H.sequential(rows, ["f"], H.Pose, 5e-3, models=1, part_rows=500).models.collect()
    assert r.inliers > 2990 and np.linalg.norm(np.array(r.params[9:]) - centre) < 5e-4


@pytest.mark.parametrize("part_rows", [20_000, 37])
def test_rows_near_by_chance_do_not_pull_a_model(spark, part_rows):
    """They count as inliers, but an exact model stays exact."""
    rng = np.random.default_rng(8)
    turn, centre = turned([0.1, 0.2, 0.3]), np.array([1.0, -1.0, 0.5])
    v = views(rng, turn, centre, 300)
    v[::30, 3] += 9e-4
    rows = spark.createDataFrame(pd.DataFrame(v, columns=list(H.Pose.columns)).assign(f=1))
    [r] = H.sequential(rows, ["f"], H.Pose, 1e-3, models=1, part_rows=part_rows).models.collect()
    assert r.inliers == 300 and np.linalg.norm(np.array(r.params[9:]) - centre) < 1e-9


def test_correspondences_take_the_first_candidate(spark):
    matches = spark.createDataFrame([("f", 1, 0.0, 0.0, 7, 2, 0, 5), ("f", 1, 0.0, 0.0, 8, 1, 1, 5), ("f", 2, 1.0, 1.0, 8, 1, 1, 6), ("f", 2, 1.0, 1.0, 8, 1, 0, 5), ("f", 3, 1.0, 1.0, 9, 0, 0, 5)], "frame string, feature int, u double, v double, candidate int, rank int, guided int, point int")
    points = spark.createDataFrame([(7, 5, 10.0, 10.0, 1.0), (8, 5, 20.0, 10.0, 2.0), (8, 6, 10.0, 10.0, float("nan"))], "candidate int, point int, ru double, rv double, depth double")
    frames = spark.createDataFrame([(c, 10.0, 10.0, 10.0, 10.0, [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0], 1.5) for c in (7, 8)], "candidate int, fx double, fy double, cx double, cy double, r array<double>, c array<double>, factor double")
    got = {r.feature: r for r in H.correspondences(matches, points, frames).collect()}
    assert set(got) == {1, 2} and {r.candidate for r in got.values()} == {8}
    assert got[1].x == pytest.approx([1.0, 5.0, 6.0]) and got[2].x == pytest.approx([1.0, 5.0, 6.0]) and np.linalg.norm(got[1].d) == pytest.approx(1)


def test_rivals_and_empty_tables(spark):
    near = lambda c, a: F.array(*[F.lit(float(x)) for x in [*turned([0, 0, a]).ravel(), *c]])
    [r] = spark.range(1).select(H.rival(near([0, 0, 0], 0), near([0.05, 0, 0], 0.05)).alias("a"), H.rival(near([0, 0, 0], 0), near([0.2, 0, 0], 0)).alias("b"), H.rival(near([0, 0, 0], 0), near([0, 0, 0], 0.1)).alias("c")).collect()
    assert tuple(r) == (False, True, True)
    none = spark.createDataFrame([], "f int, x double, y double, z double, bu double, bv double")
    found = H.sequential(none, ["f"], H.Pose, 1e-3)
    assert found.models.count() == 0 and found.rows.columns == [*none.columns, "model"] and found.rows.count() == 0


def test_groups_of_one_part_are_met_once(spark, monkeypatch):
    """All models of ordinary groups come from one pass over their rows; only groups of several parts take rounds."""
    kind, cuts = type(spark.range(1)), []
    cut = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, *args: cuts.append(1) or cut(self, *args))
    rng = np.random.default_rng(5)
    two = [(f, *map(float, v)) for f in range(3) for a, n in ((0.3, 60), (1.2, 30)) for v in views(rng, turned([0, f, a]), np.zeros(3), n)]
    rows = spark.createDataFrame(two, "f int, x double, y double, z double, bu double, bv double")
    assert sorted((r.f, r.model, r.inliers) for r in H.sequential(rows, ["f"], H.Pose, 1e-4).models.collect()) == [(f, k, n) for f in range(3) for k, n in ((0, 60), (1, 30))]
    assert len(cuts) == 3
