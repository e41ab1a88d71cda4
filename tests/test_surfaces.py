"""Quantiles, nearest places, normals and boxes against brute force over hot groups, copies, ties and outliers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.operators import boxes as B
from atlasloom.operators import quantiles
from atlasloom.operators import surfaces as S


def test_quantiles_of_a_hot_group_equal_a_sort(spark):
    rng = np.random.default_rng(0)
    values = {"hot": np.concatenate([rng.normal(size=3000), np.full(2000, 0.25), rng.lognormal(0, 40, 500), [-1.7e308, 1.7e308]]), "small": rng.normal(size=5), "same": np.full(900, 7.0), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("hot", float("inf")), (None, 1.0), ("none", None)]
    probs = (0.0, 0.02, 0.5, 0.731, 0.98, 1.0)
    got = {r.g: r for r in quantiles.exact(spark.createDataFrame(rows, "g string, v double").repartition(5), ["g"], "v", probs, most=50).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        assert got[g].n == len(vs)
        assert got[g].q == pytest.approx(np.quantile(vs, probs, method="linear"), rel=1e-12)


def test_quantiles_do_not_depend_on_the_bound(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.sin("id") * 10).alias("v"))
    a, b = ({r.g: list(r.q) for r in quantiles.exact(rows, ["g"], "v", (0.1, 0.9), most=m).collect()} for m in (10, 10**6))
    assert a.keys() == b.keys() and all(a[g] == pytest.approx(b[g], rel=1e-12) for g in a)
    assert quantiles.exact(rows.limit(0), ["g"], "v", (0.5,)).count() == 0


def cloud(seed=1):
    """A dense clump, many copies of a place, a coarse grid with ties, and far outliers."""
    rng = np.random.default_rng(seed)
    clump = rng.normal(0, 1e-3, (700, 3))
    copies = np.repeat([[0.5, 0.5, 0.5]], 30, axis=0)
    grid = np.stack(np.meshgrid(range(4), range(4), range(3)), -1).reshape(-1, 3) + 5.0
    return np.concatenate([clump, copies, grid, [[1000.0, -900, 40], [-3e4, 0, 0]]])


def test_nearest_places_equal_brute_force(spark):
    pts = cloud()
    df = spark.createDataFrame([(0, *map(float, p)) for p in pts] + [(1, 0.0, 0.0, float(i)) for i in range(5)] + [(1, None, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (None, 0.0, 0.0, 0.0)], "g int, x double, y double, z double")
    at = S.places(df, ["g"])
    got = S.nearest_places(at, at, 16, 0.05, ["g"]).collect()
    assert len(got) == at.count()
    seen = {0: pts, 1: np.array([[0.0, 0, i] for i in range(5)])}
    for r in got:
        all_ = seen[r.g]
        d2 = ((all_ - [r.x, r.y, r.z]) ** 2).sum(1)
        order = sorted(range(len(all_)), key=lambda i: (d2[i], *all_[i]))[:16]
        flat = [(p.x, p.y, p.z) for p in r.near for _ in range(p.n)]
        assert flat == [tuple(all_[i]) for i in order]


def test_no_place_and_fewer_than_wanted(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)], "x double, y double, z double")
    at = S.places(df)
    assert S.nearest_places(at, at.limit(0), 3, 1.0).count() == 0
    assert S.nearest_places(at.limit(0), at, 3, 1.0).count() == 0
    assert [len(r.near) for r in S.nearest_places(at, at, 3, 1e-6).collect()] == [2, 2]


def test_queries_far_from_all_places_meet_few_of_them(spark):
    """Places two metres over the queries, as viewpoints are: exact, ties and counts included, without meeting all places."""
    rng = np.random.default_rng(5)
    low, high = rng.normal(0, 0.12, (3000, 3)), np.repeat(np.column_stack([rng.uniform(-100, 100, 1500), rng.uniform(-1, 1, 1500), rng.normal(2, 0.05, 1500)]), 2, axis=0)
    low = np.concatenate([low, [[0, 0, 3e4]]])
    frame = lambda p: spark.createDataFrame([tuple(map(float, v)) for v in p], "x double, y double, z double")
    queries, at = S.places(frame(low)), S.places(frame(high))
    got = {(r.x, r.y, r.z): r.near for r in S.nearest_places(queries, at, 3).collect()}
    assert len(got) == len(low)
    for q in low:
        d2 = ((high - q) ** 2).sum(1)
        order = np.lexsort([*high.T[::-1], d2])[:3]
        assert [(p.x, p.y, p.z) for p in got[tuple(q)] for _ in range(p.n)] == [tuple(high[i]) for i in order]
    asked, held = (S._tiles(rows.repartition(3), [], None) for rows in (queries, at))
    assert sum(len(r.xs) for r in held.collect()) == 1500 and max(len(r.xs) for r in asked.collect()) <= S.TILES[-1]
    pairs = S._near_tiles(asked.withColumn("need", F.lit(3)), held, [], None)
    assert 0 < pairs.count() < 0.5 * asked.count() * held.count()


def test_normals_of_planes_look_at_the_nearest_viewpoint(spark):
    rng = np.random.default_rng(2)
    n = np.array([0.36, -0.48, 0.8])
    a = np.cross(n, [1.0, 0, 0])
    a /= np.linalg.norm(a)
    p = rng.uniform(-1, 1, (200, 2)) @ np.stack([a, np.cross(n, a)])
    rows = [(i, *map(float, v), "kept") for i, v in enumerate(p)] + [(900, None, 0.0, 0.0, "kept"), (901, float("inf"), 0.0, 0.0, "kept")]
    df = spark.createDataFrame(rows, "id int, x double, y double, z double, axis string")
    views = spark.createDataFrame([tuple(map(float, -3 * n)), tuple(map(float, 90 * n))], "x double, y double, z double")
    got = {r.id: r for r in S.point_normals(df, views, 8, 0.2).collect()}
    assert len(got) == len(rows) and got[900].normal is None and got[901].residual is None and got[0].axis == "kept"
    for i in range(200):
        assert np.allclose(got[i].normal, -n, atol=1e-6) and got[i].residual < 1e-6
    origin = S.point_normals(df.selectExpr("id", "x + 5 * 0.36 AS x", "y - 5 * 0.48 AS y", "z + 5 * 0.8 AS z"), None, 8, 0.2).where("id < 200").collect()
    assert all(np.allclose(r.normal, -n, atol=1e-6) for r in origin)


def test_depth_normals_keep_to_their_own_surface(spark):
    """Two walls that face the camera, one behind the other: no normal leans over the jump; holes and lone pixels."""
    rows = [(0, u, v, 2.0 if u < 4 else 5.0) for u in range(8) for v in range(5)]
    rows = [(f, u, v, 0.0 if (u, v) == (1, 1) else z) for f, u, v, z in rows] + [(0, 20, 20, 3.0), (1, 0, 0, None), (1, 1, 0, float("nan"))]
    got = {(r.f, r.u, r.v): r.normal for r in S.depth_normals(spark.createDataFrame(rows, "f int, u int, v int, z double"), ["f"], 50.0, 50.0, 4.0, 2.0).collect()}
    assert len(got) == len(rows)
    for f, u, v, z in rows:
        want = [0.0, 0, 0]
        if (f, u, v) in ((0, 20, 20), (0, 0, 1), (0, 1, 0)):  # alone, or at the edge beside a hole
            p = np.array([(u - 4) * z / 50, (v - 2) * z / 50, z])
            want = -p / np.linalg.norm(p)
        elif z and not math.isnan(z):
            want = [0.0, 0, -1]
        assert np.allclose(got[f, u, v], want, atol=1e-9), (f, u, v)


def by_hand(p):
    """Box by trying every pair of points as an edge that has all others on one side."""
    xy, yaws = p[:, :2], {0.0}
    flat = np.linalg.matrix_rank(xy - xy[0], tol=1e-12) < 2
    if len(p) >= 4 and not flat:
        yaws = set()
        for a in xy:
            for b in xy:
                d = b - a
                if d.any() and (d[0] * (xy[:, 1] - a[1]) - d[1] * (xy[:, 0] - a[0]) >= 0).all():
                    yaws.add(round(math.atan2(d[1], d[0]) % (math.pi / 2), 4))
    best = None
    for t in sorted(yaws):
        a, b = xy @ [math.cos(t), math.sin(t)], xy @ [-math.sin(t), math.cos(t)]
        ea, eb = np.percentile(a, [2, 98]), np.percentile(b, [2, 98])
        area = round((ea[1] - ea[0]) * (eb[1] - eb[0]), 12)
        if best is None or area < best[0]:
            best = area, t, ea, eb
    _, t, a, b = best
    c = np.percentile(p[:, 2], [2, 98])
    w, d, yaw = a[1] - a[0], b[1] - b[0], math.degrees(t)
    if d > w:
        w, d, yaw = d, w, yaw + 90
    ma, mb = a.mean(), b.mean()
    return [ma * math.cos(t) - mb * math.sin(t), ma * math.sin(t) + mb * math.cos(t), c.mean(), *(max(v, 0.01) for v in (w, d, c[1] - c[0])), yaw - 180 if yaw > 90 else yaw]


def test_boxes_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    turn = lambda p, a: np.column_stack([p[:, 0] * math.cos(a) - p[:, 1] * math.sin(a), p[:, 0] * math.sin(a) + p[:, 1] * math.cos(a), p[:, 2]])
    groups = {
        "hot": turn(rng.uniform(-1, 1, (400, 3)) * [3, 1, 0.5], 0.4),
        "tall": turn(rng.uniform(-1, 1, (60, 3)) * [1, 4, 0.5], -0.7),
        "three": rng.normal(size=(3, 3)), "one": np.array([[1.0, 2, 3]]),
        "line": np.array([[i, 2.0 * i, 0.0] for i in range(6)]), "copies": np.array([[1.0, 1, 1]] * 9),
        "square": np.array([[x, y, 0.0] for x in range(5) for y in range(5)], float),
    }
    rows = [(g, *map(float, p)) for g, ps in groups.items() for p in ps] + [("hot", None, 0.0, 0.0), ("hot", float("nan"), 1e9, 0.0), (None, 0.0, 0.0, 0.0), ("void", None, None, None)]
    got = {r.g: r for r in B.upright(spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(7), ["g"]).collect()}
    assert set(got) == set(groups)
    for g, p in groups.items():
        assert got[g].points == len(p)
        assert list(got[g])[2:] == pytest.approx(by_hand(p), abs=1e-6), g


def test_hull_is_the_same_however_points_are_parted():
    rng = np.random.default_rng(4)
    p = rng.normal(size=(900, 2)).round(1)
    whole = B.hull(p)
    parts = np.concatenate([B.hull(c) for c in np.array_split(p, 13)])
    assert {tuple(v) for v in B.hull(parts)} == {tuple(v) for v in whole}
    d = np.roll(whole, -1, axis=0) - whole
    assert all((a[0] * (p[:, 1] - c[1]) - a[1] * (p[:, 0] - c[0]) >= -1e-9).all() for c, a in zip(whole, d))


def test_floors_and_supports(spark):
    b = spark.createDataFrame([(0, 1.0, 1.0), (1, 0.6, 1.0), (2, 2.0, 0.2), (3, 0.09, 0.06)], "id int, cz double, height double").withColumns({"width": F.when(F.col("id") == 3, 0.05).otherwise(0.5), "depth": F.lit(0.05)})
    g = {r.id: (r.cz, r.height) for r in B.grounded(b, F.lit(0.0), 0.6, 0.5).collect()}
    assert g[0] == pytest.approx((0.75, 1.5)) and g[1] == pytest.approx((0.55, 1.1)) and g[2] == (2.0, 0.2) and g[3] == (0.09, 0.06)
    r = {x.id: (x.cz, x.height) for x in B.rested(b, F.when(F.col("id") < 3, 0.0), 0.5).collect()}
    assert r[0] == pytest.approx((0.75, 1.5)) and r[2] == (2.0, 0.2) and r[3] == (0.09, 0.06)
