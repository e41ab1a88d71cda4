"""Results that were wrong once: times by zone, ray entries, half turns, cameras alike."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.operators import checks, grid, joins


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_nearest_time_does_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        left = spark.sql("SELECT 1 AS g, timestamp_ntz'2024-03-10 03:10:00' AS t")
        right = spark.sql("SELECT 1 AS g, t, v FROM VALUES (timestamp_ntz'2024-03-10 01:55:00', 1D), (timestamp_ntz'2024-03-10 04:00:00', 2D) AS x(t, v)")
        [r] = joins.asof(left, right, ["g"], "t", "t", "v", "nearest").collect()
        assert r.matched == 2.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_rays_enter_cells_at_their_bounds(spark):
    a = math.radians(44)
    cells = spark.createDataFrame([(r, c, grid.FREE) for r in range(8) for c in range(8) if (r, c) != (2, 3)] + [(2, 3, grid.OCCUPIED)], "row bigint, col bigint, state int")
    rays = spark.createDataFrame([(1, 0.5, 0.5, math.cos(a), math.sin(a)), (2, 0.5, 2.5, 1.0, 0.0), (3, 3.5, 7.5, 0.0, -1.0), (4, 0.5, 6.5, 1.0, 0.0)], "id int, x double, y double, dx double, dy double")
    got = {r.id: r for r in grid.ray_entries(rays, cells, 0.25, 6.0, 1.0).collect()}
    assert got[1].range == pytest.approx(max(2.5 / math.cos(a), 1.5 / math.sin(a))) and (got[1].row, got[1].col) == (2, 3)
    assert got[2].range == pytest.approx(2.5) and got[3].range == pytest.approx(4.5) and got[4].range is None
    scaled = rays.select("id", *[(F.col(c) / 10).alias(c) for c in "xy"], "dx", "dy")
    assert {r.id: r.range for r in grid.ray_entries(scaled, cells, 0.025, 0.6, 0.1).collect()}[1] == pytest.approx(got[1].range / 10)


@pytest.mark.parametrize("degrees", [0.0, 1e-7, 30.0, 179.0, 179.4, 179.9, 179.9999, 180.0])
def test_rotation_vectors_of_half_turns(spark, degrees):
    rng = np.random.default_rng(int(degrees))
    axes = [*np.eye(3), *-np.eye(3), *(v / np.linalg.norm(v) for v in rng.normal(size=(10, 3)))]
    rows = spark.createDataFrame([([float(x) for x in a * math.radians(degrees)],) for a in axes], "w array<double>")
    for r in rows.withColumn("r", checks.exp_so3("w")).withColumn("back", checks.log_so3("r")).collect():
        off = min(np.abs(np.subtract(r.back, r.w)).max(), np.abs(np.add(r.back, r.w)).max() if degrees == 180.0 else 9)
        assert off < 1e-6


def test_zero_distortion_is_none(spark):
    f = lambda k, mask: {"fx": F.lit(1.0), "distortion": F.array(*map(F.lit, k)) if k is not None else F.lit(None).cast("array<double>"), "ignore_mask": F.lit(mask)}
    same = lambda a, b: checks.same_camera(a, b, {})
    [r] = spark.range(1).select(same(f([0.0, 0.0], "a"), f(None, "b")).alias("a"), same(f([0.1, 0.0], "a"), f([0.0, 0.0], "a")).alias("b"), same(f([0.1, 0.0], "a"), f([0.1, 0.0], "b")).alias("c")).collect()
    assert tuple(r) == (True, False, True)


def test_headings_wrap_as_their_sql_at_half_a_turn(spark):
    """Steps that rounding puts just off half a turn, either way."""
    import duckdb

    from atlasloom.operators import windows
    from atlasloom.plans import catalogue

    at = [round(0.01 * k, 2) for k in range(0, 20_000, 7)]
    rows = [(2 * u + way, k, round(v + 50.0 * (k if way else 2 - k), 2)) for u, v in enumerate(at) for way in range(2) for k in range(3)]
    events = spark.createDataFrame(rows, "user_id int, event_id int, value double").selectExpr("*", "event_id AS ts", "value * 3.6D AS h")
    got = {r.user_id: round(r.span, 3) for r in windows.sweep_span(events, ["user_id"], ["ts", "event_id"], "h").collect()}
    with duckdb.connect() as db:
        db.register("events", events.toArrow())
        assert got == dict(db.execute(catalogue.ORACLE_SQL["sweep_span"]).fetchall())


def test_crossings_are_rounded_as_their_sql(spark, monkeypatch):
    """Halves of the fifth decimal; each cell has one row, so the means are the same doubles on both sides."""
    import duckdb

    from atlasloom.plans import catalogue

    steps = np.random.default_rng(3).integers(0, 81, 14_000)
    rows = spark.createDataFrame([(k // 7, k % 7 + 1, float(v) * 0.00125) for k, v in enumerate(steps)], "l_suppkey bigint, l_linenumber int, l_discount double")
    with duckdb.connect() as db:
        db.register("lineitem", rows.toArrow())
        want = sorted(db.execute(catalogue.ORACLE_SQL["zero_crossings"]).fetchall())
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: rows)
    assert sorted(map(tuple, catalogue.QUERIES["zero_crossings"](spark, "/none").collect())) == want
