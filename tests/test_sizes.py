"""What larger tables showed: plans that grow by rounds, ranks that were skipped, pairs that need not be made."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasloom.llm import common
from atlasloom.operators import aggregates, joins, objects, rules
from atlasloom.operators import windows as W
from atlasloom.operators.graph import SHUFFLES_GO, _cut
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def test_levels_of_references_imply_nothing_of_each_other(spark, monkeypatch):
    kind, implied = type(spark.range(1)), []
    cut = kind.checkpoint

    def spied(self, *args):
        out = cut(self, *args)
        implied.append(len(str(out._jdf.queryExecution().optimizedPlan().constraints().toString())))
        return out

    monkeypatch.setattr(kind, "checkpoint", spied)
    k = F.col("id")
    frames = spark.range(1, 60).select(k.alias("frame"), F.when(k > 3, F.floor(k / 2)).alias("reference"), F.lit(0.5).alias("share"), F.lit(1.0).alias("lever"))
    got = {r.frame: r.shift for r in rules.replaced(frames, 1.0).collect()}
    want = {}
    for f in range(1, 60):
        want[f] = 0.5 + 0.5 * want[f // 2] if f > 3 else 0.5
    assert got == want and max(implied) < 1000, implied


@pytest.mark.parametrize("n", [20, 21, 22, 27, 33, 38, 39, 40, 57])
def test_spread_of_every_size(spark, n):
    got = {r.i for r in W.spread_sample(spark.range(n).selectExpr("0 AS g", "id AS i"), ["g"], ["i"], 20).collect()}
    assert got == ({int(k * ((n - 1) / 19.0)) for k in range(20)} if n > 20 else set(range(n)))


def test_nearest_on_a_line(spark):
    rng = np.random.default_rng(3)
    a = [(i, None if i % 17 == 0 else float(v)) for i, v in enumerate(rng.integers(-60, 60, 80))]
    b = [(i, None if i % 13 == 0 else float(v)) for i, v in enumerate(np.append(rng.integers(-60, 0, 50), [40, 40, 40, 44, 36, float("nan")]))]
    for k in (1, 2, 3):
        out = joins.nearest_on_line(spark.createDataFrame(a, "q long, x double"), spark.createDataFrame(b, "id long, y double"), "x", "y", "id", 7.0, k)
        got = sorted((r.q, r.id, r.distance) for r in out.collect())
        near = {q: sorted((abs(x - y), i) for i, y in b if y is not None and abs(x - y) <= 7)[:k] for q, x in a if x is not None}
        assert got == sorted((q, i, d) for q, best in near.items() for d, i in best)
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rows_in_one_place_meet_once(spark):
    a = spark.createDataFrame([(i, float(i % 3), None if i == 5 else 0.0) for i in range(60)], "i int, x double, y double")
    b = spark.createDataFrame([(i, float(i % 2), float("nan") if i == 4 else 0.0) for i in range(40)], "j int, u double, v double")
    near = joins.range_join(a, b, ["x", "y"], ["u", "v"], 1.0)
    want = sorted((i, j) for i in range(60) for j in range(40) if i != 5 and j != 4 and abs(i % 3 - j % 2) <= 1)
    assert sorted((r.i, r.j) for r in near.collect()) == want
    assert near.columns == ["i", "x", "y", "j", "u", "v", "distance"]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_equal_boxes_meet_once(spark):
    rows = [(f, i, float(i % 5), float(i % 3), float(i % 5 + 10), float(i % 3 + 5)) for f in range(2) for i in range(40)] + [(0, 99, None, 0.0, 9.0, 9.0)]
    out = objects.overlapping(spark.createDataFrame(rows, "f int, i int, x0 double, y0 double, x1 double, y1 double"), "f", "i", 0.5)
    want = []
    for f, i, *a in rows[:-1]:
        for g, j, *b in rows[:-1]:
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            if f == g and i < j and both / (100 - both) >= 0.5:
                want.append((f, i, j, round(both / (100 - both), 9)))
    assert sorted((r.f, r.i, r.i_b, round(r.iou, 9)) for r in out.collect()) == sorted(want)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_equal_surfaces_hold_as_one(spark):
    items = spark.createDataFrame([(i, 0.5, 0.5, [1.0, 1.01, None, 3.0][i % 4]) for i in range(40)], "id int, x double, y double, bottom double")
    surfaces = spark.createDataFrame([(100 - i, 1.0, float(i % 2), 0.0, 0.0, 1.0, 1.0) for i in range(60)], "sid int, height double, area double, x0 double, y0 double, x1 double, y1 double")
    out = objects.supports(items, surfaces)
    assert sorted((r.id, r.sid) for r in out.collect()) == [(i, 41) for i in range(40) if i % 4 < 2]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2


def test_written_steps_leave_no_shuffle_files(spark, tmp_path):
    """Disk holds the shuffles of one step, not of all steps so far."""
    folders = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data")}
    before, conf = files(), spark.conf.get(SHUFFLES_GO, None)
    rows = spark.range(1000).repartition(3, "id")
    held = [rows, common.written(rows, "step"), _cut(rows, None), _cut(rows, f"file://{tmp_path}")]
    deadline = time.time() + 15
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(SHUFFLES_GO, None) == conf
    assert [d.count() for d in held] == [1000] * 4


def test_ranks_of_a_large_group_are_counted(spark):
    """No task holds a group's values; groups with infinite values or NaN are ranked with them, as before."""
    n = 250_001
    rows = spark.range(n).select(F.lit("a").alias("g"), (F.pmod(F.col("id") * 7919, F.lit(n)) + 1).cast("double").alias("v"), (1 + F.col("id") % 2).cast("double").alias("w"))
    more = spark.createDataFrame([("b", float(v), 1.0) for v in range(1, 10)] + [("b", float("inf"), 1.0), ("b", None, 1.0), (None, 5.0, 1.0)], "g string, v double, w double")
    both = rows.union(more)
    out = aggregates.trimmed_mean(both, ["g"], "v", "w")
    got = {r.g: r for r in out.collect()}
    v = np.arange(n) * 7919 % n + 1.0
    keep = (v >= np.quantile(v, 0.1)) & (v <= np.quantile(v, 0.9))
    assert set(got) == {"a", "b"} and got["a"].n == keep.sum() and got["b"].n == 9
    assert got["a"].mean == pytest.approx(np.average(v[keep], weights=1.0 + np.arange(n)[keep] % 2)) and got["b"].mean == float("inf")
    assert "percentile" not in aggregates.trimmed_mean(rows, ["g"], "v", "w")._jdf.queryExecution().optimizedPlan().toString()
