"""The whole of the input counts: no frame, row, point or round is left out."""

import pytest
from pyspark.sql import functions as F

from atlasloom.operators import grid, rules, solvers
from atlasloom.plans import catalogue
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def test_pairs_of_every_frame(spark, tmp_path):
    boxes = [(400 * n + frame, n, 1, 1, "A", 1.0, 5.0 + n, 0.01) for frame in (0, 39, 40, 250, 399) for n in range(2)]
    spark.createDataFrame(boxes, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_returnflag string, l_extendedprice double, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["overlapping_boxes_all"](spark, str(tmp_path)).collect()
    assert sorted((r.frame, r.iou) for r in got) == [(f, round(45 / 55, 6)) for f in (0, 39, 40, 250, 399)]


def test_affinity_of_every_row(spark, sf):
    rows = catalogue.QUERIES["object_affinity_all"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/embeddings.parquet").count()

    def want(v):
        i, k, near = v % 11 / 10, v % 7 / 6, max(0, min(1, 1 - v % 13 / 10 / 0.65))
        if v % 3:
            return max(i, k, near) if max(i, k, near) >= 0.3 else max(0.3, 0.7 * i) if v % 2 == 0 and i >= 0.5 else None
        return min(i, k) if min(i, k) >= 0.7 else max(0.3, 0.7 * i) if v % 2 == 0 and i >= 0.5 else None

    for r in rows:
        w = want(r.vec_id)
        assert (r.affinity is None) == (w is None) and (w is None or r.affinity == pytest.approx(w, abs=1e-4)), r
    assert {r.affinity is None for r in rows} == {True, False}


def test_plane_counts_every_row(spark):
    n, place = 30_000, 25_000
    k = F.col("id")
    flat = spark.range(n).select(F.lit("a").alias("g"), (k % 173).cast("double").alias("x"), (k % 191).cast("double").alias("y"), F.when(k % 5 == 0, 3.0 + k % 89).otherwise(0.01 * (k % 2)).alias("z"))
    heap = spark.range(place + 9000).select(F.lit(None).cast("string").alias("g"), F.when(k < place, 1.0).otherwise(k % 70).alias("x"), F.when(k < place, 2.0).otherwise(k % 83).alias("y"), F.lit(7.0).alias("z"))
    few = spark.createDataFrame([("few", 0.0, 0.0, 0.0), ("few", 1.0, 1.0, float("nan")), ("few", 1.0, 1.0, None)], "g string, x double, y double, z double")
    got = {r.g: r for r in solvers.robust_plane(flat.union(heap).union(few), ["g"]).collect()}
    assert got["a"].inliers == n - n // 5 and got["a"].nz > 0.999 and abs(got["a"].d) < 0.02
    assert got[None].inliers == place + 9000 and got[None].nz > 0.999 and got[None].d == pytest.approx(-7.0)
    assert got["few"].inliers == 0 and got["few"].nx is None


def test_hypotheses_meet_places_with_their_counts(spark):
    """A thousand copies of a place meet each hypothesis once and count a thousand times."""
    k = F.col("id")
    rows = spark.range(40_000).select(F.lit(1).alias("g"), (k % 8).cast("double").alias("x"), (k % 5).cast("double").alias("y"), F.lit(2.0).alias("z"))
    out = solvers.robust_plane(rows, ["g"])
    assert "sum(_count" in out._jdf.queryExecution().analyzed().toString()
    assert [(r.inliers, round(r.d, 9)) for r in out.collect()] == [(40_000, -2.0)]


@pytest.mark.parametrize(("name", "most"), [("geodesic_steps", 30), ("registered_rounds", 30)])
def test_chains_are_walked_to_their_end(spark, tmp_path, name, most):
    links = [(k, k - 1 + d, 50.0) for k in range(1, 17) for d in (0, 1)] if name == "registered_rounds" else [(k + 4, k + d, 50.0) for k in range(1, 17) for d in (0, 1)]
    spark.createDataFrame(links, "l_suppkey bigint, l_partkey bigint, l_quantity double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r[1] for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect()]
    assert max(got) > most and len(got) == 33


def test_long_chain_of_references(spark):
    n = 54
    frames = spark.createDataFrame([(k, k - 1 if k else None, 0.0 if k else 1.0, 2.0) for k in range(n)], "frame int, reference int, share double, lever double").coalesce(1).checkpoint()
    assert {r.frame: r["shift"] for r in rules.replaced(frames, 1.0).collect()} == {k: 2.0 for k in range(n)}
    twice = spark.createDataFrame([(1, None, 1.0, 2.0), (1, 1, 0.0, 2.0)], "frame int, reference int, share double, lever double")
    with pytest.raises(RuntimeError, match="several references"):
        rules.replaced(twice, 1.0)


def test_only_thin_walls_grow(spark):
    rows, cols, edge = 24, 40, 0.1
    occupied = {(2, c) for c in range(3, 22)} | {(r, c) for r in range(8, 13) for c in range(5, 30)} | {(18, 6), (18, 7), (21, 30)} | {(r, 36) for r in range(1, 16)}
    drop = {(r, 37) for r in range(1, 16)}
    absent = {(3, c) for c in range(8, 14)} | {(20, 20)}
    cells = [(r, c, 2 if (r, c) in occupied | drop else 1, (r, c) in drop, float(r)) for r in range(rows) for c in range(cols) if (r, c) not in absent]
    label = {}
    for start in sorted(occupied):
        if start not in label:
            stack, label[start] = [start], start
            while stack:
                r, c = stack.pop()
                for p in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                    if p in occupied and p not in label:
                        label[p] = start
                        stack.append(p)
    wall = set()
    for root in set(label.values()):
        piece = [p for p in label if label[p] == root]
        if max(max(p[k] for p in piece) - min(p[k] for p in piece) + 1 for k in (0, 1)) * edge >= 1.5:
            wall |= set(piece)
    ways = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    grown = {(r, c) for r in range(rows) for c in range(cols) if (r, c) not in occupied | drop and any((r + i, c + j) in wall and not all((r + m * i, c + m * j) in wall for m in range(1, 5)) for i, j in ways)}
    got = {(r.row, r.col): r for r in grid.inflated_walls(spark.createDataFrame(cells, "row int, col int, state int, drop boolean, top double"), edge).collect()}
    assert {p for p, r in got.items() if r.state == 2} == occupied | drop | grown and grown & absent and (18, 8) not in grown and (7, 10) not in grown
    assert got[3, 9].top == 2.0 and set(got) == {(r, c) for r in range(rows) for c in range(cols)} - (absent - grown)


def test_names_and_numbers_of_any_length(spark):
    from atlasloom.functions import text

    names = spark.range(1_234_567, 1_234_569).select(text.frame_name("id").alias("n")).collect()
    assert [r.n for r in names] == ["f1234567", "f1234568"]
    given = ["a2", "a10", "a10b", "a1234567890123456788", "a1234567890123456789", "b", "7", "a02c"]
    got = [r.n for r in spark.createDataFrame([(g,) for g in given], "n string").orderBy(text.natural_key("n"), "n").collect()]
    assert got == ["7", "a2", "a02c", "a10", "a10b", "a1234567890123456788", "a1234567890123456789", "b"]


def test_components_with_hubs_and_chains(spark):
    from atlasloom.operators.graph import connected_components

    hub = spark.range(1, 5000).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    top = spark.range(10_000, 13_000).select(F.lit(20_000).cast("long").alias("src"), F.col("id").alias("dst"))
    chain = spark.range(30_000, 30_300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(hub.union(top).union(chain)).groupBy("component").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.component: r.n for r in got} == {0: 5000, 10_000: 3001, 30_000: 301}


def test_interval_best_keeps_repeated_rows_and_nulls(spark):
    from atlasloom.operators.joins import interval_best

    left = spark.createDataFrame([("u", 0, 5, None), ("u", 0, 5, None), ("u", 6, 7, 1.0), (None, 0, 5, 1.0)], "g string, lo int, hi int, own double")
    right = spark.createDataFrame([("u", 3, 9.0, "x"), ("u", 4, 8.0, "y")], "g string, at int, v double, name string")
    got = interval_best(left, right, ["g"], "lo", "hi", "at", F.col("v"), "name").collect()
    assert sorted((r.g or "", r.lo, r.best or "") for r in got) == [("", 0, ""), ("u", 0, "y"), ("u", 0, "y"), ("u", 6, "")]


def test_ranks_over_all_rows(spark):
    from atlasloom.operators.windows import ranked

    got = ranked(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), ["k"]).collect()
    assert [r["rank"] for r in sorted(got, key=lambda r: r.k)] == list(range(1, 1001))
