"""Operators whose results SQL can't give, and edge rows."""

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlasloom.functions import codecs, geometry, text
from atlasloom.operators import aggregates, evaluation, graph, grid, joins, objects, solvers, windows
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def brute_components(edges):
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        if a != b and x != y:
            parent[max(x, y)] = min(x, y)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_connected_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 240)] + [(7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == brute_components(edges)


def test_connected_components_of_nothing(spark):
    assert graph.connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_spanning_forest(spark):
    rng = random.Random(4)
    edges = [(a, b, float(rng.randrange(50))) for a in range(12) for b in range(a + 1, 12) if rng.random() < 0.4]
    got = {(r.a, r.b) for r in graph.spanning_forest(spark.createDataFrame(edges, "src int, dst int, w double"), "w").collect()}
    parent, want = list(range(12)), set()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            parent[find(a)] = find(b)
            want.add((a, b))
    assert got == want


def test_greedy_match(spark):
    rng = random.Random(1)
    pairs = [(0, a, b, float(rng.randrange(6))) for a in range(9) for b in range(7) if rng.random() < 0.6]
    used_a, used_b, want = set(), set(), set()
    for _, a, b, s in sorted(pairs, key=lambda p: (-p[3], p[1], p[2])):
        if a not in used_a and b not in used_b:
            used_a.add(a)
            used_b.add(b)
            want.add((a, b, s))
    got = joins.greedy_match(spark.createDataFrame(pairs, "g int, a int, b int, s double"), ["g"], "a", "b", "s")
    assert {(r.a, r.b, r.s) for r in got.collect()} == want


def test_suppression(spark):
    rng = random.Random(2)
    boxes = [(f, f"d{k}", rng.choice("ab"), rng.randrange(5) / 5, float(x := rng.randrange(8)), float(y := rng.randrange(8)), x + 4.0, y + 4.0) for f in range(4) for k in range(12)]

    def iou(p, q):
        w, h = min(p[6], q[6]) - max(p[4], q[4]), min(p[7], q[7]) - max(p[5], q[5])
        return w * h / (32 - w * h) if w > 0 and h > 0 else 0

    want = set()
    for f in range(4):
        kept = []
        for b in sorted((b for b in boxes if b[0] == f), key=lambda b: (-b[3], b[2], b[4], b[5])):
            if all(iou(b, k) <= 0.5 for k in kept):
                kept.append(b)
        want |= {b[4:8] + (f,) for b in kept}
    rows = spark.createDataFrame(boxes, "frame int, det_id string, label string, score double, x0 double, y0 double, x1 double, y1 double")
    assert {(r.x0, r.y0, r.x1, r.y1, r.frame) for r in objects.suppressed(rows, "frame", 0.5).collect()} == want


def test_drops_and_frontiers(spark):
    cells = [(0, c, 0.0, True, False) for c in range(4)] + [(1, 0, -0.05, False, True)] + [(r, c, -0.6, False, True) for r in (3, 4) for c in range(5)]
    found = grid.drops(spark.createDataFrame(cells, "row int, col int, height double, floor boolean, below boolean"), step=0.08, edge=0.1)
    assert {(r.row, r.col) for r in found.collect()} == {(r, c) for r in (3, 4) for c in range(5)}
    g = spark.createDataFrame([(r, c, 1, 1, 0.0) for r in range(5) for c in range(5)], "row int, col int, state int, observations int, height double")
    rim = grid.frontiers(g, 0.1).collect()
    assert len(rim) == 1 and rim[0].cells == 16
    assert grid.regions(g, 0.1, 0.2).count() == 25 and grid.regions(g, 0.1, 0.3).count() == 0


def test_depth_edges(spark):
    z = {(r, c): 1.0 if c < 3 else 2.0 for r in range(3) for c in range(6)}
    z[(0, 0)] = None
    rows = spark.createDataFrame([("f", r, c, v) for (r, c), v in z.items()], "frame string, row int, col int, z double")
    edge = {(r.row, r.col) for r in grid.depth_edges(rows, ["frame"], 0.04).where("edge").collect()}
    assert edge == {(r, c) for r in range(3) for c in (2, 3)} | {(0, 1), (1, 0), (1, 1)}


def test_budget(spark):
    pts = spark.createDataFrame([(float(k % 40), float(k // 40), k) for k in range(1600)], "x double, y double, rid int")
    edge = aggregates.budget_edge(pts, ["x", "y"], 100)
    count = lambda e: aggregates.voxel_pick(pts, {"x": e, "y": e}, ["rid"]).count()
    assert count(edge) <= 100 < count(edge / 1.03)
    assert aggregates.budget_edge(pts.limit(5), ["x", "y"], 100) == 0.0
    same = spark.createDataFrame([(1.0, 1.0, k) for k in range(9)], "x double, y double, rid int")
    assert aggregates.budget_edge(same, ["x", "y"], 3) == 0.0
    assert [r.rid for r in aggregates.budgeted(same, ["x", "y"], 3, ["rid"]).collect()] == [0]
    assert aggregates.budgeted(pts.limit(5), ["x", "y"], 100, ["rid"]).count() == 5


def test_equal_values_have_no_spread(spark):
    rows = spark.createDataFrame([("g", 2.0)] * 5, "g string, v double")
    assert aggregates.mad(rows, ["g"], "v").first().sigma == 0.0


def test_finite(spark):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    assert [r[0] for r in rows.select(geometry.finite("x")).collect()] == [True, False, False, False]


def test_affinity_rules(spark):
    make = lambda i, b, d, e, like, cut: spark.range(1).select(objects.affinity(*[F.lit(x) for x in (i, b, d, e)], F.lit(like), F.lit(cut))).first()[0]
    assert make(0.4, 0.2, 9.0, 1.0, True, False) == pytest.approx(0.4)
    assert make(0.9, 0.6, 9.0, 1.0, False, False) is None
    assert make(0.9, 0.8, 9.0, 1.0, False, False) == pytest.approx(0.8)
    assert make(0.5, 0.0, 9.0, 1.0, False, True) == pytest.approx(0.35)
    assert make(0.0, 0.0, 0.0, 1.0, True, False) == pytest.approx(1.0)


def test_gate_is_strict_and_null_passes(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 2.1), (3, None)], "id int, v double")
    assert [r.accepted for r in evaluation.gate(rows, {"v": (F.col("v"), 2.0)}).orderBy("id").collect()] == [True, False, True]


def test_spread_sample_and_interpolation(spark):
    rows = spark.createDataFrame([("g", k, float(k) if k % 4 == 0 else None) for k in range(11)], "g string, k int, v double")
    assert sorted(r.k for r in windows.spread_sample(rows, ["g"], ["k"], 3).collect()) == [0, 5, 10]
    assert {r.k: r.filled for r in windows.interpolated(rows, ["g"], "k", "v").collect()}[6] == 6.0
    assert {r.k: r.filled for r in windows.interpolated(rows, ["g"], "k", "v").collect()}[10] == 8.0


def test_similarity_needs_three_points(spark):
    rows = spark.createDataFrame([("g", 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)] * 2, "g string, ax double, ay double, az double, bx double, by double, bz double")
    assert solvers.similarity(rows, ["g"]).first().scale is None


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 100_000), max_size=30))
def test_rle_text(counts):
    column = pa.array([counts, None, [], counts[::-1]], pa.list_(pa.int32()))
    texts = codecs.rle_texts(column)
    assert codecs.rle_counts(texts).to_pylist() == column.to_pylist() and texts.to_pylist()[1:3] == [None, ""]


def test_rle_fixed_texts():
    # Groups of five bits: 3 -> 3; 40 -> 8 and more, then 1; -3 (the fourth against the second) -> 29 with its sign bit.
    assert codecs.rle_texts(pa.array([[3, 40, 7, 37]])).to_pylist() == ["".join(chr(48 + c) for c in (3, 40, 1, 7, 29))]


def test_mask_runs():
    import numpy as np

    assert codecs.mask_runs(np.array([[0, 1], [0, 1]])) == [2, 2]
    assert codecs.mask_runs(np.array([[1, 0], [1, 0]])) == [0, 2, 2]
    assert codecs.mask_runs(np.zeros((0, 2))) == []


def test_names(spark):
    rows = spark.createDataFrame([("img10",), ("img9",), ("a_b  C",), ("scan-20240102-030405.jpg",)], "n string")
    assert [r.n for r in rows.where("n LIKE 'img%'").orderBy(text.natural_key("n")).collect()] == ["img9", "img10"]
    assert rows.where("n LIKE 'a%'").select(text.normalize_label("n")).first()[0] == "a b c"
    assert str(rows.where("n LIKE 'scan%'").select(text.time_in_name("n")).first()[0]) == "2024-01-02 03:04:05"
    assert rows.where("n = 'img9'").select(text.time_in_name("n")).first()[0] is None


def test_polygon(spark):
    p = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))])
    one = lambda x, y: spark.range(1).select(geometry.in_polygon(F.lit(x), F.lit(y), p)).first()[0]
    assert one(1.0, 1.0) and not one(5.0, 1.0) and not one(-1.0, 4.0)
    assert spark.range(1).select(geometry.polygon_area(p)).first()[0] == 16.0


def test_independent_set(spark):
    from atlasloom.operators import rules

    rng = random.Random(5)
    items = list(range(40))
    pairs = [(a, b) for a in items for b in items if a < b and rng.random() < 0.12]
    kept = []
    for i in items:
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    got = rules.independent_set(spark.createDataFrame([(i,) for i in items], "item int"), spark.createDataFrame(pairs, "a int, b int"))
    assert sorted(r.item for r in got.collect()) == kept


def test_keyframe_scale_needs_a_majority(spark):
    from atlasloom.operators import rules

    rows = spark.createDataFrame([("a", 2.0, 0.1), ("a", 2.02, 0.1), ("a", 9.0, 0.1), ("b", 1.0, 0.1), ("b", 3.0, 0.1)], "g string, s double, e double")
    got = {r.g: r.scale for r in rules.keyframe_scale(rows, ["g"], "s", "e").collect()}
    assert got["a"] == pytest.approx((2.0 * 2.02) ** 0.5) and got["b"] is None


def test_palette_is_stable():
    from atlasloom.operators import rules

    assert rules.palette(5) == rules.palette(9)[:5] and len(set(rules.palette(60))) == 60
