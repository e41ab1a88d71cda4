"""What the projections to 6 GB showed: work that grows with pairs, groups in one task, tables that move in each step."""

import numpy as np
import pytest

from atlasloom.operators import rules
from atlasloom.plans.base import checkpoint_folder


@pytest.fixture(autouse=True)
def checkpoints(spark):
    checkpoint_folder(spark)


def test_places_are_kept_in_order(spark):
    rng = np.random.default_rng(7)
    at = [float(v) for v in np.round(rng.uniform(-40, 40, 300), 1)] + [None, float("nan"), float("inf"), float("inf"), 3.0, 3.0, -80.0, -75.0]
    order = [int(i) for i in rng.permutation(len(at))]
    rows = list(zip(order, at, strict=True))
    for radius in (0.05, 5.0, 500.0):
        kept = []
        for i, x in sorted(rows, key=lambda r: r[0]):
            if x is None or not any(y is not None and abs(x - y) <= radius for _, y in kept):
                kept.append((i, x))
        got = rules.independent_places(spark.createDataFrame(rows, "i int, x double"), "i", "x", radius)
        assert sorted(r.i for r in got.collect()) == [i for i, _ in kept]


def test_places_kept_make_no_pairs(spark, monkeypatch):
    """In a crowd in reach of one place, a join of pairs would be its square."""
    from atlasloom.operators import joins
    from atlasloom.plans import catalogue

    monkeypatch.setattr(joins, "range_join", None)
    rows = spark.range(500).selectExpr("id AS s_suppkey", "id / 10.0D AS s_acctbal")
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, path: rows)
    assert [r[0] for r in catalogue.QUERIES["independent_set"](spark, "/none").collect()] == [0]


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_few_scores_of_a_block_are_sorted(monkeypatch, metric):
    """The best of a block, with many copies and ids left out; what can't be among the best is neither rounded nor sorted."""
    import pandas as pd

    from atlasloom.operators import joins

    rng = np.random.default_rng(2)
    v = rng.normal(size=(1500, 8)).astype(np.float32)
    v[rng.integers(0, 1500, 700)] = v[3]
    ids = rng.permutation(1500).astype(np.int64)
    rows = pd.DataFrame({"i": ids, "v": list(v)})
    seen, sort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: seen.append(np.broadcast(*keys).size) or sort(keys))
    got = joins._block_best(4, metric, 5, "q", "i")(None, rows.head(400), rows)
    assert sum(seen) < 400 * 1500 / 2
    x = v.astype(np.float64)
    if metric == "cosine":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        score = np.round(x[:400] @ x.T, 6)
    else:
        score = -np.round(np.sqrt(np.maximum((x[:400] ** 2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * (x[:400] @ x.T), 0)), 5)
    want = {}
    for a in range(400):
        order = sorted((-score[a, b], ids[b]) for b in range(1500) if abs(ids[a] - ids[b]) > 5)[:4]
        want[ids[a]] = [(i, round(-s, 6)) for s, i in order]
    found = {q: [(r.i, round(r.score, 6)) for r in g.itertuples()] for q, g in got.groupby("q")}
    same = sum(found[q] == want[q] for q in want)
    assert same >= 398 and all([s for _, s in found[q]] == pytest.approx([s for _, s in want[q]], abs=2e-5) for q in want)


def test_adjustment_makes_no_blocks_of_frames(spark, monkeypatch):
    """Only sums by frame are shuffled in a step: no grouping by two frames, which is as many rows as the bins."""
    import math

    from atlasloom.operators import adjustment as A

    frames = spark.range(6).selectExpr("id AS frame", "0.1D AS pivot", "id = 0 AS fixed", "false AS held")
    rows = [(i, j, float(j - i), 0.1 + 0.2 * k, 0.1, 1.0) for i in range(6) for j in range(6) for k in range(2)]
    bins = spark.createDataFrame(rows, "src long, dst long, ratio double, log_src double, log_dst double, weight double")
    plans, cut = [], A._cut
    monkeypatch.setattr(A, "_cut", lambda df, folder: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df, folder))
    got = {r.frame: (round(r.a, 6), round(r.b, 6)) for r in A.adjusted(bins, frames, losses=(math.inf,), ridge=0.0, prior=0.0).collect()}
    assert got == {i: (float(i), 0.0) for i in range(6)}
    keys = [line.split("Aggregate [")[1].split("]")[0] for p in plans for line in p.splitlines() if "Aggregate [" in line]
    assert keys and all("," not in k for k in keys), keys


def test_pairs_of_frames_are_dealt_by_their_number(spark, monkeypatch):
    from atlasloom.operators import matching

    monkeypatch.setattr(matching, "PAIRS_OF_TASK", 50)
    rows = [(f, p) for p in range(20) for f in range(p % 6 + 1)] * 2 + [(None, 1), (3, None)]
    out = matching.covisible(spark.createDataFrame(rows, "frame int, point int"), least=2)
    want = {(a, b): n for a in range(6) for b in range(a + 1, 6) if (n := sum(p % 6 >= b for p in range(20))) >= 2}
    assert {(r.a, r.b): r.shared for r in out.collect()} == want
    pairs = sum((p % 6 + 1) * (p % 6) // 2 for p in range(20))
    assert f"RepartitionByExpression [point#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and f"], {-(-pairs // 50)}" in plan


def test_suppression_meets_a_batch_at_once(spark):
    """Kept boxes as one after another, over frames larger than a batch; a box with a null is near nothing and stays."""
    from atlasloom.operators import objects

    rng = np.random.default_rng(4)
    rows = [(int(f), "a", float(i), *map(float, (x, y, x + w, y + h))) for i, (f, x, y, w, h) in enumerate(zip(rng.integers(0, 3, 900), *rng.integers(0, 12, (2, 900)), *rng.integers(0, 9, (2, 900)), strict=True))]
    rows.append((0, "a", 9999.0, None, 1.0, 2.0, 3.0))
    kept = []
    for r in sorted(rows[:-1], key=lambda r: -r[2]):
        for q in kept:
            w, h = min(r[5], q[5]) - max(r[3], q[3]), min(r[6], q[6]) - max(r[4], q[4])
            if q[0] == r[0] and w > 0 and h > 0 and w * h / ((r[5] - r[3]) * (r[6] - r[4]) + (q[5] - q[3]) * (q[6] - q[4]) - w * h) > 0.5:
                break
        else:
            kept.append(r)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = objects.suppressed(spark.createDataFrame(rows, "frame int, label string, score double, x0 double, y0 double, x1 double, y1 double"), "frame", 0.5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {tuple(r) for r in got} == {*kept, rows[-1]} and len(got) == len(kept) + 1


@pytest.mark.parametrize("stretch", [2, 4096])
def test_walls_grow_by_stretches_of_lines(spark, monkeypatch, stretch):
    """No line of cells and no large piece meets in one task."""
    from atlasloom.operators import grid

    monkeypatch.setattr(grid, "STRETCH", stretch)
    rng = np.random.default_rng(6)
    cells = {(int(r), int(c)) for r, c in rng.integers(-9, 9, (90, 2))} | {(r, c) for r in range(-20, 20) for c in (12, 13, 14, 20)}
    ways = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    want = {(r - i, c - j) for r, c in cells for i, j in ways if not all((r + m * i, c + m * j) in cells for m in range(4))}
    wall = spark.createDataFrame(sorted(cells), "row int, col int")
    assert {tuple(r) for r in grid._thin_sides(wall, 4).collect()} == want
    piece = wall.selectExpr("row", "col", "0 AS root_row", "IF(col < 11, 0, col) AS root_col")
    wanted = piece.groupBy("root_row", "root_col").agg({"*": "count"}).withColumnRenamed("count(1)", "_n").where("root_col <> 20")
    assert {tuple(r) for r in grid._of_pieces(piece, wanted).collect()} == {p for p in cells if p[1] != 20}


def _joins(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count("Join ")


def test_pairs_in_reach_are_not_shuffled(spark, monkeypatch):
    """Rows meet once and pairs are opened there, also where blocks of a crowded cell meet."""
    from atlasloom.operators import joins

    rng = np.random.default_rng(9)
    a = [(i, int(i % 3) or None, *map(float, p)) for i, p in enumerate(np.vstack([rng.integers(-4, 5, (60, 2)), np.zeros((20, 2))]))]
    b = [(i, int(i % 2) + 1, *map(float, p)) for i, p in enumerate(np.vstack([rng.integers(-4, 5, (50, 2)), np.ones((30, 2))]))]
    a, b = [*a, (80, 1, float("inf"), 0.0), (81, 1, 1e300, 0.0)], [*b, (80, 1, float("inf"), 0.0), (81, 1, 1e300, 0.0)]
    left, right = spark.createDataFrame(a, "i int, g int, x double, y double"), spark.createDataFrame(b, "j int, h int, u double, v double")
    near = {(i, j) for i, _, x, y in a for j, _, u, v in b if np.hypot(x - u, y - v) <= 1.5}
    alike = {(i, j) for i, j in near if a[i][1] == b[j][1]}
    assert _joins(joins.range_join(left, right, ["x", "y"], ["u", "v"], 1.5)) == 1
    for most in (20_000, 3):
        monkeypatch.setattr(joins, "ROWS_OF_CELL", most)
        for equal, want in (((), near), ((("g", "h"),), alike)):
            got = [(r.i, r.j) for r in joins.range_join(left, right, ["x", "y"], ["u", "v"], 1.5, equal).collect()]
            assert sorted(got) == sorted(want)


def test_pairs_of_boxes_are_not_shuffled(spark, monkeypatch):
    from atlasloom.operators import objects

    rng = np.random.default_rng(10)
    boxes = [(int(f), f"b{i}", float(x), float(y), float(x + 10), float(y + 5)) for i, (f, x, y) in enumerate(zip(rng.integers(0, 2, 90), *rng.integers(0, 4, (2, 90)), strict=True))]
    rows = spark.createDataFrame(boxes, "f int, i string, x0 double, y0 double, x1 double, y1 double")
    want = set()
    for f, i, *a in boxes:
        for g, j, *b in boxes:
            both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            want |= {(f, i, j)} if f == g and i < j and both / (100 - both) >= 0.5 else set()
    assert _joins(objects.overlapping(rows, "f", "i", 0.5)) == 1
    for most in (100_000, 8):
        monkeypatch.setattr(objects, "BOXES_OF_TASK", most)
        got = [(r.f, r.i, r.i_b) for r in objects.overlapping(rows, "f", "i", 0.5).collect()]
        assert sorted(got) == sorted(want)


def test_ratios_of_large_groups_are_ranked_by_counting(spark, monkeypatch):
    """No task holds the values of a large group; a group with an infinite ratio is still ranked, one without a key has no row."""
    from atlasloom.operators import aggregates

    monkeypatch.setattr(aggregates, "RATIOS_OF_TASK", 40)
    rng = np.random.default_rng(11)
    rows = [(g, float(np.exp(v)), 2.0) for g, n in (("a", 301), ("b", 200), ("few", 9)) for v in np.append(rng.normal(size=n), [9.0, -9.0])]
    table = spark.createDataFrame([*rows, (None, 1.0, 1.0), ("a", -1.0, 1.0), ("odd", float("inf"), 1.0), ("odd", 3.0, 1.0), ("odd", 3.0, 1.0)], "g string, t double, b double")
    got = {r.g: r for r in aggregates.robust_ratio(table, ["g"], "t", "b").collect()}
    assert set(got) == {"a", "b", "few", "odd"} and got["odd"].n == 2 and got["odd"].ratio == pytest.approx(3.0)
    for g in ("a", "b", "few"):
        logs = np.log([t / b for k, t, b in rows if k == g])
        off = np.abs(logs - np.median(logs))
        kept = logs[off <= 3 * 1.4826 * np.median(off) + 1e-9]
        assert got[g].n == len(kept) and got[g].ratio == pytest.approx(float(np.exp(np.median(kept))))


def test_supports_make_no_row_for_a_candidate(spark, monkeypatch):
    """The nearest level, then the largest area, then the first surface; near ones first, far ones for what has none, long lists in parts."""
    from atlasloom.operators import objects

    rng = np.random.default_rng(12)
    tops = [(i, float(h), a, float(x), 0.0, float(x + w), 1.0) for i, (h, x, w) in enumerate(zip(np.round(rng.uniform(0, 3, 120), 3), *rng.integers(0, 3, (2, 120)), strict=True)) for a in [[1.0, 2.0, None, float("nan")][i % 4]]]
    items = [(i, float(x) + 0.5, 0.5, float(h)) for i, (x, h) in enumerate(zip(rng.integers(0, 4, 200), np.round(rng.uniform(0, 4, 200), 3), strict=True))]
    tops += [(200 + i, h, 1.0, 0.0, 0.0, 4.0, 1.0) for i, h in enumerate((float("inf"), -float("inf"), float("nan"), 1e300))]
    items += [(200 + i, 0.5, 0.5, z) for i, z in enumerate((float("inf"), -float("inf"), 1e300, -1e300))]
    left, right = spark.createDataFrame(items, "id int, x double, y double, bottom double"), spark.createDataFrame(tops, "sid int, height double, area double, x0 double, y0 double, x1 double, y1 double")
    largest = lambda a: float("inf") if a is None else -float("inf") if a != a else -a
    want = {}
    for i, x, _, z in items:
        near = [(round(abs(z - h) + 1e-12, 2), largest(a), s) for s, h, a, x0, _, x1, _ in tops if x0 <= x <= x1 and -0.05 <= z - h <= 0.3]
        want |= {i: min(near)[2]} if near else {}
    for most in (20_000, 2):
        monkeypatch.setattr(objects, "SURFACES_OF_LIST", most)
        out = objects.supports(left, right, reach=0.3)
        assert {r.id: r.sid for r in out.collect()} == want and 0 < len(want) < 200 and want[202] == 203
        assert "_x" not in out.columns and "array_min" in out._jdf.queryExecution().optimizedPlan().toString()
