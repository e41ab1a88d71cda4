"""Joins that SQL has no keyword for: by range, nearest, time, place and greedy choice.

Sides are broadcast only by Spark itself, under its size threshold; no hint forces one here.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col, voxel


def bounded_voxel(c, size: float) -> Column:
    """Voxel number of which the neighbours are numbers too, however far the place; infinite places are in the last one."""
    return F.least(F.greatest(voxel(c, size), F.lit(-(1 << 62))), F.lit(1 << 62))


#: Rows of one side in a cell of which a task meets all with another's; more are dealt into blocks of that many.
ROWS_OF_CELL = 20_000


def range_join(a: DataFrame, b: DataFrame, ax: list[str], bx: list[str], radius: float, equal: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """All pairs within the radius, with `distance`: cells of the radius's edge, the neighbours of one side, then the exact test.

    Columns of the two sides must differ; `equal` names columns of both that must be equal too. Rows in the same place are a list
    until near places are found, and the lists are opened where they meet: no pair is shuffled. Lists of `a` are repeated 3^d
    times. Of a cell with over `ROWS_OF_CELL` rows of a side, blocks of both sides meet, so that no task has all of its pairs.
    """
    d = len(ax)
    own, other, keys = [f"_a{i}" for i in range(d)], [f"_b{i}" for i in range(d)], [f"_e{i}" for i in range(len(equal))]
    near = F.array(*[F.array(*[F.col("_c")[i] + (k // 3**i % 3 - 1) for i in range(d)]) for k in range(3**d)])
    cell = lambda names: F.array(*[bounded_voxel(c, radius) for c in names])

    def placed(rows: DataFrame, at: list[str], names: list[str], same: list[str], held: str) -> DataFrame:
        kept = rows.na.drop(subset=at).select(F.struct(*rows.columns).alias(held), *[F.col(c).alias(n) for c, n in zip([*at, *same], [*names, *keys], strict=True)])
        return functools.reduce(lambda x, k: x.where(F.col(k).isNotNull()), keys, kept).withColumn("_c", cell(names))

    at, to = placed(a, ax, own, [x for x, _ in equal], "_l"), placed(b, bx, other, [y for _, y in equal], "_r")
    # Cells of many rows; they are fewer than a row in ROWS_OF_CELL, but for those of neighbours.
    parts = lambda n: F.ceil(F.col(n) / ROWS_OF_CELL).cast("int")
    here, there = (rows.groupBy(*keys, "_c").agg(F.count(F.lit(1)).alias(n)) for rows, n in ((at, "_n"), (to, "_m")))
    met = here.withColumn("_c", F.explode(near)).groupBy(*keys, "_c").agg(F.sum("_n").alias("_n")).join(there, [*keys, "_c"])
    hot = met.where((F.col("_n") > ROWS_OF_CELL) | (F.col("_m") > ROWS_OF_CELL)).select(*keys, "_c", parts("_n").alias("_ka"), parts("_m").alias("_kb")).checkpoint()
    blocks = not hot.isEmpty()
    heaps = here.where(F.col("_n") > ROWS_OF_CELL).select(*keys, "_c", parts("_n").alias("_k"))
    looked = lambda rows, cells: rows.join(F.broadcast(cells), [*keys, "_c"], "left")
    block = lambda c, *of: F.coalesce(F.pmod(F.xxhash64(*of), F.col(c)), F.lit(0)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1))
    # A list holds rows of one block, so that many rows in one place are several lists.
    at = looked(at, heaps.checkpoint()).withColumn("_i", block("_k", "_l")) if blocks else at.withColumn("_i", F.lit(0))
    to = looked(to, hot).withColumn("_v", block("_kb", "_r")) if blocks else to.withColumn("_v", F.lit(0))
    at = at.groupBy(*keys, *own, "_i").agg(F.collect_list("_l").alias("_l")).withColumn("_c", cell(own)).withColumn("_c", F.explode(near))
    to = to.groupBy(*keys, *other, "_v").agg(F.collect_list("_r").alias("_r")).withColumn("_c", cell(other))
    if blocks:
        at = looked(at, hot).withColumn("_u", block("_ka", *own, "_i")).withColumn("_v", every("_kb"))
        to = looked(to, hot).withColumn("_u", every("_ka"))
    else:
        at, to = at.withColumns({"_u": F.lit(0), "_v": F.lit(0)}), to.withColumn("_u", F.lit(0))
    # Rows are few bytes and pairs many: cells are dealt out by number, as tasks merged by bytes would be too few, and never sent to the driver.
    unit, n = [*keys, "_c", "_u", "_v"], int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, to = (rows.select(*unit, *names, held).repartition(n, *unit) for rows, names, held in ((at, own, "_l"), (to, other, "_r")))
    square = sum((F.pow(F.col(x) - F.col(y), F.lit(2.0)) for x, y in zip(own, other, strict=True)), F.lit(0.0))
    pairs = at.hint("merge").join(to, unit).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius).select("distance", "_l", "_r")
    opened = pairs.withColumn("_l", F.explode("_l")).withColumn("_r", F.explode("_r"))
    return opened.select(*[F.col("_l")[c].alias(c) for c in a.columns], *[F.col("_r")[c].alias(c) for c in b.columns], "distance")


def nearest_on_line(a: DataFrame, b: DataFrame, ax: str, bx: str, id: str, radius: float, k: int) -> DataFrame:
    """Rows of `a` with the `k` nearest rows of `b` within the radius: (a's columns, id, distance), ties to the smaller id.

    Work grows with the rows, not with the pairs: cells of the radius's edge also hold the next `k` places of the cells
    beside them, and in the order of a cell the `k` places before and after each row are known. Columns of the two sides differ.
    """
    first = Window.partitionBy(bx).orderBy(id)
    ids = b.where(F.col(bx).isNotNull() & F.col(id).isNotNull()).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k)
    places = ids.groupBy(F.col(bx).alias("_v")).agg(F.collect_list(id).alias("_i")).withColumn("_c", voxel("_v", radius))
    up, down = (Window.partitionBy("_c").orderBy(o) for o in (F.asc("_v"), F.desc("_v")))
    edge = places.withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    held = F.array_compact(F.array(F.col("_c"), F.when(F.col("_u") <= k, F.col("_c") - 1), F.when(F.col("_d") <= k, F.col("_c") + 1)))
    met = edge.select("_v", F.struct("_v", "_i").alias("_p"), F.explode(held).alias("_c"))
    met = met.withColumns({"_l": F.collect_list("_p").over(up.rowsBetween(1 - k, 0)), "_h": F.collect_list("_p").over(down.rowsBetween(1 - k, 0))})
    asked = a.where(F.col(ax).isNotNull()).select(F.col(ax).alias("_v")).distinct().withColumn("_c", voxel("_v", radius))
    both = met.select("_c", "_v", "_l", "_h", F.lit(0).alias("_s")).unionByName(asked.withColumn("_s", F.lit(1)), allowMissingColumns=True)
    # Two orders with frames from the start: a frame to the end would be walked anew for each row.
    back, ahead = (Window.partitionBy("_c").orderBy(o, "_s").rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_v"), F.desc("_v")))
    found = both.withColumn("_l", F.last("_l", ignorenulls=True).over(back)).withColumn("_h", F.last("_h", ignorenulls=True).over(ahead)).where("_s = 1")
    none = F.array().cast(met.schema["_l"].dataType)
    near = F.array_union(F.coalesce("_l", none), F.coalesce("_h", none))
    ranked = F.flatten(F.transform(near, lambda p: F.transform(p["_i"], lambda i: F.struct(F.abs(F.col("_v") - p["_v"]).alias("distance"), i.alias(id)))))
    best = found.select("_v", F.explode(F.slice(F.array_sort(F.filter(ranked, lambda x: x["distance"] <= radius)), 1, k)).alias("_b"))
    return a.join(best, F.col(ax) == F.col("_v")).select(*a.columns, f"_b.{id}", "_b.distance")


#: Rows of a strip of queries, and of the first and the longest strip of vectors, that are one matrix product.
QUERY_STRIP, FIRST_STRIP, VECTOR_STRIP = 1024, 256, 4096


def _block_best(k: int, metric: str, gap: int, query_id: str, vec_id: str):
    digits = 6 if metric == "cosine" else 5

    def run(_key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("i", kind="stable")
        qi, ci = q["i"].to_numpy(), c["i"].to_numpy()
        if not len(qi) or not len(ci):
            return pd.DataFrame({query_id: qi[:0], vec_id: ci[:0], "score": np.zeros(0)})
        x, y = (np.stack(d["v"].to_numpy()).astype(np.float64) for d in (q, c))
        if metric == "cosine":
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12) for v in (x, y))
        else:
            xx, yy = ((v * v).sum(1) for v in (x, y))
        near, far = np.searchsorted(ci, qi - gap, "left"), np.searchsorted(ci, qi + gap, "right")
        out = []
        for at in range(0, len(qi), QUERY_STRIP):
            to = min(at + QUERY_STRIP, len(qi))
            # The best so far, by row: candidates of equal scores have larger ids strip by strip, so they must score more to enter.
            row, col, best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            bound = np.full(to - at, -np.inf)
            lo, width = 0, FIRST_STRIP
            while lo < len(ci):
                hi = min(lo + width, len(ci))
                score = x[at:to] @ y[lo:hi].T
                if metric != "cosine":
                    score *= -2
                    score += xx[at:to, None] + yy[None, lo:hi]
                    np.negative(score, out=score)
                for r in np.flatnonzero((near[at:to] < hi) & (far[at:to] > lo)):
                    score[r, max(0, near[at + r] - lo) : max(0, far[at + r] - lo)] = -np.inf
                r, v = np.nonzero(score > bound[:, None])
                s = score[r, v]
                s = np.round(s, digits) if metric == "cosine" else -np.round(np.sqrt(np.maximum(-s, 0)), digits)
                keep = np.isfinite(s)
                row, col, best = np.append(row, r[keep]), np.append(col, v[keep] + lo), np.append(best, s[keep])
                order = np.lexsort((col, -best, row))
                row, col, best = row[order], col[order], best[order]
                first = np.searchsorted(row, np.arange(to - at))
                rank = np.arange(len(row)) - first[row]
                row, col, best, last = row[rank < k], col[rank < k], best[rank < k], rank[rank < k] == k - 1
                # A product a little under the last of the best may still round up to more than it; one at half a unit under can't.
                least = best[last] + 10.0**-digits * 0.25
                bound[row[last]] = least if metric == "cosine" else -np.square(np.minimum(least, 0.0))
                lo, width = hi, min(width * 4, VECTOR_STRIP)
            out.append(pd.DataFrame({query_id: qi[at + row], vec_id: ci[col], "score": best}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest_vectors(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", gap: int = 0, id: str = "vec_id", vector: str = "embedding", block_rows: int = 8192) -> DataFrame:
    """Exact k best of all vectors for each query: (query_id, vec_id, score, rank); ids at most `gap` apart are left out, ties go to the smaller id.

    Both sides are dealt into blocks; each pair of blocks is matrix products in strips, of which k rows per query go on. Within a
    block what can't be among a query's best so far is left after one comparison, so only a few scores are rounded and sorted.
    """
    n_q, n_v = (max(1, math.ceil(d.count() / block_rows)) for d in (queries, vectors))
    side = lambda d, n: d.select(F.col(id).alias("i"), F.col(vector).alias("v"), F.pmod(F.xxhash64(id), F.lit(n)).alias("b"))
    q = side(queries, n_q).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))).groupBy("b", "c")
    v = side(vectors, n_v).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("i", "v", F.col("c").cast("long").alias("b"), F.col("b").cast("int").alias("c")).groupBy("b", "c")
    best = q.cogroup(v).applyInPandas(_block_best(k, metric, gap, "query_id", "vec_id"), "query_id bigint, vec_id bigint, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pair_set(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct undirected pairs (lo, hi) without pairs of a row with itself."""
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).distinct()


def ratio_test(best: DataFrame, ratio: float = 0.8, distance: str = "distance") -> DataFrame:
    """Matches whose distance is below the ratio of the second best one's, one per target (the closest)."""
    w = Window.partitionBy("query_id").orderBy(distance, "vec_id")
    two = best.withColumn("_r", F.row_number().over(w)).withColumn("_second", F.lead(distance).over(w))
    sound = two.where((F.col("_r") == 1) & (F.col(distance) < ratio * F.col("_second")))
    t = Window.partitionBy("vec_id").orderBy(distance, "query_id")
    return sound.withColumn("_t", F.row_number().over(t)).where("_t = 1").select("query_id", "vec_id", distance)


def sequential_pairs(rows: DataFrame, order: str, by: list[str], overlap: int) -> DataFrame:
    """Each row with the next `overlap` rows of its group: (a, b)."""
    w = Window.partitionBy(*by).orderBy(order)
    ahead = rows.withColumn("_next", F.array(*[F.lead(order, k).over(w) for k in range(1, overlap + 1)]))
    return ahead.select(*by, F.col(order).alias("a"), F.explode(F.array_compact("_next")).alias("b"))


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, value: str, direction: str = "backward") -> DataFrame:
    """`left` with the value of the nearest row of `right` before or at its time, or on either side with ties to the earlier one.

    One union and one sort per group, without a join; null where there is no such row.
    """
    l = left.withColumns({"_t": F.col(left_time).cast("timestamp_ntz"), "_s": F.lit(None).cast("struct<t:timestamp_ntz,v:double>"), "_side": F.lit(1)})
    r = right.select(*by, F.col(right_time).cast("timestamp_ntz").alias("_t"), F.struct(F.col(right_time).cast("timestamp_ntz").alias("t"), F.col(value).cast("double").alias("v")).alias("_s"), F.lit(0).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = Window.partitionBy(*by).orderBy("_t", "_side", "_s").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_b", F.last("_s", ignorenulls=True).over(back))
    if direction == "nearest":
        ahead = Window.partitionBy(*by).orderBy("_t", "_side", "_s").rowsBetween(0, Window.unboundedFollowing)
        out = out.withColumn("_a", F.first("_s", ignorenulls=True).over(ahead))
        # Differences of times without a zone, so the session's zone and its clock changes don't matter.
        to_back, to_ahead = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
        out = out.withColumn("_b", F.when(F.col("_b").isNull() | (to_ahead < to_back), F.col("_a")).otherwise(F.col("_b")))
    return out.where("_side = 1").select(*left.columns, F.col("_b.t").alias("matched_time"), F.col("_b.v").alias("matched"))


def interval_best(left: DataFrame, right: DataFrame, by: list[str], lo: str, hi: str, time: str, cost: Column, take: str) -> DataFrame:
    """`left` with the `take` of the right row of least cost whose time lies in [lo, hi]; null for an empty window.

    Equal rows of `left` have equal answers, so the rows themselves are the key; those with nulls meet each other too.
    """
    own = left.columns
    rows = left.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"))
    j = rows.join(right, by).where(F.col(time).between(F.col(lo), F.col(hi)))
    best = j.groupBy(*own).agg(F.min_by(take, F.struct(cost.alias("c"), F.col(time), F.col(take))).alias("best")).select(F.struct(*own).alias("_own"), "best")
    out = rows.join(best, F.struct(*own).eqNullSafe(F.col("_own")), "left")
    return out.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("_n").cast("int")))).select(*own, "best")


def contained(points: DataFrame, areas: DataFrame, inside: Column, x: str, y: str, box: tuple[str, str, str, str], cell: float) -> DataFrame:
    """Points in areas: both in cells of a bounding-box grid, then the exact test. Columns of the two sides must differ."""
    tiles = areas.withColumn("_x", F.explode(F.sequence(voxel(box[0], cell), voxel(box[2], cell)))).withColumn("_y", F.explode(F.sequence(voxel(box[1], cell), voxel(box[3], cell))))
    return points.withColumns({"_x": voxel(x, cell), "_y": voxel(y, cell)}).join(tiles, ["_x", "_y"]).where(inside).drop("_x", "_y")


def nearest_visible(points: DataFrame, pixel: list[str], depth: str, tolerance: float = 0.05) -> DataFrame:
    """Points within the tolerance of the nearest depth of their pixel."""
    least = points.groupBy(*pixel).agg(F.min(depth).alias("_least"))
    return points.join(least, pixel).where(F.col(depth) <= F.col("_least") * (1 + tolerance)).drop("_least")


def _greedy(a: str, b: str, score: str):
    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            order = sorted(range(len(t[a])), key=lambda k: (-t[score][k], t[a][k], t[b][k]))
            used_a, used_b, keep = set(), set(), []
            for k in order:
                if t[a][k] not in used_a and t[b][k] not in used_b:
                    used_a.add(t[a][k])
                    used_b.add(t[b][k])
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return run


def greedy_match(pairs: DataFrame, by: list[str], a: str, b: str, score: str) -> DataFrame:
    """One-to-one pairs per group, best score first, ties by the ids.

    Rounds in Spark instead of a loop over a group: a pair that is the best of both its sides is taken, and the pairs
    that touch it go. Each round settles at least the best pair of every group.
    """
    left = pairs.select(*by, a, b, score)
    taken = left.limit(0)
    order = lambda side: Window.partitionBy(*by, side).orderBy(F.desc(score), F.asc(a), F.asc(b))
    while True:
        best = left.withColumns({"_a": F.row_number().over(order(a)), "_b": F.row_number().over(order(b))}).where("_a = 1 AND _b = 1").select(*by, a, b, score).checkpoint()
        if best.isEmpty():
            return taken
        taken = taken.union(best)
        left = left.join(best.select(*by, a), [*by, a], "left_anti").join(best.select(*by, b), [*by, b], "left_anti").checkpoint()


def exclusive_owner(claims: DataFrame, pixel: list[str], order: list) -> DataFrame:
    """Each pixel's first claim in a total order."""
    w = Window.partitionBy(*pixel).orderBy(*order)
    return claims.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_of_duplicates(rows: DataFrame, key: list, order: list) -> DataFrame:
    """Rows with `duplicate`: false for the first of each key in order."""
    w = Window.partitionBy(*[col(k) for k in key]).orderBy(*order)
    return rows.withColumn("duplicate", F.row_number().over(w) > 1)
