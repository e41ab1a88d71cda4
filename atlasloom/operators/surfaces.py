"""Exact nearest places by tiles, and the normals of point clouds and depth grids."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from atlasloom.functions.geometry import dot, finite, norm, rotate, unproject
from atlasloom.operators.graph import _cut

#: Places of a tile, at most, on each level; a tile of one level is cut into those of the next.
TILES = (8192, 1024, 128)
#: Places that one task cuts into tiles.
SLAB = 32_768
AXES = ("x", "y", "z")


def _known(rows: DataFrame, by: list[str]) -> DataFrame:
    keep = finite(*AXES)
    for c in by:
        keep = keep & F.col(c).isNotNull()
    return rows.where(keep)


def places(points: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, x, y, z, n): each place once with its number of points; points that are not finite have none."""
    return _known(points, by).groupBy(*by, *[F.col(c).cast("double").alias(c) for c in AXES]).agg(F.count(F.lit(1)).alias("n"))


def _tiles(rows: DataFrame, by: list[str], folder: str | None) -> DataFrame:
    """Places in tiles: (by, t0 to t2: a tile's number on each level, lo and hi by axis, c: its points, xs, ys, zs, ns: its places by x, y, z).

    Places are dealt out in ranges of x, y, z, and each range is halved along its wider axis, so tiles follow the density.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    ends = [f"{end}_{c}" for c in AXES for end in ("lo", "hi")]

    def cut(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        at, n = pdf[list(AXES)].to_numpy(float).reshape(-1, 3), pdf["n"].to_numpy(np.int64)
        first, made = TaskContext.get().partitionId() << 32, itertools.count()
        groups = pdf.groupby(by, sort=False).indices.values() if by else [np.arange(len(pdf))]
        todo = [(np.asarray(g), [None] * len(TILES)) for g in groups if len(g)]
        out = []
        while todo:
            mine, ids = todo.pop()
            ids = [first + next(made) if i is None and len(mine) <= most else i for i, most in zip(ids, TILES, strict=True)]
            lo, hi = at[mine].min(axis=0), at[mine].max(axis=0)
            if ids[-1] is None:
                mine = mine[np.argsort(at[mine, (hi / 2 - lo / 2).argmax()], kind="stable")]
                todo += [(mine[: len(mine) // 2], ids), (mine[len(mine) // 2 :], ids)]
                continue
            mine = mine[np.lexsort(at[mine].T[::-1])]
            out.append([*pdf.loc[mine[0], by], *ids, *np.stack([lo, hi], 1).ravel(), n[mine].sum(), *at[mine].T, n[mine]])
        yield pd.DataFrame(out, columns=[*by, *levels, *ends, "c", "xs", "ys", "zs", "ns"])

    levels = [f"t{i}" for i in range(len(TILES))]
    dealt = rows.select(*by, *AXES, F.col("n").cast("long").alias("n")).repartitionByRange(max(1, math.ceil(rows.count() / SLAB)), *by, *AXES)
    schema = [*[f"`{c}` {kinds[c]}" for c in by], *[f"{c} bigint" for c in levels], *[f"{c} double" for c in ends], "c bigint, xs array<double>, ys array<double>, zs array<double>, ns array<bigint>"]
    return _cut(dealt.mapInPandas(cut, ", ".join(schema)), folder)


def _near_tiles(asked: DataFrame, held: DataFrame, by: list[str], folder: str | None) -> DataFrame:
    """(q, a, near, first): for each tile of `asked` the tiles of `held` that can hold one of the `need` points nearest to its places, level by level.

    `near` is the least squared distance of the two boxes. The tiles with `first` hold enough points; whatever is farther
    than all of theirs can be is left out.
    """
    pairs = None
    for level, up in zip(range(len(TILES)), [None, *range(len(TILES))]):
        heads = []
        for side, tiles in (("q", asked), ("a", held)):
            keys = by if up is None else [f"t{up}"]
            box = [f(f"{end}_{c}").alias(f"{side}_{end}_{c}") for c in AXES for end, f in (("lo", F.min), ("hi", F.max))]
            own = tiles.groupBy(*keys, F.col(f"t{level}").alias(side)).agg(*box, F.sum("c").alias(f"{side}_c"), *([F.first(F.col("need")).alias("need")] if side == "q" else []))
            heads.append(own if up is None else own.withColumnRenamed(f"t{up}", f"{side}_up"))
        if up is None:
            pairs = heads[0].join(heads[1], by) if by else heads[0].crossJoin(heads[1])
        else:
            pairs = pairs.select(F.col("q").alias("q_up"), F.col("a").alias("a_up")).join(heads[0], "q_up").join(heads[1], "a_up")
        gap, span = F.lit(0.0), F.lit(0.0)
        for c in AXES:
            gap = gap + F.pow(F.greatest(F.lit(0.0), F.col(f"a_lo_{c}") - F.col(f"q_hi_{c}"), F.col(f"q_lo_{c}") - F.col(f"a_hi_{c}")), F.lit(2.0))
            span = span + F.pow(F.greatest(F.col(f"a_hi_{c}") - F.col(f"q_lo_{c}"), F.col(f"q_hi_{c}") - F.col(f"a_lo_{c}")), F.lit(2.0))
        pairs = pairs.select("q", "a", "need", "a_c", gap.alias("near"), span.alias("far"))
        before = F.coalesce(F.sum("a_c").over(Window.partitionBy("q").orderBy("far", "a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        pairs = pairs.withColumn("first", before < F.col("need"))
        pairs = pairs.withColumn("_reach", F.max(F.when(F.col("first"), F.col("far"))).over(Window.partitionBy("q"))).where("near <= _reach")
        pairs = _cut(pairs.select("q", "a", "near", "first"), folder)
    return pairs


def _meet(k: int, by: list[str], bounds: bool):
    """Tiles in the order of q and `near`, first the one that asks (`near` -1), then those it meets: the nearest `k` places of each place, or how far the tile must look."""

    def bound(best, need):
        full = np.cumsum(best[4], axis=1) >= need
        return np.where(full[:, -1], best[0][np.arange(len(full)), full.argmax(axis=1)], np.inf)

    def result(tile, at, best):
        if bounds:
            return pd.DataFrame({"q": [tile["q"]], "reach": [bound(best, tile["need"]).max()]})
        out = pd.DataFrame({c: [tile[c]] * len(at) for c in [*by, "need"]} | dict(zip(AXES, at.T, strict=True)))
        held = best[4] > 0
        return out.assign(**{c: [row[keep] for row, keep in zip(values, held)] for c, values in zip(("d2", "xs", "ys", "zs", "ns"), best, strict=True)})

    def meet(batches):
        tile = at = best = reach = None
        for pdf in batches:
            for row in pdf.to_dict("records"):
                there = np.stack([row["xs"], row["ys"], row["zs"]])
                if row["near"] < 0:
                    if tile is not None:
                        yield result(tile, at, best)
                    tile, at = row, there.T
                    best = [np.full((len(at), k), np.inf) for _ in range(4)] + [np.zeros((len(at), k), np.int64)]
                    reach = bound(best, tile["need"])
                    continue
                if row["near"] > reach.max():
                    continue
                d2 = sum((at[:, i, None] - there[i]) ** 2 for i in range(3))
                mine = np.flatnonzero((d2 <= reach[:, None]).any(axis=1))
                if not len(mine):
                    continue
                d2 = d2[mine]
                # Places of a tile stand by x, y, z, which a stable sort keeps among equal distances.
                order = np.argsort(d2, axis=1, kind="stable")[:, :k]
                new = [np.take_along_axis(d2, order, 1), *[v[order] for v in (*there, np.asarray(row["ns"]))]]
                both = [np.concatenate([old[mine], fresh], axis=1) for old, fresh in zip(best, new, strict=True)]
                order = np.lexsort(both[3::-1], axis=-1)[:, :k]
                for old, values in zip(best, both, strict=True):
                    old[mine] = np.take_along_axis(values, order, 1)
                reach[mine] = bound([v[mine] for v in best], tile["need"])
        if tile is not None:
            yield result(tile, at, best)

    return meet


def nearest_places(queries: DataFrame, at: DataFrame, k: int, edge: float | None = None, by: list[str] = [], folder: str | None = None) -> DataFrame:
    """(by, x, y, z, near): for each place of `queries` the exact nearest ones of `at` that hold `k` points, nearest first.

    `near` is an array of (d2, x, y, z, n): squared distance, place, points counted there; the last is counted in part where
    it holds more than are wanted. Ties go to the smaller x, y, z. A group of fewer than `k` points gives all of them, one
    of none gives no row.

    Both sides are cut into tiles that follow their density, so no scale has to be given (`edge` is of no use any more). A tile
    first meets those that surely hold enough points, which says how far its places must look, and then all that reach
    so far, nearest first. A task holds two tiles at a time, wherever the queries lie.
    """
    at = _cut(at.select(*by, *AXES, "n"), folder)
    need = at.groupBy(*by).agg(F.sum("n").alias("all")).where("all > 0").select(*by, F.least("all", F.lit(k)).alias("need"))
    asked = _cut(queries.select(*by, *AXES).distinct().withColumn("n", F.lit(1)), folder)
    held, asked = _tiles(at, by, folder), _tiles(asked, by, folder)
    asked = asked.join(need, by) if by else asked.crossJoin(need)
    pairs = _near_tiles(asked, held, by, folder)
    leaf, kinds = f"t{len(TILES) - 1}", {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    packed, keys = ["xs", "ys", "zs", "ns"], [f"`{c}` {kinds[c]}" for c in by]
    askers = asked.select(F.col(leaf).alias("q"), F.lit(-1.0).alias("near"), *by, "need", *packed)
    there = held.select(F.col(leaf).alias("a"), *packed)

    def met(rows: DataFrame, bounds: bool, schema: str) -> DataFrame:
        tiles = rows.join(there, "a").select("q", "near", *packed)
        stream = askers.unionByName(tiles, allowMissingColumns=True).repartition("q").sortWithinPartitions("q", "near")
        return stream.mapInPandas(_meet(k, by, bounds), schema)

    reach = met(pairs.where("first"), True, "q bigint, reach double")
    rows = met(pairs.join(reach, "q").where("near <= reach"), False, ", ".join([*keys, "need bigint, x double, y double, z double, d2 array<double>, xs array<double>, ys array<double>, zs array<double>, ns array<bigint>"]))
    before = lambda i: F.aggregate(F.slice("ns", 1, i), F.lit(0).cast("long"), lambda s, n: s + n)
    counted = F.transform("d2", lambda d, i: F.struct(d.alias("d2"), *[F.get(f"{c}s", i).alias(c) for c in AXES], F.least(F.get("ns", i), F.col("need") - before(i)).alias("n")))
    return _cut(rows.withColumn("near", F.filter(counted, lambda p: p["n"] > 0)).select(*by, *AXES, "near"), folder)


@F.pandas_udf(ArrayType(DoubleType()))
def _least_axis(c: pd.Series) -> pd.Series:
    """Unit eigenvector of the smallest eigenvalue of matrices given as (xx, xy, xz, yy, yz, zz)."""
    if not len(c):
        return pd.Series([], dtype=object)
    m = np.stack(c.to_numpy())[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
    return pd.Series(list(np.linalg.eigh(m)[1][:, :, 0]))


def _spread(near: str) -> tuple[dict[str, Column], Column]:
    """Mean by axis, and covariance (xx, xy, xz, yy, yz, zz) about the columns `_mx`, `_my`, `_mz`, of neighbours with their counts."""
    total = lambda f: F.aggregate(near, F.lit(0.0), lambda s, p: s + f(p) * p["n"])
    count, out = total(lambda p: F.lit(1.0)), []
    mean = {a: total(lambda p, a=a: p[a]) / count for a in AXES}
    for a, b in itertools.combinations_with_replacement(AXES, 2):
        out.append(total(lambda p, a=a, b=b: (p[a] - F.col(f"_m{a}")) * (p[b] - F.col(f"_m{b}"))) / count)
    return mean, F.array(*out)


def point_normals(points: DataFrame, viewpoints: DataFrame | None = None, k: int = 16, edge: float = 0.1, by: list[str] = [], folder: str | None = None) -> DataFrame:
    """Points with `normal`, the direction in which their `k` nearest points (themselves included) spread least, and `residual`, the spread along it in metres.

    Normals look towards the nearest of `viewpoints` (by, x, y, z), or towards the origin where there is none. Equal points
    count each and share a normal. A point that is not finite, or has a null group, has a null normal and residual.
    """
    at = places(points, by)
    near = nearest_places(at, at, k, edge, by, folder)
    mean, cov = _spread("near")
    out = near.withColumns({f"_m{a}": m for a, m in mean.items()}).withColumn("cov", cov).withColumn("axis", _least_axis("cov"))
    full = F.array(*[F.col("cov")[i] for i in (0, 1, 2, 1, 3, 4, 2, 4, 5)])
    out = out.withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), dot("axis", rotate(full, "axis"))))).select(*by, *AXES, "axis", "residual")
    eye = F.array(*[F.lit(0.0)] * 3)
    if viewpoints is None:
        out = out.withColumn("eye", eye)
    else:
        views = nearest_places(at, places(viewpoints, by), 1, edge, by, folder).select(*by, *AXES, F.array(*[F.col("near")[0][c] for c in AXES]).alias("eye"))
        out = out.join(views, [*by, *AXES], "left").withColumn("eye", F.coalesce("eye", eye))
    towards = dot("axis", F.array(*[F.col("eye")[i] - F.col(c) for i, c in enumerate(AXES)]))
    turned = out.select(*by, *[F.col(c).alias(f"_{c}") for c in AXES], F.when(towards < 0, F.transform("axis", lambda v: -v)).otherwise(F.col("axis")).alias("normal"), "residual")
    same = [points[c] == turned[c] for c in by] + [points[c].cast("double") == turned[f"_{c}"] for c in AXES]
    return points.join(turned, same, "left").select(*[points[c] for c in points.columns], "normal", "residual")


def _tangent(w, at: str) -> Column:
    """Difference to the neighbour of the smaller jump in depth along one axis of the grid; null without a neighbour."""
    ahead, back = F.lead("p").over(w), F.lag("p").over(w)
    ahead = F.when(F.lead(at).over(w) == F.col(at) + 1, ahead)
    back = F.when(F.lag(at).over(w) == F.col(at) - 1, back)
    jump = lambda o: F.coalesce(F.abs(o[2] - F.col("p")[2]), F.lit(float("inf")))
    step = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.zip_with(a, b, lambda u, v: u - v))
    return F.when(jump(ahead) <= jump(back), step(ahead, F.col("p"))).otherwise(step(F.col("p"), back))


def depth_normals(pixels: DataFrame, by: list[str], fx: float, fy: float, cx: float, cy: float, u: str = "u", v: str = "v", z: str = "z") -> DataFrame:
    """Pixels with `normal`: the cross product of the tangents along the image's axes, looking towards the camera.

    A tangent goes to the neighbour whose depth is nearer, so a jump in depth keeps each side's own surface. Without a
    usable neighbour the normal is the viewing direction; a pixel whose depth is null, NaN, infinite or not over 0 is no
    neighbour and has the normal 0. One row a pixel; absent pixels are no neighbours. A row of the image is sorted in one task.
    """
    sound = finite(z) & (F.col(z) > 0)
    rows = pixels.withColumn("p", F.when(sound, unproject(F.col(u), F.col(v), F.col(z), F.lit(fx), F.lit(fy), F.lit(cx), F.lit(cy))))
    rows = rows.withColumn("_a", _tangent(Window.partitionBy(*by, v).orderBy(u), u)).withColumn("_b", _tangent(Window.partitionBy(*by, u).orderBy(v), v))
    a, b = F.col("_a"), F.col("_b")
    rows = rows.withColumn("_n", F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]))
    rows = rows.withColumn("_n", F.when(a.isNotNull() & b.isNotNull() & (norm("_n") > 0), F.transform("_n", lambda x: x / norm("_n"))).otherwise(F.transform("p", lambda x: -x / norm("p"))))
    facing = F.when(dot("_n", "p") > 0, F.transform("_n", lambda x: -x)).otherwise(F.col("_n"))
    return rows.withColumn("normal", F.when(F.col("p").isNotNull(), facing).otherwise(F.array(*[F.lit(0.0)] * 3))).select(*pixels.columns, "normal")
