"""Upright boxes of point groups: convex hulls that merge, robust extents for each hull edge's direction, floors and supports."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from atlasloom.functions.geometry import finite
from atlasloom.operators import quantiles
from atlasloom.operators.graph import _cut

#: Shares between which an extent is taken, smallest side, size under which no box stands on a floor (metres), digits of a direction.
LOW, HIGH, LEAST_SIDE, TINY, YAW_DIGITS = 0.02, 0.98, 0.01, 0.1, 4
#: Points that are too few for a direction.
FEW = 4
#: Parts in which the hulls that tasks send on are merged first.
PARTS = 32
#: Directions whose extremes sort out what lies well inside.
WAYS = np.stack([np.cos(np.arange(16) * math.pi / 8), np.sin(np.arange(16) * math.pi / 8)])


def hull(xy: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, anticlockwise, without those on an edge; fewer than three where the points lie on a line."""
    if len(xy) > 64:
        corner = xy[np.argmax(xy @ WAYS, axis=0)]
        side = np.roll(corner, -1, axis=0) - corner
        inside = np.ones(len(xy), bool)
        for c, s in zip(corner, side):
            if s.any():
                inside &= s[0] * (xy[:, 1] - c[1]) - s[1] * (xy[:, 0] - c[0]) > 0
        xy = xy[~inside]
    points = np.unique(xy, axis=0).tolist()
    if len(points) < 3:
        return np.array(points).reshape(-1, 2)

    def chain(row):
        out = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def directions(points: DataFrame, by: list[str]) -> DataFrame:
    """(by, points, yaws): the directions of a group's hull edges, radians in [0, pi/2) to four digits; 0 for under four points or points on a line.

    Each batch sends the corners of its own hulls on, which merge in parts by task, then whole: a task sees the corners of a
    group, not its points.
    """
    rows = points.select(*by, "x", "y")
    schema = rows.schema
    parted = StructType([*schema, StructField("_part", LongType())])

    def corners(part: pd.DataFrame) -> pd.DataFrame:
        xy = hull(part[["x", "y"]].to_numpy())
        out = part[[*by, "x", "y"]].iloc[: len(xy)].copy()
        out["x"], out["y"] = xy[:, 0], xy[:, 1]
        return out

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() % PARTS
        for part in parts:
            groups = [corners(g) for _, g in part.groupby(by, sort=False)]
            if groups:
                yield pd.concat(groups).assign(_part=number)

    def turned(part: pd.DataFrame) -> pd.DataFrame:
        xy = hull(part[["x", "y"]].to_numpy())
        yaws = np.zeros(1)
        if len(xy) > 2:
            edge = np.roll(xy, -1, axis=0) - xy
            yaws = np.unique(np.round(np.mod(np.arctan2(edge[:, 1], edge[:, 0]), math.pi / 2), YAW_DIGITS))
        out = part[by].iloc[:1].copy()
        out["yaws"] = [yaws]
        return out

    merged = rows.mapInPandas(batches, parted).groupBy(*by, "_part").applyInPandas(corners, schema)
    yaws = merged.groupBy(*by).applyInPandas(turned, StructType([*[schema[c] for c in by], StructField("yaws", ArrayType(DoubleType()))]))
    many = points.groupBy(*by).agg(F.count(F.lit(1)).alias("points"))
    return many.join(yaws, by).withColumn("yaws", F.when(F.col("points") < FEW, F.array(F.lit(0.0))).otherwise(F.col("yaws")))


def upright(points: DataFrame, by: list[str], x: str = "x", y: str = "y", z: str = "z", folder: str | None = None) -> DataFrame:
    """(by, points, cx, cy, cz, width, depth, height, yaw): the upright box of each group's points, yaw in degrees in (-90, 90].

    Of the directions of the hull's edges, the one whose rectangle between the 2nd and 98th percentiles is least (ties: the
    smallest direction); x is its longer side. All points count, in hulls and percentiles, which both merge, so a group may
    be of any size. A side is 1 cm at least. Points that are not finite or have a null key are left out; a group of none
    but those has no box.
    """
    rows = points.select(*by, *[F.col(c).cast("double").alias(a) for c, a in zip((x, y, z), "xyz")]).where(finite("x", "y", "z"))
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    ways = _cut(directions(rows, by), folder)
    along = lambda t: F.array(F.struct(t.alias("yaw"), F.lit(0).alias("axis"), (F.cos(t) * F.col("x") + F.sin(t) * F.col("y")).alias("at")), F.struct(t.alias("yaw"), F.lit(1).alias("axis"), (F.cos(t) * F.col("y") - F.sin(t) * F.col("x")).alias("at")))
    up = F.array(F.struct(F.lit(-1.0).alias("yaw"), F.lit(2).alias("axis"), F.col("z").alias("at")))
    long = rows.join(ways, by).select(*by, F.explode(F.concat(F.flatten(F.transform("yaws", along)), up)).alias("e")).select(*by, "e.*")
    ends = quantiles.exact(long, [*by, "yaw", "axis"], "at", (LOW, HIGH), folder=folder)
    of = lambda axis: F.max(F.when(F.col("axis") == axis, F.col("q")))
    flat = ends.where("axis < 2").groupBy(*by, "yaw").agg(of(0).alias("a"), of(1).alias("b"))
    area = (F.col("a")[1] - F.col("a")[0]) * (F.col("b")[1] - F.col("b")[0])
    best = flat.groupBy(*by).agg(F.min_by(F.struct("yaw", "a", "b"), F.struct(F.round(area, 12), F.col("yaw"))).alias("e")).select(*by, "e.*")
    tall = ends.where("axis = 2").select(*by, F.col("q").alias("c"))
    mid = lambda c: (F.col(c)[0] + F.col(c)[1]) / 2
    size = lambda c: F.col(c)[1] - F.col(c)[0]
    side = lambda v: F.greatest(v, F.lit(LEAST_SIDE))
    swapped = size("b") > size("a")
    turn = F.degrees("yaw") + F.when(swapped, 90.0).otherwise(0.0)
    return best.join(tall, by).join(ways.select(*by, "points"), by).select(
        *by, "points",
        (mid("a") * F.cos("yaw") - mid("b") * F.sin("yaw")).alias("cx"), (mid("a") * F.sin("yaw") + mid("b") * F.cos("yaw")).alias("cy"), mid("c").alias("cz"),
        side(F.greatest(size("a"), size("b"))).alias("width"), side(F.least(size("a"), size("b"))).alias("depth"), side(size("c")).alias("height"),
        F.when(turn > 90, turn - 180).otherwise(turn).alias("yaw"),
    )


def _lowered(boxes: DataFrame, level: Column, applies: Column) -> DataFrame:
    top = F.col("cz") + F.col("height") / 2
    applies = F.coalesce(applies, F.lit(False))
    return boxes.withColumns({"cz": F.when(applies, (top + level) / 2).otherwise(F.col("cz")), "height": F.when(applies, top - level).otherwise(F.col("height"))})


def grounded(boxes: DataFrame, floor: Column, max_gap: float, min_visible: float = 0.0) -> DataFrame:
    """Boxes that end at most `max_gap` over the floor, brought down to it, where at least `min_visible` of the height is seen and some side is 10 cm; a null floor changes nothing."""
    low, top = F.col("cz") - F.col("height") / 2, F.col("cz") + F.col("height") / 2
    gap = low - floor
    return _lowered(boxes, floor, (gap > 0) & (gap <= max_gap) & (top > floor) & (F.col("height") >= min_visible * (top - floor)) & (F.greatest("width", "depth", "height") >= TINY))


def rested(boxes: DataFrame, level: Column, min_visible: float) -> DataFrame:
    """Boxes over the surface at `level` brought down to it, where at least `min_visible` of the height is seen; a null level changes nothing."""
    low, top = F.col("cz") - F.col("height") / 2, F.col("cz") + F.col("height") / 2
    return _lowered(boxes, level, (low > level) & (F.col("height") >= min_visible * (top - level)))
