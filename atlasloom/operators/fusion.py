"""Fusion of views into one map: attribution of points, depth consensus, signed distances, carving, surfaces, ceilings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col, half_even, voxel


def attributed(views: DataFrame, point: str = "point", least_share: float = 1 / 3) -> DataFrame:
    """Colour and object per point from the views that see it: (point, version, colour, object_id).

    The latest version colours, in it the view of the smallest footprint; the object is the votes' majority (ties to the
    smaller id), kept only with a third of all votes.
    """
    colour = views.groupBy(point).agg(F.max("version").alias("version"), F.min_by("colour", F.struct((-F.col("version")).alias("v"), F.col("footprint"), F.col("frame"))).alias("colour"), F.count(F.lit(1)).alias("seen"))
    votes = views.where("object_id IS NOT NULL").groupBy(point, "object_id").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy(point).agg(F.max(F.struct("votes", (-F.col("object_id")).alias("o"))).alias("b"))
    j = colour.join(best, point, "left")
    return j.select(point, "version", "colour", F.when(F.col("b.votes") >= least_share * F.col("seen"), -F.col("b.o")).alias("object_id"))


def consensus(rays: DataFrame, by: list[str], own: str, other: str, through_margin: float = 0.10, drop_at: int = 2) -> DataFrame:
    """Median ratio of neighbours' depths along a pixel's ray, and whether enough neighbours see through it to drop it."""
    through = F.count(F.when(F.col(other) > F.col(own) * (1 + through_margin), 1))
    return rays.where((F.col(own) > 0) & (F.col(other) > 0)).groupBy(*by).agg(F.median(F.col(other) / F.col(own)).alias("ratio"), through.alias("through"), F.count(F.lit(1)).alias("views")).withColumn("dropped", F.col("through") >= drop_at)


def signed_distances(samples: DataFrame, cell: list[str], distance: str, weight: str, truncation: float) -> DataFrame:
    """Weighted mean of truncated signed distances per voxel; samples far behind the surface don't count. Sums merge like `voxel_state`."""
    d = F.least(F.greatest(F.col(distance), F.lit(-truncation)), F.lit(truncation))
    return samples.where(F.col(distance) >= -truncation).groupBy(*cell).agg((F.sum(d * F.col(weight)) / F.sum(weight)).alias("sdf"), F.sum(weight).alias("weight"))


def zero_crossings(sdf: DataFrame, x: str, y: str, z: str, value: str = "sdf") -> DataFrame:
    """Places where the distance changes sign between neighbours along an axis, linearly interpolated."""
    out = None
    for axis in (x, y, z):
        ahead = sdf.select(*[(F.col(c) - (1 if c == axis else 0)).alias(c) for c in (x, y, z)], F.col(value).alias("_next"))
        j = sdf.join(ahead, [x, y, z]).where(F.col(value) * F.col("_next") < 0)
        t = F.col(value) / (F.col(value) - F.col("_next"))
        part = j.select(*[(F.col(c) + (t if c == axis else F.lit(0.0))).alias(c) for c in (x, y, z)])
        out = part if out is None else out.union(part)
    return out


def carved(points: DataFrame, boxes: DataFrame, inside: Column, key: str) -> DataFrame:
    """Points without those inside a removed object's box; `boxes` is joined by range in the caller's cells."""
    return points.join(points.join(boxes, inside).select(key).distinct(), key, "left_anti")


def kept_thin(points: DataFrame, updated: str, in_view: str, trusted: str, least: int = 2) -> DataFrame:
    """Surface points that enough frames updated, or all frames that have them in view with a trusted one among them."""
    return points.where((F.col(updated) >= least) | ((F.col(updated) >= F.col(in_view)) & F.col(trusted)))


def surfaces(points: DataFrame, cell: float = 0.05, bin_: float = 0.01, up: float = 0.9, slab_least: int = 2) -> DataFrame:
    """Flat bins of cells: up-facing points counted in height bins, where a slab of 2 bins either side holds at least two and half of the band of 10."""
    n = points.where(F.col("nz") >= up).groupBy(voxel("x", cell).alias("col"), voxel("y", cell).alias("row"), voxel("z", bin_).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("row", "col").orderBy("bin")
    j = n.withColumns({"slab": F.sum("n").over(w.rangeBetween(-2, 2)), "band": F.sum("n").over(w.rangeBetween(-10, 10))})
    return j.where((F.col("slab") >= slab_least) & (F.col("slab") >= 0.5 * F.col("band")))


def ceiling(points: DataFrame, bin_: float, cell: float, least_cover: float) -> DataFrame:
    """The lowest height bin whose points cover a share of all cells, from above the middle of the heights."""
    cells = points.select(voxel("x", cell).alias("c"), voxel("y", cell).alias("r"), voxel("z", bin_).alias("bin"))
    whole = cells.agg(F.countDistinct("c", "r").alias("all"), F.percentile("bin", F.lit(0.5)).alias("mid"))
    per = cells.groupBy("bin").agg(F.countDistinct("c", "r").alias("cover"))
    # One row of totals meets every bin.
    return per.crossJoin(F.broadcast(whole)).where((F.col("bin") > F.col("mid")) & (F.col("cover") >= least_cover * F.col("all"))).agg(F.min("bin").alias("bin")).select((F.col("bin") * bin_).alias("height"))


def canonical_sources(points: DataFrame, size: float, most: int) -> DataFrame:
    """One point per voxel, the nearest to its centre, with the union of the points' source bits; at most `most` voxels, the smallest hashes. Union with itself changes nothing."""
    keyed = points.withColumns({f"i{a}": voxel(a, size) for a in "xyz"})
    off = sum((F.pow(F.col(a) - (F.col(f"i{a}") + 0.5) * size, F.lit(2.0)) for a in "xyz"), F.lit(0.0))
    one = keyed.groupBy("ix", "iy", "iz").agg(F.min_by(F.struct("x", "y", "z"), F.struct(off.alias("d"), F.col("x"), F.col("y"), F.col("z"))).alias("p"), F.bit_or("sources").alias("sources"))
    return one.withColumn("_h", F.xxhash64("ix", "iy", "iz")).orderBy("_h").limit(most).select("p.*", "sources")


def extent_seen(views: DataFrame, object: str = "object_id") -> DataFrame:
    """full or partial per axis: a view across the axis and no cut. `views`: across_x, across_y, top, cut, supported."""
    whole = ~F.col("cut")
    full = lambda c: F.when(F.max(c & whole), "full").otherwise("partial")
    return views.groupBy(object).agg(full(F.col("across_x")).alias("x"), full(F.col("across_y")).alias("y"), full((F.col("across_x") | F.col("across_y")) | (F.col("top") & F.col("supported"))).alias("z"))


def pooled_scale(votes: DataFrame, by: list[str], value: str, width: float, tolerance: float) -> DataFrame:
    """Mean of the log scales within the tolerance of the centre of the bin with most votes (the lowest of equals)."""
    bins = votes.groupBy(*by, voxel(value, width).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    best = bins.groupBy(*by).agg(F.max(F.struct("_n", (-F.col("_b")).alias("b"))).alias("_x")).select(*by, ((-F.col("_x.b") + 0.5) * width).alias("_c"))
    return votes.join(best, by).where(F.abs(F.col(value) - F.col("_c")) <= tolerance).groupBy(*by).agg(F.exp(F.avg(value)).alias("scale"), F.count(F.lit(1)).alias("votes"))


def supported_return(values: DataFrame, by: list[str], value: str, least: int = 12, nth: int = 3, absolute: float = 0.05, relative: float = 0.05) -> DataFrame:
    """Per beam the nearest value v whose window [v, v + max(absolute, relative v)] holds enough values; the n-th value of the window is returned. Null where none does."""
    w = Window.partitionBy(*by).orderBy(value)
    ranked = values.withColumn("_r", F.row_number().over(w)).withColumns({"_far": F.lead(value, least - 1).over(w), "_nth": F.lead(value, nth - 1).over(w)})
    ok = F.col("_far") <= F.col(value) + F.greatest(F.lit(absolute), relative * F.col(value))
    return ranked.groupBy(*by).agg(F.min_by(F.when(ok, F.col("_nth")), F.when(ok, F.col("_r"))).alias("range"), F.count(F.lit(1)).alias("values"))


def beam(x: Column, y: Column, step: float) -> Column:
    """Number of the beam of a direction, half-even; -180 degrees counts as 180."""
    n = half_even(F.degrees(F.atan2(col(y), col(x))) / step).cast("int")
    return F.when(n == -int(round(180 / step)), int(round(180 / step))).otherwise(n)


def with_default_beams(ranges: DataFrame, by: list[str], step: float) -> DataFrame:
    """Every beam in (-180, 180], unseen ones with null range."""
    k = int(round(180 / step))
    every = ranges.select(*by).distinct().withColumn("beam", F.explode(F.sequence(F.lit(1 - k), F.lit(k))))
    return every.join(ranges, [*by, "beam"], "left")
