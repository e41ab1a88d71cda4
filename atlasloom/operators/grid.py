"""Occupancy volumes and navigation grids as sparse tables of cells.

States: 0 unknown, 1 free, 2 occupied. A cell that was never observed has no row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col
from atlasloom.operators.graph import connected_components

UNKNOWN, FREE, OCCUPIED = 0, 1, 2
#: Share of hits among hits and free samples from which a voxel is a surface.
SURFACE_SHARE = 0.2
#: Cells of a stretch of a line.
STRETCH = 4096


def neighbours(cells: DataFrame, row: str = "row", column: str = "col", corners: bool = True) -> DataFrame:
    """Each cell's neighbours: the cell's columns with `n_row` and `n_col`."""
    offsets = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (corners or not (i and j))]
    o = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return cells.withColumn("_o", o).withColumns({"n_row": F.col(row) + F.col("_o.i"), "n_col": F.col(column) + F.col("_o.j")}).drop("_o")


def adjacency(cells: DataFrame, keep: Column | None = None, corners: bool = True, value: str | None = None) -> DataFrame:
    """Edges (src, dst) between neighbouring cells; `keep` may compare the cells' values `value` and `n_value`."""
    own = cells.select("row", "col", *([F.col(value).alias("value")] if value else []))
    other = cells.select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), *([F.col(value).alias("n_value")] if value else []))
    j = neighbours(own, corners=corners).join(other, ["n_row", "n_col"])
    j = j.where(keep) if keep is not None else j
    return j.select(F.struct("row", "col").alias("src"), F.struct(F.col("n_row").alias("row"), F.col("n_col").alias("col")).alias("dst"))


def components(cells: DataFrame, corners: bool = True, keep: Column | None = None, value: str | None = None) -> DataFrame:
    """Cells with the smallest cell of their connected piece: (row, col, root_row, root_col)."""
    found = connected_components(adjacency(cells, keep, corners, value))
    at = found.select("node.row", "node.col", F.col("component.row").alias("root_row"), F.col("component.col").alias("root_col"))
    return cells.select("row", "col").distinct().join(at, ["row", "col"], "left").withColumns({"root_row": F.coalesce("root_row", "row"), "root_col": F.coalesce("root_col", "col")})


def layers(volume: DataFrame, z_min: float, z_max: float, edge: float) -> DataFrame:
    """A grid from voxels (ix, iy, iz, free, hit): occupied with a surface voxel's centre in the band, free with a free sample there; greatest surface height."""
    z = (F.col("iz") + 0.5) * edge
    surface = (F.col("hit") > 0) & (F.col("hit") >= SURFACE_SHARE * (F.col("hit") + F.col("free")))
    band = z.between(z_min, z_max)
    g = volume.groupBy(F.col("iy").alias("row"), F.col("ix").alias("col")).agg(F.max(F.when(surface & band, 1).otherwise(0)).alias("_o"), F.max(F.when((F.col("free") > 0) & band, 1).otherwise(0)).alias("_f"), F.max(F.when(surface, z)).alias("height"), F.sum("hit").alias("observations"))
    state = F.when(F.col("_o") == 1, OCCUPIED).when(F.col("_f") == 1, FREE).otherwise(UNKNOWN)
    return g.select("row", "col", state.alias("state"), "observations", "height")


def inflated(grid: DataFrame, radius: int = 1) -> DataFrame:
    """Occupied cells grow by a square of the radius; cells that had no row stay without one."""
    grown = grid.select("row", "col").limit(0)
    occupied = grid.where(F.col("state") == OCCUPIED).select("row", "col")
    span = F.sequence(F.lit(-radius), F.lit(radius))
    grown = occupied.withColumn("_i", F.explode(span)).withColumn("_j", F.explode(span)).select((F.col("row") + F.col("_i")).cast("long").alias("row"), (F.col("col") + F.col("_j")).cast("long").alias("col"), F.lit(True).alias("_near")).distinct()
    return grid.join(grown, ["row", "col"], "left").withColumn("state", F.when(F.col("_near"), OCCUPIED).otherwise(F.col("state"))).drop("_near")


def _of_pieces(piece: DataFrame, wanted: DataFrame) -> DataFrame:
    """Cells (row, col) of the wanted pieces (root_row, root_col, _n: cells). Those of large pieces, at most four for each partition, are told by broadcast and never meet in one task."""
    roots = ["root_row", "root_col"]
    least = piece.count() // (4 * int(piece.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    wanted = wanted.checkpoint()
    marked = piece.join(F.broadcast(wanted.where(F.col("_n") > least).select(*roots, F.lit(True).alias("_large"))), roots, "left")
    light = marked.where("_large IS NULL").join(wanted.where(F.col("_n") <= least), roots, "left_semi")
    return marked.where("_large").select("row", "col").union(light.select("row", "col"))


def _thin_sides(wall: DataFrame, thick: int) -> DataFrame:
    """Cells beside a wall cell from which, away from them, fewer than `thick` wall cells follow each other: (row, col).

    Along each of the four lines through a cell, a wall cell knows the one `thick - 1` places ahead and behind; lines are cut
    into stretches that overlap by as many, so no line meets in one task.
    """
    n, out = thick - 1, []
    stretch = lambda p: F.floor(p / STRETCH)
    p = F.col("_p")
    for i, j in ((0, 1), (1, 0), (1, 1), (1, -1)):
        at = wall.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col")])
        at = at.select((F.col("col") - F.col("row") * j if i else F.col("row")).alias("_l"), F.col("row" if i else "col").alias("_p"))
        line = Window.partitionBy("_l", "_b").orderBy("_p")
        at = at.withColumn("_b", F.explode(F.sequence(stretch(p - n), stretch(p + n)))).withColumns({"_a": F.lead("_p", n).over(line), "_z": F.lag("_p", n).over(line)}).where(F.col("_b") == stretch(p))
        thin = lambda c, end: F.when(~F.coalesce(F.col(c) == end, F.lit(False)), F.lit(True))
        side = F.array_compact(F.array(F.when(thin("_a", p + n), p - 1), F.when(thin("_z", p - n), p + 1)))
        at = at.select("_l", F.explode(side).alias("_p"))
        out.append(at.select((p if i else F.col("_l")).alias("row"), (F.col("_l") + p * j if i else p).alias("col")))
    return functools.reduce(DataFrame.union, out).distinct()


def inflated_walls(grid: DataFrame, edge: float, extent: float = 1.5, thick: int = 4) -> DataFrame:
    """Walls grow by one cell on the sides where they are thinner than `thick` cells; other occupied cells stay as seen.

    A wall is an 8-connected piece of occupied cells at least `extent` long. `grid`: row, col, state, and if there are
    such columns `drop` (a drop is no wall and is not grown into) and `top` (a grown cell takes the highest one of the
    wall cells beside it, null where walls touch its corners only). Grown cells that had no row get one, within the grid's bounds.
    """
    dropped = F.coalesce(F.col("drop"), F.lit(False)) if "drop" in grid.columns else F.lit(False)
    piece = components(grid.where((F.col("state") == OCCUPIED) & ~dropped).select("row", "col"))
    span = lambda c: F.max(c) - F.min(c) + 1
    long = piece.groupBy("root_row", "root_col").agg(F.greatest(span("row"), span("col")).alias("_long"), F.count(F.lit(1)).alias("_n")).where(F.col("_long") * edge >= extent)
    wall = _of_pieces(piece, long)
    grown = _thin_sides(wall, thick)
    bounds = grid.agg(*[f(c).alias(f"_{k}_{c}") for c in ("row", "col") for k, f in (("lo", F.min), ("hi", F.max))])
    grown = grown.crossJoin(bounds).where("row BETWEEN _lo_row AND _hi_row AND col BETWEEN _lo_col AND _hi_col").select("row", "col", F.lit(True).alias("_near"))
    if "top" in grid.columns:
        tops = neighbours(grid.select("row", "col", "top").join(wall, ["row", "col"]), corners=False).where("NOT isnan(top)")
        grown = grown.join(tops.groupBy(F.col("n_row").cast("long").alias("row"), F.col("n_col").cast("long").alias("col")).agg(F.max("top").alias("_top")), ["row", "col"], "left")
    near = F.col("_near") & ((F.col("state") != OCCUPIED) | F.col("state").isNull())
    out = grid.join(grown, ["row", "col"], "full")
    out = out.withColumn("top", F.when(near, F.col("_top")).otherwise(F.col("top"))) if "top" in grid.columns else out
    return out.withColumn("state", F.when(near, OCCUPIED).otherwise(F.col("state"))).select(*grid.columns)


def regions(grid: DataFrame, edge: float, least_area: float = 0.25) -> DataFrame:
    """Free cells in 4-connected regions of at least the area: (row, col, root_row, root_col, area)."""
    found = components(grid.where(F.col("state") == FREE), corners=False)
    area = found.groupBy("root_row", "root_col").agg((F.count(F.lit(1)) * edge * edge).alias("area"))
    return found.join(area, ["root_row", "root_col"]).where(F.col("area") >= least_area)


def frontiers(grid: DataFrame, edge: float, least_length: float = 0.3) -> DataFrame:
    """Free cells beside unknown or absent ones, in 8-connected pieces of at least the length: (root_row, root_col, cells, length)."""
    free = grid.where(F.col("state") == FREE).select("row", "col")
    known = grid.where(F.col("state") != UNKNOWN).select(F.col("row").alias("n_row"), F.col("col").alias("n_col"))
    open_ = neighbours(free, corners=False).join(known, ["n_row", "n_col"], "left_anti").select("row", "col").distinct()
    found = components(open_)
    return found.groupBy("root_row", "root_col").agg(F.count(F.lit(1)).alias("cells")).withColumn("length", F.col("cells") * edge).where(F.col("length") >= least_length)


def drops(columns: DataFrame, step: float, edge: float, least_area: float = 0.05) -> DataFrame:
    """Cells below the floor band that no chain of small height steps ties to observed floor, in pieces of at least the area.

    `columns`: row, col, height, floor (observed floor), below (below the band).
    """
    low = columns.where("below").select("row", "col", "height")
    piece = components(low, keep=F.abs(F.col("value") - F.col("n_value")) <= step, value="height")
    at = low.join(piece, ["row", "col"])
    floor = columns.where("floor").select(F.col("row").alias("n_row"), F.col("col").alias("n_col"), F.col("height").alias("n_height"))
    tied = neighbours(at).join(floor, ["n_row", "n_col"]).where(F.abs(F.col("height") - F.col("n_height")) <= step).select("root_row", "root_col").distinct()
    left = at.join(tied, ["root_row", "root_col"], "left_anti").select("row", "col")
    whole = components(left)
    area = whole.groupBy("root_row", "root_col").agg((F.count(F.lit(1)) * edge * edge).alias("area"))
    return whole.join(area, ["root_row", "root_col"]).where(F.col("area") >= least_area)


def ray_hits(rays: DataFrame, grid: DataFrame, step: float, reach: float, edge: float) -> DataFrame:
    """Distance along each ray (id, x, y, dx, dy) to the first sampled cell that is not free; null within the reach."""
    at = rays.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(int(reach / step))))).withColumn("t", F.col("t") * step)
    at = at.withColumns({"col": F.floor((F.col("x") + F.col("dx") * F.col("t")) / edge).cast("long"), "row": F.floor((F.col("y") + F.col("dy") * F.col("t")) / edge).cast("long")})
    j = at.join(grid.select("row", "col", "state"), ["row", "col"], "left")
    return j.groupBy("id").agg(F.min(F.when(F.coalesce(F.col("state"), F.lit(UNKNOWN)) != FREE, F.col("t"))).alias("range"))


def ray_entries(rays: DataFrame, grid: DataFrame, step: float, reach: float, edge: float) -> DataFrame:
    """Where each ray (id, x, y, dx, dy) enters the first sampled cell that is not free: (id, range, row, col), nulls within the reach.

    Samples lie `step` apart from the first step on; the entry is where the ray crosses the cell's bounds, within the last step.
    """
    at = rays.withColumn("t", F.explode(F.sequence(F.lit(1), F.lit(int(reach / step))))).withColumn("t", F.col("t") * step)
    at = at.withColumns({"col": F.floor((F.col("x") + F.col("dx") * F.col("t")) / edge).cast("long"), "row": F.floor((F.col("y") + F.col("dy") * F.col("t")) / edge).cast("long")})
    j = at.join(grid.select("row", "col", "state"), ["row", "col"], "left")
    blocked = F.coalesce(F.col("state"), F.lit(UNKNOWN)) != FREE
    first = j.groupBy("id").agg(F.min(F.when(blocked, F.struct("t", "row", "col"))).alias("_k"), *[F.first(c).alias(c) for c in ("x", "y", "dx", "dy")])
    enter = lambda p, u, lo: F.when(F.abs(F.col(u)) > 1e-12, F.least((lo * edge - F.col(p)) / F.col(u), ((lo + 1) * edge - F.col(p)) / F.col(u)))
    entry = F.greatest(enter("x", "dx", F.col("_k.col")), enter("y", "dy", F.col("_k.row")))
    return first.select("id", F.when(F.col("_k").isNotNull(), F.least(F.greatest(entry, F.col("_k.t") - step), F.col("_k.t"))).alias("range"), F.col("_k.row").alias("row"), F.col("_k.col").alias("col"))


def depth_edges(raster: DataFrame, by: list[str], relative: float, value: str = "z") -> DataFrame:
    """Valid pixels whose 3x3 neighbourhood spans more than a share of their depth, or touches an invalid pixel that is in the raster.

    `raster`: by..., row, col and the depth, null where invalid.
    """
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    spread = raster.withColumn("_o", offsets).select(*by, (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"), F.col(value).alias("_z"))
    near = spread.groupBy(*by, "row", "col").agg(F.min("_z").alias("_lo"), F.max("_z").alias("_hi"), F.max(F.col("_z").isNull()).alias("_hole"))
    j = raster.where(F.col(value) > 0).join(near, [*by, "row", "col"])
    return j.withColumn("edge", F.col("_hole") | ((F.col("_hi") - F.col("_lo")) / F.col(value) > relative)).drop("_lo", "_hi", "_hole")


def highest(points: DataFrame, edge: float, x: str, y: str, z: str, take: Column, order: str) -> DataFrame:
    """Per pixel, `take` of the highest point, of equal heights the later one."""
    return points.groupBy(F.floor(F.col(y) / edge).cast("long").alias("row"), F.floor(F.col(x) / edge).cast("long").alias("col")).agg(F.max_by(col(take), F.struct(z, order)).alias("value"), F.max(z).alias("height"))
