"""Grouped statistics. Everything that can be merged is aggregated partially before its shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.functions.geometry import col, finite, voxel
from atlasloom.operators import quantiles

#: Standard deviations in a median absolute deviation of normal data.
MAD_SIGMA = 1.4826


def voxel_mean(points: DataFrame, axes: dict[str, float], values: list[str], by: list[str] = ()) -> DataFrame:
    """Mean of `values` and count per voxel; `axes` gives each axis its edge."""
    keyed = points.withColumns({f"i_{a}": voxel(a, s) for a, s in axes.items()})
    return keyed.groupBy(*by, *[f"i_{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(v).alias(f"mean_{v}") for v in values])


def voxel_state(points: DataFrame, axes: dict[str, float], values: list[str]) -> DataFrame:
    """Sums and counts per voxel: partial states that `merge_states` adds up."""
    keyed = points.withColumns({f"i_{a}": voxel(a, s) for a, s in axes.items()})
    return keyed.groupBy(*[f"i_{a}" for a in axes]).agg(F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"sum_{v}") for v in values])


def merge_states(*states: DataFrame) -> DataFrame:
    both = states[0]
    for s in states[1:]:
        both = both.unionByName(s)
    keys = [c for c in both.columns if c.startswith("i_")]
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in both.columns if c not in keys])


def voxel_pick(points: DataFrame, axes: dict[str, float], order: list[str], keep: str = "first", by: list[str] = ()) -> DataFrame:
    """The first or last row of each voxel in a total order: an aggregate of one struct, not a sort of the voxel's rows."""
    keyed = points.withColumns({f"i_{a}": voxel(a, s) for a, s in axes.items()})
    pick = F.min_by if keep == "first" else F.max_by
    cells = [*by, *[f"i_{a}" for a in axes]]
    kept = [c for c in points.columns if c not in by]
    return keyed.groupBy(*cells).agg(pick(F.struct(*kept), F.struct(*order)).alias("row")).select(*cells, "row.*")


def budget_edge(points: DataFrame, axes: list[str], most: int, tolerance: float = 0.02, steps: int = 64) -> float:
    """Smallest voxel edge, to the tolerance, with at most `most` occupied voxels; 0 if there are no more rows than that.

    Each step is one partially aggregated distinct count; the edge is bisected in logarithm.
    """
    if points.count() <= most:
        return 0.0
    lo_hi = points.agg(*[F.min(a).alias(f"lo_{a}") for a in axes], *[F.max(a).alias(f"hi_{a}") for a in axes]).first()
    span = max(lo_hi[f"hi_{a}"] - lo_hi[f"lo_{a}"] for a in axes)
    count = lambda e: points.select(*[voxel(a, e).alias(a) for a in axes]).distinct().count()
    if span == 0:
        return 0.0
    high = span / max(most, 1) ** (1 / len(axes))
    taken = 0
    while count(high) > most and taken < steps:
        high, taken = high * 2, taken + 1
    low = high / 2
    while count(low) <= most and taken < steps:
        high, low, taken = low, low / 2, taken + 1
    while high / low > 1 + tolerance and taken < steps:
        mid, taken = (high * low) ** 0.5, taken + 1
        if count(mid) <= most:
            high = mid
        else:
            low = mid
    return high


def budgeted(points: DataFrame, axes: list[str], most: int, order: list[str]) -> DataFrame:
    """The first row of each voxel at the budget's edge, with `edge`; at edge 0 every place keeps its first row, or every row if all fit."""
    edge = budget_edge(points, axes, most)
    if edge:
        return voxel_pick(points, dict.fromkeys(axes, edge), order).drop(*[f"i_{a}" for a in axes]).withColumn("edge", F.lit(edge))
    if points.count() > most:
        points = points.groupBy(*axes).agg(F.min_by(F.struct(*points.columns), F.struct(*order)).alias("row")).select("row.*")
    return points.withColumn("edge", F.lit(0.0))


def mad(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Median, robust sigma and count per group, in two aggregates joined by the group."""
    middle = rows.groupBy(*by).agg(F.median(value).alias("median"), F.count(value).alias("n"))
    spread = rows.join(middle, by).groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))
    return middle.join(spread, by).withColumn("sigma", F.col("mad") * MAD_SIGMA)


#: Groups whose few numbers are sent to each task, and values of a group that `percentile` may hold for a robust ratio.
FEW_GROUPS, RATIOS_OF_TASK = 100_000, 1_500_000


def _beside(rows: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the numbers of their group (a checkpointed table); few groups are broadcast, as a shuffle would gather each in one task."""
    return rows.join(F.broadcast(per) if per.count() <= FEW_GROUPS else per, by)


def _quantiles(rows: DataFrame, by: list[str], value: str, probs: tuple[float, ...], most: int = quantiles.MOST) -> DataFrame:
    """(by, q): exact quantiles of each group with a value and no null key, without a group's values in one task.

    Groups with NaN or infinite values are ranked by `percentile`, which counts those as the greatest or least.
    """
    sound = rows.select(*by, value).na.drop(subset=list(by)).where(F.col(value).isNotNull())
    odd = sound.where(~finite(value)).select(*by).distinct().checkpoint()
    if odd.isEmpty():
        return quantiles.exact(sound, by, value, probs, most).select(*by, "q")
    other = sound.join(odd, by, "left_semi").groupBy(*by).agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("q"))
    return quantiles.exact(sound.join(odd, by, "left_anti"), by, value, probs, most).select(*by, "q").unionByName(other)


def robust_ratio(rows: DataFrame, by: list[str], top: str, bottom: str, gate: float = 3.0, eps: float = 1e-9) -> DataFrame:
    """Median ratio per group over rows whose log ratio lies within `gate` robust sigmas of the median one."""
    logs = rows.where((F.col(top) > 0) & (F.col(bottom) > 0)).select(*by, F.log(F.col(top) / F.col(bottom)).alias("_l"))
    middle = lambda rows, value, name: _quantiles(rows, by, value, (0.5,), RATIOS_OF_TASK).select(*by, F.col("q")[0].alias(name)).checkpoint()
    judged = _beside(logs, middle(logs, "_l", "_m"), by).withColumn("_d", F.abs(F.col("_l") - F.col("_m")))
    kept = _beside(judged, middle(judged, "_d", "_s"), by).where(F.col("_d") <= gate * MAD_SIGMA * F.col("_s") + eps)
    ratio = middle(kept, "_l", "_q").select(*by, F.exp("_q").alias("ratio"))
    return ratio.join(kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)


def inverse_variance(rows: DataFrame, by: list[str], value: str, sigma: str) -> DataFrame:
    """Information-weighted mean and its sigma."""
    w = 1 / (F.col(sigma) * F.col(sigma))
    return rows.where(F.col(sigma) > 0).groupBy(*by).agg((F.sum(F.col(value) * w) / F.sum(w)).alias("fused"), (1 / F.sqrt(F.sum(w))).alias("fused_sigma"))


def gated_least_squares(rows: DataFrame, by: list[str], x: str, y: str, least: int = 5, floor: float = 0.02) -> DataFrame:
    """Slope of y on x through 0 per group, over rows within three robust sigmas of the median log ratio; null with too few or a minority agreeing."""
    logs = rows.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("_l", F.log(F.col(y) / F.col(x)))
    m = mad(logs, by, "_l").select(*by, "median", "sigma", F.col("n").alias("all"))
    judged = logs.join(m, by).withColumn("_in", F.abs(F.col("_l") - F.col("median")) <= 3 * F.greatest(F.col("sigma"), F.lit(floor)))
    sums = judged.groupBy(*by).agg(F.sum(F.when(F.col("_in"), F.col(x) * F.col(y))).alias("_xy"), F.sum(F.when(F.col("_in"), F.col(x) * F.col(x))).alias("_xx"), F.sum(F.col("_in").cast("long")).alias("agreeing"), F.count(F.lit(1)).alias("n"))
    return sums.select(*by, F.when((F.col("agreeing") >= least) & (2 * F.col("agreeing") > F.col("n")), F.col("_xy") / F.col("_xx")).alias("slope"), "agreeing", "n")


def extent(rows: DataFrame, by: list[str], value: str, lo: float = 0.02, hi: float = 0.98) -> DataFrame:
    """Exact percentiles by linear interpolation."""
    return rows.groupBy(*by).agg(F.percentile(value, F.lit(lo)).alias("lo"), F.percentile(value, F.lit(hi)).alias("hi"))


def histogram(rows: DataFrame, value: str, width: float, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by, voxel(value, width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def peaks(bins: DataFrame, by: list[str] = (), least: float = 0) -> DataFrame:
    """Local maxima of a histogram smoothed over three bins; absent bins count as 0. The left side may tie.

    Bins next to filled ones are added, so no bin needs its neighbours in a range that is filled up.
    """
    near = bins.select(*by, "bin", F.explode(F.array(*[F.struct(F.lit(o).alias("o")) for o in (-1, 0, 1)])).alias("e"), "n")
    smooth = near.groupBy(*by, (F.col("bin") + F.col("e.o")).alias("bin")).agg((F.sum("n") / 3).alias("smooth"))
    w = Window.partitionBy(*by).orderBy("bin")
    side = lambda k: F.coalesce(F.when(F.lag("bin", k).over(w) == F.col("bin") - k, F.lag("smooth", k).over(w)), F.lit(0.0))
    return smooth.withColumns({"_left": side(1), "_right": side(-1)}).where((F.col("smooth") >= F.col("_left")) & (F.col("smooth") > F.col("_right")) & (F.col("smooth") >= least)).drop("_left", "_right")


def densest_window(rows: DataFrame, by: list[str], value: str, width: float) -> DataFrame:
    """Per group, the start of the window of that width that holds most values (the lowest one of equals), and how many."""
    over = ", ".join(f"`{c}`" for c in by)
    counted = rows.withColumn("_n", F.expr(f"count(1) OVER (PARTITION BY {over} ORDER BY `{value}` RANGE BETWEEN CURRENT ROW AND {float(width)}D FOLLOWING)"))
    return counted.groupBy(*by).agg(F.max(F.struct(F.col("_n").alias("n"), (-F.col(value)).alias("v"))).alias("_b")).select(*by, (-F.col("_b.v")).alias("start"), F.col("_b.n").alias("n"))


def vote_shares(votes: DataFrame, owner: str, label: str, frame: str) -> DataFrame:
    """Per owner and label: distinct frames that vote for it over distinct frames that see the owner, half-even to four digits."""
    total = votes.groupBy(owner).agg(F.countDistinct(frame).alias("_all"))
    each = votes.groupBy(owner, label).agg(F.countDistinct(frame).alias("frames"))
    return each.join(total, owner).select(owner, label, "frames", F.bround(F.col("frames") / F.col("_all"), 4).alias("share"))


def label_choice(shares: DataFrame, owner: str, label: str, preferred: Column | None = None, margin: float = 0.15) -> DataFrame:
    """The label of the largest share; a preferred label within the margin of the best wins. Labels without a share are never chosen."""
    best = shares.where(F.col("share") > 0).withColumn("_p", F.coalesce(preferred, F.lit(False)) if preferred is not None else F.lit(False))
    top = best.groupBy(owner).agg(F.max("share").alias("_top"))
    ranked = best.join(top, owner).withColumn("_wins", F.col("_p") & (F.col("share") >= F.col("_top") - margin - 1e-9))
    order = Window.partitionBy(owner).orderBy(F.desc("_wins"), F.desc("share"), F.asc(label))
    return ranked.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(owner, label, "share")


def label_evidence(votes: DataFrame, owner: str, label: str, score: str, generic: list[str], least: float = 0.25) -> DataFrame:
    """Label of the largest summed score; a specific one goes before a generic one if it has at least a quarter of all evidence."""
    sums = votes.groupBy(owner, label).agg(F.sum(score).alias("evidence"))
    total = sums.groupBy(owner).agg(F.sum("evidence").alias("_all"))
    j = sums.join(total, owner).withColumn("_specific", ~F.col(label).isin(generic) & (F.col("evidence") >= least * F.col("_all")))
    order = Window.partitionBy(owner).orderBy(F.desc("_specific"), F.desc("evidence"), F.asc(label))
    return j.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(owner, label, "evidence")


def last_n(rows: DataFrame, by: list[str], order: list, value: str, n: int = 50) -> DataFrame:
    """Median and 90th percentile of the newest `n` values per group."""
    w = Window.partitionBy(*by).orderBy(*order)
    newest = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return newest.groupBy(*by).agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.9)).alias("p90"), F.count(F.lit(1)).alias("n"))


def saturating_weights(samples: DataFrame, cell: list[str], frame: str, weight: Column, most: int = 65535) -> DataFrame:
    """Largest weight per frame and cell, summed over frames up to the counter's limit."""
    per = samples.groupBy(*cell, frame).agg(F.max(weight).alias("_w"))
    return per.groupBy(*cell).agg(F.least(F.sum("_w"), F.lit(most)).cast("long").alias("weight"), F.count(F.lit(1)).alias("frames"))


def nth_largest(rows: DataFrame, by: list[str], value: str, n: int = 3, least: int = 12) -> DataFrame:
    """The n-th largest value per group; null where the group has fewer than `least`."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    top = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == n).select(*by, F.col(value).alias("nth"))
    counts = rows.groupBy(*by).agg(F.count(value).alias("support"))
    return counts.join(top, by, "left").select(*by, F.when(F.col("support") >= least, F.col("nth")).alias("nth"), "support")


def coverage(rows: DataFrame, by: list[str], x: Column, y: Column, cells: int = 8) -> DataFrame:
    """Share of a square of cells that holds any row; x and y run from 0 to 1."""
    cell = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    return rows.groupBy(*by).agg((F.countDistinct(cell(x), cell(y)) / float(cells * cells)).alias("coverage"))


REDUCERS = {
    "share": lambda v: F.avg(v),
    "sum": lambda v: F.sum(v),
    "max": lambda v: F.max(v),
    "median": lambda v: F.median(v),
    "p90": lambda v: F.percentile(v, F.lit(0.9)),
}


def reduce_metrics(samples: DataFrame, how: dict[str, str], metric: str = "metric_id", value: str = "value", by: list[str] = ()) -> DataFrame:
    """One value per metric by its reducer; all reducers are computed in one aggregate."""
    out = samples.groupBy(metric, *by).agg(*[r(value).alias(f"_{n}") for n, r in REDUCERS.items()], F.count(value).alias("samples"))
    pick = F.lit(None).cast("double")
    for m, h in how.items():
        pick = F.when(F.col(metric) == m, F.col(f"_{h}").cast("double")).otherwise(pick)
    return out.select(metric, *by, pick.alias("value"), "samples")


def worst_state(grid: DataFrame, factor: int, row: str = "row", column: str = "col") -> DataFrame:
    """A grid at a coarser edge: largest state (unknown 0, free 1, occupied 2), most observations, greatest height."""
    coarse = lambda c: F.floor(F.col(c) / factor).cast("long")
    return grid.groupBy(coarse(row).alias(row), coarse(column).alias(column)).agg(F.max("state").alias("state"), F.max("observations").alias("observations"), F.max("height").alias("height"))


def trimmed_mean(rows: DataFrame, by: list[str], value: str, weight: str, lo: float = 0.1, hi: float = 0.9) -> DataFrame:
    """Weighted mean of the values between two exact percentiles, bounds included."""
    bounds = _quantiles(rows, by, value, (lo, hi)).select(*by, F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")).checkpoint()
    return rows.join(bounds, by).where(F.col(value).between(F.col("lo"), F.col("hi"))).groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean"), F.count(F.lit(1)).alias("n"))


def hysteresis(rows: DataFrame, by: list[str], order: str, value: str, band: float) -> DataFrame:
    """Per group, the value held after all rows in order: a new value replaces the held one only if it lies more than the band away."""
    listed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_s"))
    held = F.aggregate("_s", F.lit(None).cast("double"), lambda h, x: F.when(h.isNull() | (F.abs(x[value] - h) > band), x[value].cast("double")).otherwise(h))
    return listed.select(*by, held.alias("held"))


def inside_share(rows: DataFrame, by: list[str], condition: Column) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(col(condition).cast("double")).alias("share"), F.count(F.lit(1)).alias("n"))
