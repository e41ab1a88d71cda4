"""Exact quantiles of groups of any size: interval counts that merge, instead of all values of a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.functions.geometry import finite
from atlasloom.operators.graph import _cut

#: Values of a group that one task may sort.
MOST = 200_000
#: Intervals into which a round cuts what is left of a group's values.
BINS = 4096


def _ranked(big: DataFrame, sizes: DataFrame, by: list[str], probs: tuple[float, ...], most: int, folder: str | None) -> DataFrame:
    """(by, k, q): of groups of over `most` values, the quantile of each of `probs`, by its number `k`."""
    place = lambda f: [(F.lit(p) * (F.col("n") - 1)).alias("place") if f is None else f(F.lit(p) * (F.col("n") - 1)).cast("long").alias("rank") for p in probs]
    ends = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(end).alias("end"), r) for end, f in enumerate((F.floor, F.ceil)) for k, r in enumerate(place(f))])
    todo = sizes.where(F.col("n") > most).withColumn("t", F.explode(ends)).select(*by, "t.*", "lo", "hi", "n")
    key, done = [*by, "k", "end"], None
    while True:
        todo = _cut(todo, folder)
        settled = todo.where((F.col("n") <= most) | (F.col("lo") == F.col("hi")))
        done = settled if done is None else done.unionByName(settled)
        todo = todo.where((F.col("n") > most) & (F.col("lo") < F.col("hi")))
        if todo.isEmpty():
            break
        # Halved ends, so that the width of an interval cannot overflow; least and largest value always part.
        bin_ = F.least(F.lit(BINS - 1), F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * BINS)).cast("int")
        # Few rows for each group of over `most` values: at most two for each quantile.
        cut = big.join(F.broadcast(todo), by).where("v BETWEEN lo AND hi").groupBy(*key, bin_.alias("bin")).agg(F.count("v").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        bins = cut.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("bin", "c", "a", "b"))).alias("bins"))
        run = F.aggregate("bins", F.struct(F.col("rank").alias("left"), F.lit(None).cast("struct<bin:int,c:bigint,a:double,b:double>").alias("at")),
                          lambda s, x: F.struct(F.when(s["at"].isNull() & (s["left"] >= x["c"]), s["left"] - x["c"]).otherwise(s["left"]).alias("left"), F.when(s["at"].isNull() & (s["left"] < x["c"]), x).otherwise(s["at"]).alias("at")))
        todo = todo.join(bins, key).withColumn("s", run).select(*key, F.col("s.left").alias("rank"), F.col("s.at.a").alias("lo"), F.col("s.at.b").alias("hi"), F.col("s.at.c").alias("n"))
    rest = big.join(F.broadcast(done.where("lo < hi")), by).where("v BETWEEN lo AND hi").groupBy(*key, "rank").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = rest.select(*key, F.get("vs", F.col("rank").cast("int")).alias("v")).unionByName(done.where("lo = hi").select(*key, F.col("lo").alias("v")))
    pair = found.groupBy(*by, "k").agg(F.min("v").alias("v0"), F.max("v").alias("v1")).join(sizes.select(*by, "n"), by)
    at = F.get(F.array(*place(None)), F.col("k"))
    return pair.select(*by, "k", (F.col("v0") + (F.col("v1") - F.col("v0")) * (at - F.floor(at))).alias("q"))


def exact(rows: DataFrame, by: list[str], value: str, probs: tuple[float, ...], most: int = MOST, folder: str | None = None) -> DataFrame:
    """(by, n, q): for each group the number of its values and the array of its quantiles, interpolated between order statistics.

    Groups of at most `most` values are sorted in one task each. In larger ones each wanted rank is found by counting
    values in intervals, a partial aggregate, and going on inside the interval that holds it until at most `most` values or
    one are left; every round reads the rows of large groups once. Nulls, NaN and infinite values are not counted, a group
    of none but those has no row, and neither has one with a null key.
    """
    rows = rows.select(*by, F.col(value).cast("double").alias("v")).where(finite("v"))
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    sizes = _cut(rows.groupBy(*by).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), folder)
    wanted = F.array(*map(F.lit, probs))
    if sizes.where(F.col("n") > most).isEmpty():
        return rows.groupBy(*by).agg(F.count("v").alias("n"), F.percentile("v", wanted).alias("q"))
    # Fewer than one in `most` rows; a shuffled join would gather each of these groups in one task.
    large = F.broadcast(sizes.where(F.col("n") > most).select(*by))
    small = rows.join(large, by, "left_anti").groupBy(*by).agg(F.count("v").alias("n"), F.percentile("v", wanted).alias("q"))
    big = _ranked(rows.join(large, by), sizes, by, probs, most, folder)
    q = F.transform(F.sort_array(F.collect_list(F.struct("k", "q"))), lambda s: s["q"])
    return small.unionByName(big.groupBy(*by).agg(q.alias("q")).join(sizes.select(*by, "n"), by).select(*by, "n", "q"))
