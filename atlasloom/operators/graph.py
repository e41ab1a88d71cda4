"""Graph fixed points on edge tables."""

from __future__ import annotations

import contextlib
import itertools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Edges that any node may have before it counts as a hub.
HUB_DEGREE = 1000


#: Spark's switch to delete the shuffle files of a query when it ends, instead of when the driver happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession):
    """Shuffles of what is written inside are deleted once it is written; a table that is read once more makes them again."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def _cut(df: DataFrame, folder: str | None) -> DataFrame:
    """Ends the lineage of a round: a table in the shared folder, or a reliable checkpoint."""
    with shuffles_go(df.sparkSession):
        if folder is None:
            # The switch counts for tables that are made while it is on.
            return df.select("*").checkpoint()
        path = f"{folder}/round-{uuid.uuid4().hex}"
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _least_neighbours(rows: DataFrame, degree: int | None) -> DataFrame:
    """Edges (u, v) with `m`, the smallest v of their u: of nodes over `degree` by broadcast, of all others in one sorted shuffle by u."""
    own = F.min("v").over(Window.partitionBy("u"))
    if degree is None:
        return rows.withColumn("m", own)
    hubs = rows.groupBy("u").agg(F.min("v").alias("h"), F.count(F.lit(1)).alias("d")).where(F.col("d") > degree).select("u", "h")
    marked = rows.join(F.broadcast(hubs), "u", "left")
    light = marked.where("h IS NULL").select("u", "v").withColumn("m", own)
    return light.union(marked.where("h IS NOT NULL").select("u", "v", F.col("h").alias("m")))


def _shape(e: DataFrame) -> tuple[int, int, bool]:
    """Edges, most edges of a node, and whether some node has two parents, or a parent and a child: without such nodes all components are stars."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
    nodes = ends.groupBy("x").agg(F.count(F.lit(1)).alias("d"), F.sum("up").alias("up"))
    edges, most, unfinished = nodes.agg(F.sum("up"), F.max("d"), F.bool_or(F.expr("up > 1 OR (up = 1 AND d > 1)"))).first()
    return edges or 0, most or 0, bool(unfinished)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", folder: str | None = None) -> DataFrame:
    """(node, component) for every node with an edge to another; the component is its smallest node.

    Alternates large-star and small-star until every component is a star around its smallest node. A half round is one
    shuffle by node. A node with over `edges / (2 * partitions)` edges is a hub: there are at most four for each
    partition, so their minima are partial aggregates that are broadcast, and the edges of a hub never meet in one place.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    e = _cut(e, folder)
    parts = int(e.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        count, most, unfinished = _shape(e)
        if not unfinished:
            break
        limit = max(HUB_DEGREE, count // (2 * parts))
        degree = limit if most > limit else None
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        e = _least_neighbours(both, degree).select(F.col("v").alias("u"), F.least("u", "m").alias("v"), F.col("u").alias("w")).where("u > w").select("u", "v")
        if degree is not None:  # three reads of it follow
            e = _cut(e, folder)
        moved = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        e = _cut(_least_neighbours(e, degree).select(moved).select("e.*").where("u <> v").distinct(), folder)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def bounded_paths(edges: DataFrame, starts: DataFrame, hops: int, src: str = "src", dst: str = "dst") -> DataFrame:
    """(start, node, hops): the fewest hops from each start, up to a limit. Reached pairs are not walked again."""
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("hops"))
    front = seen
    for k in range(1, hops + 1):
        step = front.join(edges, front["node"] == edges[src]).select("start", F.col(dst).alias("node")).distinct()
        front = step.join(seen, ["start", "node"], "left_anti").withColumn("hops", F.lit(k)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.union(front)
    return seen


def reachable_labels(cells: DataFrame, edges: DataFrame, node: str, label: str) -> DataFrame:
    """Breadth-first growth of labels from labelled cells to unlabelled ones, until the front is empty: nearest label, ties to the smallest."""
    known = cells.where(F.col(label).isNotNull()).select(F.col(node).alias("node"), F.col(label).alias("label"), F.lit(0).alias("steps"))
    front = known
    for k in itertools.count(1):
        step = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        front = step.join(known, "node", "left_anti").select("node", "label", F.lit(k).alias("steps")).checkpoint()
        if front.isEmpty():
            break
        known = known.union(front).checkpoint()
    return known


def spanning_forest(edges: DataFrame, weight: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Maximum spanning forest (Boruvka): each component takes its heaviest outgoing edge, ties by the ends' names."""
    e = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b"), F.col(weight).cast("double").alias("w")).where("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")).checkpoint()
    label = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().select("node", F.col("node").alias("c"))
    chosen = e.limit(0)
    while True:
        la, lb = label.select(F.col("node").alias("a"), F.col("c").alias("ca")), label.select(F.col("node").alias("b"), F.col("c").alias("cb"))
        out = e.join(la, "a").join(lb, "b").where("ca <> cb")
        ends = out.select(F.col("ca").alias("c"), "a", "b", "w").union(out.select(F.col("cb").alias("c"), "a", "b", "w"))
        best = ends.groupBy("c").agg(F.min_by(F.struct("a", "b", "w"), F.struct((-F.col("w")).alias("w"), F.col("a"), F.col("b"))).alias("e")).select("e.*").distinct().checkpoint()
        if best.isEmpty():
            break
        chosen = chosen.union(best).checkpoint()
        joined = connected_components(chosen, "a", "b").withColumnRenamed("component", "k")
        label = label.select("node").join(joined, "node", "left").select("node", F.coalesce("k", "node").alias("c")).checkpoint()
    return chosen
