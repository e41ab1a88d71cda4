"""Merging of duplicate objects, the strongest pair first, where each merge changes the strengths around it.

Taking one pair after another over a whole map is sequential. Rounds give the same: in a round, the pairs that are the
strongest of both their sides are tried together, and the strengths of what they would make are computed beside the
objects as they are. Within each component of pairs that can merge, a tried pair stands if it is stronger than all that the
tried pairs would make and than every pair that no tried one touches: nothing can come before it then. The strongest pair
of a component always stands, so every round merges in every component; the others are tried anew in the next round.

An object is its surface cells, its sightings (frame, label) and, if it has one, its published id. Pairs meet in coarse cells
of their boxes; the work grows with the objects that overlap in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.operators.graph import _cut, connected_components

#: Shares of the smaller object's surface, of the joint box, of the smaller box; detections; comparable sizes (fixed values).
OVERLAP, BOX_IOU, CONTAINED, DETECTIONS, SCALE = 0.5, 0.3, 0.6, 2, 0.5
#: Cells to a coarse cell, along an edge.
COARSE = 16
AXES = ("x", "y", "z")


def _written(df: DataFrame) -> DataFrame:
    """A table in the checkpoint folder. Unlike a checkpoint it brings its size, and none of the constraints that grow from round to round."""
    return _cut(df, df.sparkSession.sparkContext.getCheckpointDir())


def _described(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of objects (cells, frames, votes and marks by obj) with `objects`: obj, size, box, label, detections, touched, published."""
    cells, frames = _written(tables["cells"].distinct()), _written(tables["frames"].distinct())
    votes = _written(tables["votes"].groupBy("obj", "label").agg(F.sum("votes").alias("votes")))
    marks = _written(tables["marks"].groupBy("obj").agg(F.max("touched").alias("touched"), F.max("published").alias("published")))
    box = cells.groupBy("obj").agg(F.count(F.lit(1)).alias("size"), *[f(c).alias(f"{n}_{c}") for c in AXES for n, f in (("lo", F.min), ("hi", F.max))])
    label = votes.groupBy("obj").agg(F.min_by("label", F.struct(-F.col("votes"), F.col("label"))).alias("label"))
    detections = frames.groupBy("obj").agg(F.count(F.lit(1)).alias("detections"))
    objects = box.join(marks, "obj").join(label, "obj", "left").join(detections, "obj", "left").withColumn("detections", F.coalesce("detections", F.lit(0)))
    return {"cells": cells, "frames": frames, "votes": votes, "marks": marks, "objects": _written(objects)}


def _volume(side: str) -> Column:
    out = F.lit(1.0)
    for c in AXES:
        out = out * (F.col(f"{side}hi_{c}") - F.col(f"{side}lo_{c}") + 1)
    return out


def strengths(left: dict[str, DataFrame], right: dict[str, DataFrame]) -> DataFrame:
    """Pairs of objects that are one thing: (a, b, s) with a of `left`, b of `right`, a < b and s >= 1.

    Labels that agree: shared cells over the smaller object's, or boxes that overlap or hold each other. Labels that differ:
    never seen in one frame, one of the two detected twice, comparable sizes, and shared cells over either object's. One of
    the two must be touched, and published ids must not differ.
    """
    at = [f"_{c}" for c in AXES]

    def coarse(objects: DataFrame, side: str) -> DataFrame:
        for c in AXES:
            objects = objects.withColumn(f"_{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / COARSE), F.floor(F.col(f"hi_{c}") / COARSE))))
        return objects.select(F.col("obj").alias(side), *at)

    named = lambda tables, side: tables["objects"].select(*[F.col(c).alias(f"{side}_{c}" if c != "obj" else side) for c in tables["objects"].columns])
    pairs = coarse(left["objects"], "a").join(coarse(right["objects"], "b"), at).where("a < b").select("a", "b").distinct().join(named(left, "a"), "a").join(named(right, "b"), "b")
    # Every step below reads these pairs, so they are written once.
    apart = F.lit(False)
    for c in AXES:
        apart = apart | (F.col(f"a_hi_{c}") < F.col(f"b_lo_{c}")) | (F.col(f"b_hi_{c}") < F.col(f"a_lo_{c}"))
    pairs = _written(pairs.where(~apart & (F.col("a_touched") | F.col("b_touched")) & ~F.coalesce(F.col("a_published") != F.col("b_published"), F.lit(False))))
    # Of all objects only those of a pair are shuffled.
    asked = pairs.select(F.col("b").alias("obj")).distinct()
    there = lambda name: right[name].join(asked, "obj", "left_semi").withColumnRenamed("obj", "b")
    here = lambda name: left[name].withColumnRenamed("obj", "a")
    both = pairs.select("a", "b").join(here("cells"), "a").join(there("cells"), ["b", *AXES])
    shared = both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    met = pairs.select("a", "b").join(here("frames"), "a").join(there("frames"), ["b", "frame"]).select("a", "b", F.lit(True).alias("together")).distinct()
    j = pairs.join(shared, ["a", "b"], "left").join(met, ["a", "b"], "left")
    common = F.lit(1.0)
    for c in AXES:
        common = common * (F.least(f"a_hi_{c}", f"b_hi_{c}") - F.greatest(f"a_lo_{c}", f"b_lo_{c}") + 1)
    n, least, most = F.coalesce("shared", F.lit(0)), F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
    va, vb = _volume("a_"), _volume("b_")
    alike = F.greatest(n / least / OVERLAP, common / (va + vb - common) / BOX_IOU, common / F.least(va, vb) / CONTAINED)
    flicker = F.col("together").isNull() & (F.greatest("a_detections", "b_detections") >= DETECTIONS) & (least >= SCALE * most)
    s = F.when(F.col("a_label").eqNullSafe(F.col("b_label")), alike).when(flicker, n / least / OVERLAP).otherwise(0.0)
    return j.select("a", "b", s.alias("s")).where("s >= 1")


def merged(cells: DataFrame, sightings: DataFrame, marks: DataFrame) -> DataFrame:
    """(id, object) of every object: which one it ends in, the lowest id of those merged.

    `cells`: id, x, y, z (whole numbers). `sightings`: id, frame, label. `marks`: id, touched, published (null: none).
    Equal strengths go by the lower ids. Ids are whole numbers from 0. Objects without cells keep themselves.
    """
    alias = _written(marks.select("id", F.col("id").alias("object"), F.coalesce("touched", F.lit(False)).alias("touched"), "published"))
    known = alias.select(F.col("id").alias("obj")).distinct()
    first = _described({
        "cells": cells.select(F.col("id").alias("obj"), *AXES).join(known, "obj", "left_semi"),
        "frames": sightings.select(F.col("id").alias("obj"), "frame").join(known, "obj", "left_semi"),
        "votes": sightings.groupBy(F.col("id").alias("obj"), "label").agg(F.count(F.lit(1)).alias("votes")).join(known, "obj", "left_semi"),
        "marks": alias.select(F.col("id").alias("obj"), "touched", "published"),
    })
    # The objects at first are written once; merged ones stand beside them, and a round describes and writes only what it would merge.
    gone, fresh = known.limit(0), {name: table.limit(0) for name, table in first.items()}
    now = lambda: {name: table.join(gone, "obj", "left_anti").unionByName(fresh[name]) for name, table in first.items()}
    edges = _written(strengths(first, first))
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("n"), "a", "b", "s").union(edges.select(F.col("b").alias("n"), "a", "b", "s"))
        best = ends.groupBy("n").agg(F.min(F.struct((-F.col("s")).alias("s"), "a", "b")).alias("e"))
        tried = _written(best.groupBy("e").agg(F.count(F.lit(1)).alias("_k")).where("_k = 2").select("e.a", "e.b", (-F.col("e.s")).alias("s")))
        # What the tried pairs would make stands beside the objects, under keys of its own: -1 - the lower id.
        part = _written(tried.select(F.explode(F.array("a", "b")).alias("obj"), F.col("a").alias("pair")))
        held = now()
        made = _described({name: held[name].join(part, "obj").withColumn("obj", -1 - F.col("pair")).drop("pair") for name in ("cells", "frames", "votes", "marks")})
        new = strengths(made, {name: table.unionByName(made[name]) for name, table in held.items()})
        new = new.select((-1 - F.col("a")).alias("p"), F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("q"), (F.col("b") < 0).alias("made"), "s")
        new = _written(new.join(part.select(F.col("pair").alias("p"), F.col("obj").alias("q")), ["p", "q"], "left_anti"))
        links = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(new.select("p", "q"))
        component = connected_components(links.distinct(), folder=links.sparkSession.sparkContext.getCheckpointDir()).select("node", "component")
        busy = part.select("obj")
        untouched = edges.join(busy, edges["a"] == busy["obj"], "left_anti").join(busy, F.col("b") == busy["obj"], "left_anti")
        limit = new.select(F.col("p").alias("node"), "s").union(untouched.select("a", "s")).join(component, "node").groupBy("component").agg(F.max("s").alias("limit"))
        placed = tried.join(component, F.col("a") == F.col("node")).join(limit, "component", "left")
        top = placed.groupBy("component").agg(F.min(F.struct((-F.col("s")).alias("s"), "a")).alias("top")).select("component", "top.a", F.lit(True).alias("_top"))
        stands = _written(placed.join(top, ["component", "a"], "left").where("_top OR limit IS NULL OR s > limit").select("a", "b"))
        alias = _written(alias.join(stands.select(F.col("b").alias("object"), F.col("a").alias("_keep")), "object", "left").select("id", F.coalesce("_keep", "object").alias("object")))
        ended, kept = stands.select(F.explode(F.array("a", "b")).alias("obj")), stands.select((-1 - F.col("a")).alias("obj"))
        stood = {name: table.join(kept, "obj", "left_semi").withColumn("obj", -1 - F.col("obj")) for name, table in made.items()}
        fresh = {name: _written(table.join(ended, "obj", "left_anti").unionByName(stood[name])) for name, table in fresh.items()}
        gone = _written(gone.union(ended).distinct())
        edges = _written(_left(edges, new, stands))
    return alias.select("id", "object")


def _left(edges: DataFrame, new: DataFrame, stands: DataFrame) -> DataFrame:
    """Pairs after the merges that stand: those that no merge touched, and those of what was made with what is there now."""
    gone = stands.select(F.explode(F.array("a", "b")).alias("_g"))
    kept = stands.select(F.col("a").alias("_k"))
    old = edges.join(gone, F.col("a") == F.col("_g"), "left_anti").join(gone, F.col("b") == F.col("_g"), "left_anti")
    fresh = new.join(kept, F.col("p") == F.col("_k"), "left_semi")
    fresh = fresh.where("made").join(kept, F.col("q") == F.col("_k"), "left_semi").union(fresh.where("NOT made").join(gone, F.col("q") == F.col("_g"), "left_anti"))
    return old.select("a", "b", "s").union(fresh.select(F.least("p", "q"), F.greatest("p", "q"), "s"))
