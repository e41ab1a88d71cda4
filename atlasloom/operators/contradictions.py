"""Depth contradictions between frames: verdicts on pairs, and rounds that mark stored frames or reject new ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.operators.graph import _cut

#: Points that make a direction count, share that confirms, share under which a contradiction is clear, points that make one between the two.
LEAST_POINTS, CONFIRMS, CLEAR, MANY_THROUGH = 40, 0.9, 0.75, 100
#: Frames that mark a stored one, share of rejected frames that leaves no consistent part, rounds that may be applied.
QUORUM, MOST_REJECTED, ROUNDS = 3, 0.5, 3
DECISIONS = "name string, decision string, with array<string>"


def judged(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, agree_ab, through_ab, agree_ba, through_ba) with `fails`, `agrees`, `ratio_ab` and `ratio_ba`.

    A direction counts from 40 points that agree or see through. It fails where under 90 % agree, and either under 75 % do or
    at least 100 see through; a pair fails with either direction, and agrees where none fails and one counts. The ratio
    of a direction that does not count is null; a null count is 0.
    """
    def way(d: str) -> tuple[Column, Column]:
        agree, through = (F.coalesce(F.col(f"{c}_{d}"), F.lit(0)) for c in ("agree", "through"))
        n = agree + through
        counts = n >= LEAST_POINTS
        return F.when(counts, agree / n), counts & (agree < CONFIRMS * n) & ((agree < CLEAR * n) | (through >= MANY_THROUGH))

    (ab, fail_ab), (ba, fail_ba) = way("ab"), way("ba")
    out = pairs.withColumns({"fails": fail_ab | fail_ba, "ratio_ab": ab, "ratio_ba": ba})
    return out.withColumn("agrees", ~F.col("fails") & (F.col("ratio_ab").isNotNull() | F.col("ratio_ba").isNotNull()))


def one_round(pairs: DataFrame, frames: DataFrame, marked: DataFrame, vetoed: DataFrame, folder: str | None = None) -> DataFrame:
    """(name, decision, with): what one round decides on judged pairs; `with` is sorted.

    `frames`: name, new, fixed (stored, and confirmed before this job), refs (names that a new frame's place rests on).
    `marked`, `vetoed`: names that earlier rounds marked, or unmarked.

    * `mark`, `keep`, `veto`: a fixed stored frame is suspect where three new frames fail with it that fail with no other
      sound frame, agree with a sound one of their references and with one that is none, and don't fail with each other. One
      marked before is kept so, or unmarked for good. Sound is what is fixed and was not marked before the round.
    * `reject`: a new frame that fails with a stored one that is not suspect; only where there is none, both new frames of
      each failing pair.
    * `depend`: a new frame all of whose references are rejected, and so on along chains.

    What a frame fails or agrees with is one sum by frame, so no pairs of pairs arise but those of the few suspects.
    """
    ways = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"), "fails", "agrees").select(F.col("e.a").alias("n"), F.col("e.b").alias("s"), "fails", "agrees")
    new = frames.where("new").select(F.col("name").alias("n"), F.coalesce("refs", F.array().cast("array<string>")).alias("refs"))
    was = marked.select(F.col("name").alias("s"), F.lit(True).alias("was")).distinct()
    stored = frames.where("NOT new").select(F.col("name").alias("s"), F.coalesce("fixed", F.lit(False)).alias("fixed")).join(was, "s", "left")
    stored = stored.withColumn("was", F.coalesce("was", F.lit(False))).withColumn("sound", F.col("fixed") & ~F.col("was"))
    met = _cut(ways.join(new, "n").join(stored, "s").withColumn("in_refs", F.array_contains("refs", F.col("s"))).drop("refs"), folder)
    view = met.where("sound").groupBy("n").agg(F.count_if("fails").alias("failing"), F.bool_or(F.col("agrees") & F.col("in_refs")).alias("anchored"), F.bool_or(F.col("agrees") & ~F.col("in_refs")).alias("free"))
    votes = met.where("fails AND fixed").join(view, "n").where("anchored AND free AND failing = CAST(sound AS INT)").join(vetoed.select(F.col("name").alias("s")), "s", "left_anti").select("s", "n")
    rivals = ways.where("fails").select("n", F.col("s").alias("other"))
    torn = votes.join(rivals, "n").join(votes.select("s", F.col("n").alias("other")), ["s", "other"]).select("s").distinct()
    suspects = votes.groupBy("s").agg(F.sort_array(F.collect_list("n")).alias("with")).where(F.size("with") >= QUORUM).join(torn, "s", "left_anti")
    suspects = _cut(suspects, folder)
    marks = suspects.join(was, "s", "left").select(F.col("s").alias("name"), F.when(F.col("was"), "keep").otherwise("mark").alias("decision"), "with")
    open_ = was.join(stored.where("fixed").select("s"), "s").join(vetoed.select(F.col("name").alias("s")), "s", "left_anti")
    vetoes = open_.join(suspects.select("s"), "s", "left_anti").select(F.col("s").alias("name"), F.lit("veto").alias("decision"), F.array().cast("array<string>").alias("with"))
    hit = met.where("fails").join(suspects.select("s"), "s", "left_anti").select("n", F.col("s").alias("other"))
    if hit.isEmpty():
        both = ways.where("fails").join(new.select("n"), "n").join(new.select(F.col("n").alias("s")), "s")
        hit = both.select("n", F.col("s").alias("other"))
    gone = _cut(hit.groupBy(F.col("n").alias("name")).agg(F.lit("reject").alias("decision"), F.array_sort(F.collect_set("other")).alias("with")), folder)
    rests = new.where(F.size("refs") > 0).select("n", F.array_distinct("refs").alias("refs")).withColumn("ref", F.explode("refs"))
    front = gone
    while not front.isEmpty():
        lost = rests.join(gone.select(F.col("name").alias("ref")), "ref").groupBy("n").agg(F.count(F.lit(1)).alias("lost"), F.first("refs").alias("refs")).where("lost = size(refs)")
        lost = lost.select(F.col("n").alias("name"), F.lit("depend").alias("decision"), F.array_sort("refs").alias("with"))
        front = _cut(lost.join(gone.select("name"), "name", "left_anti"), folder)
        gone = _cut(gone.unionByName(front), folder)
    return marks.unionByName(vetoes).unionByName(gone)


def resolved(pairs: DataFrame, frames: DataFrame, rounds: int = ROUNDS, most: float = MOST_REJECTED, folder: str | None = None) -> DataFrame:
    """(name, decision, with, round, applied): the decisions of all rounds until one changes nothing.

    A rejected frame and its pairs leave before the next round; a suspect frame stays and no longer counts against new ones.
    Where over `most` of the new frames would be rejected in all, or a decision is open after `rounds` rounds, the last round
    is reported as not applied: no consistent part remains. Pairs keep their counts; whoever places frames anew between
    rounds calls `one_round` with new ones. A null or unknown name takes part in nothing; equal pairs count as one.
    """
    names = lambda rows: rows.select("name")
    frames = _cut(frames.where("name IS NOT NULL").withColumn("new", F.coalesce("new", F.lit(False))), folder)
    pairs = _cut(judged(pairs.where("a <> b")).select("a", "b", "fails", "agrees").distinct(), folder)
    first = frames.where("new").count()
    empty = names(frames.limit(0))
    marked, vetoed, rejected, out = empty, empty, empty, None
    for number in range(1, rounds + 2):
        live = frames.join(rejected, "name", "left_anti")
        kept = pairs.join(rejected.withColumnRenamed("name", "a"), "a", "left_anti").join(rejected.withColumnRenamed("name", "b"), "b", "left_anti")
        now = _cut(one_round(kept, live, marked, vetoed, folder), folder)
        gone = names(now.where("decision IN ('reject', 'depend')"))
        changes = now.where("decision <> 'keep'").count()
        crossed = rejected.count() + gone.count() > most * first
        applied = not changes or not (crossed or number > rounds)
        found = now.withColumns({"round": F.lit(number), "applied": F.lit(applied)})
        out = found if out is None else out.unionByName(found)
        if not changes or not applied:
            break
        unmarked = names(now.where("decision = 'veto'"))
        marked = _cut(marked.join(unmarked, "name", "left_anti").union(names(now.where("decision = 'mark'"))).distinct(), folder)
        vetoed, rejected = _cut(vetoed.union(unmarked), folder), _cut(rejected.union(gone), folder)
    return out
