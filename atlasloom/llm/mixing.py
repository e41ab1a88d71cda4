r"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Token shares of the sources are raised to an exponent and normalised. The exponent, between 0 (all alike) and 1 (as
they are), is bisected until the weights have a target entropy, or until they are the flattest that no source has to be
repeated beyond a limit for. The budget is such that every document comes at least once: the source that the weights
favour least is taken exactly once, every other one `quota / tokens` times, so whole epochs and one part of an epoch.
The part is cut at a hash value found by refining 256 hash ranges, and places are counted in hash ranges of which there
are several for each partition, so no source is ever sorted in one place.

The mixed stream is a row of blocks. Each takes from every source its weight's share of `block_tokens`, and its rows
are permuted by hash; within an epoch a source's rows are permuted anew.

Tokens are words, `[^\x20\x09-\x0D]+`, unless an expression is given. What is collected has a row for each source (at
most `most_sources`, else it raises) and for each source and one of 256 hash ranges.

Defined cases: a null source is a source of its own; null texts have no tokens and come as often as their source's
whole epochs (and its part, by hash); a source without tokens, and so a corpus without any, comes once, dealt over all
blocks by hash; a source that a target would repeat more than `MOST_TIMES` times is an error; repeated rows
come each as often as one; an empty table gives an empty result; further columns pass through `repeated`.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common

RANGES = 256
MOST_SOURCES = 100_000
#: Repetitions of a source beyond which a plan is refused.
MOST_TIMES = 100_000


def word_count(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(common.text_or_empty(text), rf"{common.SPACE_CLASS}+"), "")).cast("long")


def draw(seed: int, *cols) -> Column:
    """A number from 0 to 2^62 - 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 2)


def weights(tokens: list[float], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t > 0 else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def spread(tokens: list[float], w: list[float]) -> float:
    """How often the most repeated source comes while the least repeated one comes once."""
    times = [x / t for t, x in zip(tokens, w, strict=True) if t > 0]
    return max(times) / min(times)


def exponent(tokens: list[float], target_entropy: float | None = None, repetition: float | None = None) -> float:
    """Bisected: entropy and repetition both fall as the exponent grows from 0 to 1."""
    if sum(t > 0 for t in tokens) < 2:
        return 1.0
    small = (lambda a: entropy(weights(tokens, a)) <= target_entropy) if target_entropy is not None else (lambda a: spread(tokens, weights(tokens, a)) <= repetition)
    if small(0.0):
        return 0.0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if small(mid) else (mid, hi)
    return hi


@dataclass
class Plan:
    """Per source: (source, tokens, weight, quota in tokens, whole epochs, hash below which a row comes once more)."""

    exponent: float
    budget: float
    sources: list[tuple]

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.sources, "s string, source_tokens bigint, weight double, quota double, whole int, cut bigint")


def slim(docs: DataFrame, seed: int, key: str, source: str, text: str, tokens: Column | None) -> DataFrame:
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), (word_count(text) if tokens is None else tokens).alias("tokens"), draw(seed, F.col(key), F.col(text)).alias("h"))


def plan(rows: DataFrame, target_entropy: float | None = None, repetition: float | None = 4.0, most_sources: int = MOST_SOURCES) -> Plan:
    """From `slim` rows, which are read once for the shares and once for each of the three refinements of the cuts."""
    found = rows.groupBy("source").agg(F.sum("tokens").alias("t")).limit(most_sources + 1).collect()
    if len(found) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    names, tokens = [r.source for r in found], [int(r.t or 0) for r in found]
    if not sum(tokens):
        return Plan(1.0, 0.0, [(n, 0, 0.0, 0.0, 1, 0) for n in names])
    a = exponent(tokens, target_entropy, repetition if target_entropy is None else None)
    w = weights(tokens, a)
    budget = max(t / x for t, x in zip(tokens, w, strict=True) if t)
    quota = [x * budget for x in w]
    whole = [max(1, math.floor(q / t + 1e-9)) if t else 1 for q, t in zip(quota, tokens, strict=True)]
    if max(whole) > MOST_TIMES:
        raise ValueError(f"the target repeats a source {max(whole)} times")
    left = [max(0.0, q - k * t) for q, k, t in zip(quota, whole, tokens, strict=True)]
    lo, hi = [0] * len(names), [1 << 62] * len(names)
    for _ in range(7):
        # Ranges of the hash values that are left; a row belongs to the part while the tokens before it fit.
        open_ = [k for k in range(len(names)) if left[k] >= 1 and hi[k] - lo[k] > 1]
        if not open_:
            break
        step = {k: max(1, -(-(hi[k] - lo[k]) // RANGES)) for k in open_}
        at = rows.sparkSession.createDataFrame([(k, names[k], lo[k], hi[k], step[k]) for k in open_], "k int, s string, lo bigint, hi bigint, step bigint")
        inside = rows.join(F.broadcast(at), F.col("source").eqNullSafe(F.col("s"))).where("h >= lo AND h < hi")
        sums: dict[int, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy("k", F.expr("(h - lo) div step").alias("range")).agg(F.sum("tokens").alias("t"), F.countDistinct("h").alias("n")).collect():
            sums.setdefault(r.k, {})[r.range] = (r.t, r.n)
        for k in open_:
            base, before = lo[k], left[k]
            lo[k] = hi[k]
            for r in sorted(sums.get(k, {})):
                t, n = sums[k][r]
                if t > before:
                    lo[k], hi[k] = base + r * step[k], min(hi[k], base + (r + 1) * step[k])
                    if n == 1:
                        hi[k] = lo[k]
                    break
                before -= t
            left[k] = before
    return Plan(a, budget, list(zip(names, tokens, w, quota, whole, lo, strict=True)))


def _times(rows: DataFrame, made: Plan, source: str, h: Column) -> DataFrame:
    """Rows once for each epoch they belong to, with `epoch`; only the plan is broadcast, a row for each source."""
    at = made.frame(rows.sparkSession)
    joined = rows.join(F.broadcast(at), rows[source].cast("string").eqNullSafe(at["s"]))
    return joined.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole") - 1 + F.when((F.col("cut") > 0) & (h < F.col("cut")), 1).otherwise(0))))


def placed(docs: DataFrame, target_entropy: float | None = None, repetition: float | None = 4.0, block_tokens: int = 1_000_000, seed: int = 1, key: str = "doc_id", source: str = "source", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """(key, source, n_tokens, epoch, block, place) of every row of the mixed stream; the text is not moved."""
    rows = common.written(slim(docs, seed, key, source, text, tokens), "mixing-rows")
    made = plan(rows, target_entropy, repetition)
    times = _times(rows, made, "source", F.col("h")).select("key", "source", "tokens", "weight", "epoch", draw(seed, F.col("h"), F.col("epoch")).alias("e"))
    bits = max(8, min(16, math.ceil(math.log2(4 * common.partitions(docs.sparkSession)))))
    times = times.withColumn("range", F.shiftright("e", 62 - bits))
    sums = times.groupBy("source", "epoch", "range").agg(F.sum("tokens").alias("t"))
    from pyspark.sql import Window

    before = Window.partitionBy("source").orderBy("epoch", "range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("source").alias("_s"), F.col("epoch").alias("_e"), F.col("range").alias("_r"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("e", "key").rowsBetween(Window.unboundedPreceding, -1)
    run = times.withColumn("in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    run = run.join(bases, F.col("source").eqNullSafe(F.col("_s")) & (F.col("epoch") == F.col("_e")) & (F.col("range") == F.col("_r")))
    blocks = max(1, math.floor(made.budget / block_tokens))
    block = F.when(F.col("weight") > 0, F.floor((F.col("base") + F.col("in")) / (F.col("weight") * block_tokens))).otherwise(F.pmod("e", F.lit(blocks))).cast("long")
    order = Window.partitionBy("block").orderBy("p", "key", "epoch")
    out = run.withColumn("block", block).withColumn("p", draw(seed, F.col("block"), F.col("e")))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.col("tokens").alias("n_tokens"), "epoch", "block", (F.row_number().over(order) - 1).cast("long").alias("place"))


def repeated(docs: DataFrame, target_entropy: float | None = None, repetition: float | None = 4.0, seed: int = 1, key: str = "doc_id", source: str = "source", text: str = "text", tokens: Column | None = None) -> DataFrame:
    """The documents as often as the mix takes them, with the input's columns; no text is shuffled."""
    made = plan(common.written(slim(docs, seed, key, source, text, tokens), "mixing-rows"), target_entropy, repetition)
    names = {c: f"_{uuid.uuid4().hex}" for c in docs.columns}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    out = _times(renamed, made, names[source], draw(seed, F.col(names[key]), F.col(names[text])))
    return out.select(*[F.col(n).alias(c) for c, n in names.items()])
