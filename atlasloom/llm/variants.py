r"""Spelling variant grouping: words one edit apart, found through the two halves of every word.

Words are maximal runs of letters, counted over whole texts; the frequent and long enough ones are the vocabulary. If two
words differ by one inserted, deleted or replaced code point, one of the two halves of the shorter one stands unchanged at
its end of the other. So shards of the halves are Aho-Corasick automata: all words that may hold one of a shard's halves
are scanned, a half counts where its offset and the lengths fit, and the rest of both words is compared.

* A half is dealt to a shard by its hash, and a word goes to the shards of the halves that it can hold at a fitting
  offset: four at most, whatever the size of the vocabulary. Scanning it elsewhere could find nothing.
* A half that more than `most` words hold is replaced by two longer segments, each with half of the rest, until no
  segment has more or the rest is one letter (as many words as there are letters). No list of one segment meets in one task.
* Words that hold the same segment are compared by their rests: replaced letters by rests with one place left out,
  inserted ones by looking up what deletions give. No pairs are made, so a frequent segment costs its words, not their square.

A word's form is its near word of largest count, if that is `ratio` times the word's; roots follow forms by doubling.

Defined cases: null and empty texts have no words; a null key counts as the empty string in `edit`; repeated rows count
each; an empty table, or one without frequent words, gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common

#: Letters: A-Z, a-z and U+00C0 to U+00FF (fixed values); only A-Z are lower-cased.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Words that a counting task holds before it hands them on; rows of a shard, about.
HELD, SHARD_ROWS = 200_000, 50_000
#: Letters of a rest that are left out one by one.
REST = 16

Edit = Callable[[str, str], str]


def lowered(run: str) -> str:
    return run if run.islower() else run.lower() if run.isascii() else run.translate(LOWER)


def counted(docs: DataFrame, shortest: int = 1, edit: Edit | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all lower-cased runs of letters with `shortest` code points or more. `edit` gets a row's key, as text, and each of its distinct runs, and returns what counts instead."""
    common.ship(docs.sparkSession)

    def run(batches):
        total: dict[str, int] = {}

        def flushed():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for w, n in Counter(RUN.findall(t.as_py() or "")).items():
                    w = lowered(w)
                    if edit:
                        w = edit(i or "", w)
                    if len(w) >= shortest:
                        total[w] = total.get(w, 0) + n
                if len(total) > HELD:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.col(key).cast("string"), F.col(text).cast("string"))
    return rows.mapInArrow(common.lean(run), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


#: Where a segment's rest lies, and its key: `d` letters more are in the rest of a longer word that holds the segment.
_KEY = "xxhash64(size, lo, hi, substring(word, 1, lo), substring(word, hi + d + 1))"
_COLUMNS = ("word", "n", "size", "d", "lo", "hi")


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(*_COLUMNS, F.expr(_KEY).alias("key"))


def _halves(words: DataFrame, shortest: int) -> DataFrame:
    """Two segments of each word (d = 0), and the two that a word one letter shorter would share with it (d = 1)."""
    sized = words.select("word", "n", F.char_length("word").alias("length"))
    kinds = F.expr("explode(array(0, 1)) AS d")
    of = sized.select("*", kinds).selectExpr("word", "n", "length - d AS size", "d").where(F.col("size") >= shortest)
    return _keyed(of.selectExpr("word", "n", "size", "d", "explode(array(struct(size div 2 AS lo, size AS hi), struct(0 AS lo, size div 2 AS hi))) AS s").selectExpr("word", "n", "size", "d", "CAST(s.lo AS INT) AS lo", "CAST(s.hi AS INT) AS hi"))


def _segments(words: DataFrame, shortest: int, most: int) -> DataFrame:
    """Rows of all segments that at most `most` words hold (or whose rest is one letter)."""
    rows, out = _halves(words, shortest), []
    while True:
        frequent = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.max(F.expr("hi - lo")).alias("rest")).where((F.col("c") > most) & (F.col("rest") > 1)).select("key")
        frequent = common.written(frequent, "variants-frequent")
        if frequent.isEmpty():
            return _together([*out, rows])
        out.append(rows.join(frequent, "key", "left_anti").select(*_COLUMNS, "key"))
        finer = rows.join(frequent, "key", "left_semi").selectExpr("word", "n", "size", "d", "explode(IF(hi - lo > 1, array(struct(lo, (lo + hi) div 2 AS hi), struct((lo + hi) div 2 AS lo, hi)), array(struct(lo, CAST(hi AS BIGINT) AS hi)))) AS s")
        rows = common.written(_keyed(finer.selectExpr("word", "n", "size", "d", "CAST(s.lo AS INT) AS lo", "CAST(s.hi AS INT) AS hi")), "variants-finer")


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


class Near:
    """Counts of near words, and the best of each: the largest count, then the smallest word."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.near: dict[int, list] = {}

    def add(self, a: int, n: int, best: int) -> None:
        got = self.near.setdefault(a, [0, best])
        got[0] += n
        got[1] = min(got[1], best, key=self.rank)

    def rank(self, a: int) -> tuple[int, str]:
        return -self.counts[a], self.words[a]

    def compare(self, lo: int, hi: int, size: int, same: list[int], longer: list[int]) -> None:
        """Words of one segment: `same` have its length, `longer` one letter more in the rest from `lo`. A long rest is halved until few letters are left."""
        if len(same) + len(longer) < 2 or not same:
            return
        if hi - lo > REST:
            middle = (lo + hi) // 2
            for a, b, c, d in ((lo, middle, middle, hi), (middle, hi, lo, middle)):
                parts: dict[str, tuple[list[int], list[int]]] = {}
                for more, members in enumerate((same, longer)):
                    shift = more if c == middle else 0
                    for w in members:
                        parts.setdefault(self.words[w][c + shift : d + shift], ([], []))[more].append(w)
                for kinds in parts.values():
                    self.compare(a, b, size, *kinds)
            return
        rests: dict[str, int] = {}
        open_: dict[tuple[int, str], list[int]] = {}
        for a in same:
            rest = self.words[a][lo:hi]
            rests[rest] = a
            for k in range(len(rest)):
                open_.setdefault((k, rest[:k] + rest[k + 1 :]), []).append(a)
        for found in open_.values():
            if len(found) > 1:
                first, second = sorted(found, key=self.rank)[:2]
                for a in found:
                    self.add(a, len(found) - 1, second if a == first else first)
        for b in longer:
            rest = self.words[b][lo : hi + 1]
            for k, c in enumerate(rest):
                # Of equal letters in a row, deleting the last stands for all; a place at the end of the rest belongs to the next segment.
                if (k + 1 < len(rest) and rest[k + 1] != c) or (k + 1 == len(rest) and hi == size):
                    a = rests.get(rest[:k] + rest[k + 1 :])
                    if a is not None:
                        self.add(a, 1, b)
                        self.add(b, 1, a)


def near_words(rows: list[tuple[str, int, int, int, int, int]]) -> Near:
    """The near words within a shard of (word, n, size, d, lo, hi)."""
    number: dict[str, int] = {}
    counts: list[int] = []
    held: dict[str, dict[tuple[int, int, int], dict[str, tuple[list[int], list[int]]]]] = {}
    for word, n, size, d, lo, hi in rows:
        if number.setdefault(word, len(counts)) == len(counts):
            counts.append(n)
        if not d:
            first, last = word[:lo], word[hi:]
            segment, other = (first, last) if lo >= size - hi else (last, first)
            held.setdefault(segment, {}).setdefault((size, lo, hi), {}).setdefault(other, ([], []))
    out = Near(list(number), counts)
    if not held:
        return out
    automaton = ahocorasick.Automaton()
    for segment in held:
        automaton.add_word(segment, segment)
    automaton.make_automaton()
    for word, a in number.items():
        n = len(word)
        for end, segment in automaton.iter(word):
            for (size, lo, hi), others in held[segment].items():
                d = n - size
                if d not in (0, 1):
                    continue
                if lo >= size - hi:
                    if end + 1 != len(segment):
                        continue
                    found = others.get(word[hi + d :])
                else:
                    if end + 1 != n:
                        continue
                    found = others.get(word[:lo])
                if found:
                    found[d].append(a)
    for kinds in held.values():
        for (size, lo, hi), others in kinds.items():
            for same, longer in others.values():
                out.compare(lo, hi, size, same, longer)
    return out


def _shards(batches):
    rows: list[tuple] = []
    for batch in batches:
        rows += zip(*(c.to_pylist() for c in batch.columns), strict=True)
    found = near_words(rows)
    near = found.near.items()
    yield pa.RecordBatch.from_arrays([pa.array([found.words[a] for a, _ in near], pa.string()), pa.array([n for _, (n, _) in near], pa.int64()), pa.array([found.counts[b] for _, (_, b) in near], pa.int64()), pa.array([found.words[b] for _, (_, b) in near], pa.string())], names=["word", "n_near", "best_n", "best"])


def grouped(words: DataFrame, shortest: int = 6, ratio: int = 5, most: int = 20_000) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary of distinct (word, n), whose words have `shortest` code points or more."""
    spark = words.sparkSession
    common.ship(spark)
    words = common.written(words.select("word", "n").where(F.char_length("word") >= shortest), "variants-words")
    segments = _segments(words, shortest, most)
    shards = max(common.partitions(spark), 4 * words.count() // SHARD_ROWS)
    found = segments.repartition(shards, "key").select(*_COLUMNS).mapInArrow(common.lean(_shards), "word string, n_near bigint, best_n bigint, best string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))
    all_ = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.expr(f"IF(-best.n >= {ratio} * n, best.word, NULL) AS form"), F.expr(f"IF(-best.n >= {ratio} * n, -best.n, NULL) AS form_n"))
    all_ = common.written(all_, "variants-forms")
    roots = _roots(all_.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    return all_.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def _roots(steps: DataFrame) -> DataFrame:
    """Where each chain of steps ends; each round doubles the steps taken. Counts grow along a chain, so there are no cycles."""
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = common.written(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-roots")
        steps = found.select("word", "root")
        if found.where("moved").isEmpty():
            return steps
