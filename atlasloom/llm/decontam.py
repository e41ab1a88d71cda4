r"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton is built over item words (its alphabet are word numbers). Documents stream through it: the state and the
longest match that ends at each word are tracked, and a word is hit where an occurrence of a window, `window`
consecutive words of an item (or all words of a shorter item), covers it. The size of the test set is checked: items
are dealt to automata of at most `automaton_words` words each (an item with more has one alone), and documents go through
one after another, with a written table between them, so a task holds one automaton at a time.

Words: A-Z lower-cased, then runs of 0-9, a-z and of characters above ASCII.

Defined cases: null or empty texts have no words and are clean; items without words have no window; repeated items
each count; an empty benchmark leaves every document clean; an empty table gives an empty result. `flagged` ignores
further columns, `cleaned` passes them through.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from atlasloom.llm import common

WINDOW = 10
#: At most some 1,000,000 states, 250 MB in the driver and in each worker.
AUTOMATON_WORDS = 500_000
#: Bytes of words to themselves, lower-cased; all others to a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD_SPAN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Automaton:
    """Generalised suffix automaton over word numbers, with the items of each window."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = []
        for name, text in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words(text)]
            if ids:
                texts.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.shortest = min([window, *(len(ids) for _, ids in texts)])
        #: Items by the state of a window (for items of at least `window` words) and (length, item) by the state of a whole shorter item.
        self.owners: dict[int, set[str]] = {}
        self.shorter: dict[int, list[tuple[int, str]]] = {}
        for name, ids in texts:
            for _, length, state in self.run(ids):
                if length >= window:
                    self.owners.setdefault(self._at(state, window), set()).add(name)
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self.next[state][c]
                self.shorter.setdefault(state, []).append((len(ids), name))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _at(self, state: int, length: int) -> int:
        """The state of the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def run(self, ids: Iterable[int]):
        """(position, longest match that ends there, its state) for each word."""
        nxt, link, lengths = self.next, self.link, self.length
        state = length = 0
        for k, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                length = lengths[state]
            if c in nxt[state]:
                state = nxt[state][c]
                length += 1
            yield k, length, state

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Hit word ranges (maximal, in order), items with occurring windows, longest match."""
        ids = list(map(self.number.get, found))
        known = bytes([i is not None for i in ids]) if None in ids else b"\1" * len(ids)
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        longest = 0

        def cover(start: int, end: int) -> None:
            while spans and start <= spans[-1][1]:
                a, b = spans.pop()
                start, end = min(a, start), max(b, end)
            spans.append((start, end))

        for run in re.finditer(b"\1{%d,}" % max(1, self.shortest), known):
            at = run.start()
            for k, length, state in self.run(ids[at : run.end()]):
                if length < self.shortest:
                    continue
                longest = max(longest, length)
                if length >= self.window:
                    items |= self.owners[self._at(state, self.window)]
                    cover(at + k + 1 - self.window, at + k + 1)
                if self.shorter:
                    s = state
                    while s > 0:
                        for n, name in self.shorter.get(s, ()):
                            if n <= length:
                                items.add(name)
                                cover(at + k + 1 - n, at + k + 1)
                        s = self.link[s]
        return spans, items, longest


def dealt(benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, item: str = "item_id", text: str = "text") -> Iterable[tuple[Automaton, bool]]:
    """One automaton after another, each with whether it is the last; items stream through the driver, one partition of the test set at a time."""
    held: list[tuple[str, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).cast("binary").alias("t")).where("t IS NOT NULL")
    for r in rows.toLocalIterator():
        n = len(words(bytes(r.t)))
        if held and size + n > automaton_words:
            yield Automaton(held, window), False
            held, size = [], 0
        held.append((r.i if r.i is not None else "", bytes(r.t)))
        size += n
    yield Automaton(held, window), True


def flagged(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_words: int = AUTOMATON_WORDS, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """For every row: (keep..., n_words, hit_start, hit_end (word ranges), item_ids (sorted), longest)."""
    spark = docs.sparkSession
    common.ship(spark)
    names = [f"_k{k}" for k in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text).cast("binary").alias("_text"), F.lit(None).cast("array<int>").alias("_s"), F.lit(None).cast("array<int>").alias("_e"), F.lit(None).cast("array<string>").alias("_i"), F.lit(0).alias("_l"), F.lit(0).cast("long").alias("_n"))
    out = rows
    for automaton, last in dealt(benchmark, window, automaton_words):
        shared = spark.sparkContext.broadcast(automaton)

        def stream(batches, shared=shared):
            machine = shared.value
            for batch in batches:
                at = batch.schema.get_field_index("_text")
                starts, ends, items, longest, n = [], [], [], [], []
                before = [c.to_pylist() for c in batch.columns[at + 1 : at + 5]]
                for k, t in enumerate(batch.column(at)):
                    found = words(t.as_py() or b"")
                    spans, got, most = machine.hits(found)
                    s, e, i, most0 = (b[k] for b in before)
                    if s:
                        spans = merged([*zip(s, e, strict=True), *spans])
                        got |= set(i)
                    starts.append([a for a, _ in spans])
                    ends.append([b for _, b in spans])
                    items.append(sorted(got))
                    longest.append(max(most, most0))
                    n.append(len(found))
                yield pa.RecordBatch.from_arrays([*batch.columns[: at + 1], pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string())), pa.array(longest, pa.int32()), pa.array(n, pa.int64())], names=batch.schema.names)

        out = out.mapInArrow(common.lean(stream), rows.schema)
        out = out if last else common.written(out, "decontam-flagged")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], F.col("_n").alias("n_words"), F.col("_s").alias("hit_start"), F.col("_e").alias("hit_end"), F.col("_i").alias("item_ids"), F.col("_l").alias("longest"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: str, machine_spans: list[tuple[int, int]]) -> str:
    """The text without the bytes from the first to the last word of each range."""
    data = text.encode()
    at = np.array([m.span() for m in WORD_SPAN.finditer(data)], np.int64)
    out, last = [], 0
    for a, b in machine_spans:
        out.append(data[last : at[a][0]])
        last = at[b - 1][1]
    out.append(data[last:])
    return b"".join(out).decode(errors="replace")


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, automaton_words: int = AUTOMATON_WORDS, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """The documents without contaminated spans; a document with more than `most_coverage` of its words hit goes as a whole.

    A span is contaminated if it is matched over `window` words, or over a whole shorter item. Spans of all automata are
    gathered on the untouched text; coverage is judged, and the text cut, once, with the last one. Rows without a hit are
    passed on unchanged, null texts too; where the text changes, `chars` (if there is such a column) is counted anew.
    """
    spark = docs.sparkSession
    common.ship(spark)
    names = docs.columns
    width, at, count = len(names), names.index(text), names.index(chars) if chars in names else None
    positional = docs.toDF(*[f"_c{k}" for k in range(width)])
    plain = positional.schema
    carried = StructType([*plain.fields, StructField("_s", ArrayType(IntegerType())), StructField("_e", ArrayType(IntegerType()))])
    first = True
    for automaton, last in dealt(benchmark, window, automaton_words):
        shared = spark.sparkContext.broadcast(automaton)

        def stream(batches, shared=shared, first=first, last=last):
            machine = shared.value
            for batch in batches:
                own, kinds = batch.columns[:width], list(batch.schema)[:width]
                before = None if first else [c.to_pylist() for c in batch.columns[width:]]
                starts, ends, keep, texts = [], [], [], {}
                for k, t in enumerate(own[at]):
                    t = t.as_py()
                    found = words(t.encode()) if t else []
                    spans, _, _ = machine.hits(found)
                    if before and before[0][k]:
                        spans = merged([*zip(before[0][k], before[1][k], strict=True), *spans])
                    if not last:
                        starts.append([a for a, _ in spans])
                        ends.append([b for _, b in spans])
                        continue
                    hit = sum(b - a for a, b in spans)
                    keep.append(hit <= most_coverage * len(found))
                    if hit and keep[-1]:
                        texts[k] = without(t, spans)
                if not last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))], names=[*[f.name for f in kinds], "_s", "_e"])
                    continue
                if texts:
                    values = own[at].to_pylist()
                    for k, t in texts.items():
                        values[k] = t
                    own[at] = pa.array(values, kinds[at].type)
                    if count is not None:
                        sizes = own[count].to_pylist()
                        for k, t in texts.items():
                            sizes[k] = len(t)
                        own[count] = pa.array(sizes, kinds[count].type)
                yield pa.RecordBatch.from_arrays(own, schema=pa.schema(kinds)).filter(pa.array(keep, pa.bool_()))

        positional = positional.mapInArrow(common.lean(stream), plain if last else carried)
        positional = positional if last else common.written(positional, "decontam-cleaned")
        first = False
    return positional.toDF(*names)
