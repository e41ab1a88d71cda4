r"""Periodic run detection by harmonic grid probing, over whole texts.

A run is a stretch of consecutive words with smallest period p, of `least` words or more and of two periods or more, that
no neighbouring word extends. For each period p, the words at places jp and (j+1)p are tested for equality: a run of
two periods or more holds such a pair. Survivors are extended to both sides, first a few words for all of them at once,
then, where words still agree, by array comparisons of growing chunks. Grid points inside a run that was found already are
skipped: those of the same period, and those of a multiple of its period (two periods that share p + q words are one).

All pairs of a text of n words are n/1 + n/2 + ... + n/(n/2) tests. Short texts are probed together, a unique word
between them; periods up to the square root of the words in hand are probed one by one, longer ones all at once for each j.

Words: `[^\x20\x09-\x0D]+`, numbered from 0; equal words have equal numbers (a dictionary, no hashes).

Defined cases: null and empty texts have no words, no runs and an empty collapsed text; repeated rows each give a row; null
keys are passed on; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common

LEAST = 12
#: Words probed together, texts of more on their own; words that all survivors are extended by at once.
TOGETHER, STEPS = 1 << 20, 8


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and where each text's words begin (with the end)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    return words.filter(pa.array(full)), before[offsets]


def _beyond(w: np.ndarray, i: int, p: int, side: int) -> int:
    """How many places from i, i + side, ... have the same word p places on; chunks grow fourfold."""
    n, size = 0, 64
    while True:
        if side > 0:
            a, b = i + n, min(i + n + size, len(w) - p)
            differ = w[a:b] != w[a + p : b + p]
        else:
            a, b = max(i - n - size + 1, 0), i - n + 1
            differ = (w[a:b] != w[a + p : b + p])[::-1]
        if b <= a:
            return n
        if differ.any():
            return n + int(differ.argmax())
        n += b - a
        size *= 4


class Found:
    """Runs of some texts in a row (a unique word between them), by ascending period."""

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least = w, least
        self.runs: list[tuple[int, int, int]] = []
        self.known: set[tuple[int, int]] = set()
        #: End and period of the run that covers a place and ends last.
        self.end, self.period = np.zeros(len(w), np.int64), np.ones(len(w), np.int64)

    def _inside(self, i, p):
        return (self.end[i] > i + p) & (p % self.period[i] == 0)

    def probe(self, i: np.ndarray, p: np.ndarray) -> None:
        """Survivors by ascending period: places i with w[i] == w[i + p]."""
        free = ~self._inside(i, p)
        i, p = i[free], p[free]
        reach = [np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)]
        for side, n in zip((1, -1), reach, strict=True):
            alive = np.arange(len(i))
            for k in range(1, STEPS + 1):
                at = i[alive] + side * k
                other = at + p[alive]
                ok = (at >= 0) & (other < len(self.w))
                alive, at, other = alive[ok], at[ok], other[ok]
                alive = alive[self.w[at] == self.w[other]]
                if not len(alive):
                    break
                n[alive] = k
        need = np.maximum(p, self.least - p)
        keep = np.flatnonzero((reach[0] + reach[1] + 1 >= need) | (reach[0] == STEPS) | (reach[1] == STEPS))
        for a, q in zip(i[keep].tolist(), p[keep].tolist(), strict=True):
            if not self._inside(a, q):
                self._extend(a, q)

    def _extend(self, i: int, p: int) -> None:
        start = i - _beyond(self.w, i - 1, p, -1) if i else i
        end = i + _beyond(self.w, i, p, 1) + p
        if end - start < max(self.least, 2 * p) or (start, end) in self.known:
            return
        self.known.add((start, end))
        self.runs.append((start, end - start, p))
        later = self.end[start:end] < end
        self.end[start:end][later] = end
        self.period[start:end][later] = p


def periodic_runs(codes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of the texts at `bounds`, by text, start and period."""
    n = np.diff(bounds)
    w = np.insert(codes.astype(np.int64), bounds[1:], -1 - np.arange(len(n)))
    begin = bounds[:-1] + np.arange(len(n))
    longest = int(n.max(initial=0)) // 2
    found, root = Found(w, least), max(1, int(len(w) ** 0.5))
    for p in range(1, min(root, longest) + 1):
        i = np.flatnonzero(w[: len(w) - p : p] == w[p::p]) * p
        if len(i):
            found.probe(i, np.full(len(i), p))
    places, periods = [], []
    for j in range(len(w) // (root + 1)):
        p = np.arange(root + 1, min(longest, (len(w) - 1) // (j + 1)) + 1)
        if not len(p):
            break
        p = p[w[j * p] == w[(j + 1) * p]]
        places.append(j * p)
        periods.append(p)
    if places:
        i, p = np.concatenate(places), np.concatenate(periods)
        order = np.lexsort((i, p))
        found.probe(i[order], p[order])
    start, length, period = np.array(found.runs, np.int64).reshape(-1, 3).T
    text = np.searchsorted(begin, start, side="right") - 1
    order = np.lexsort((period, start, text))
    return text[order], (start - begin[text])[order], length[order], period[order]


def _batch_runs(words: pa.Array, at: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Runs of a batch: texts of like length are probed together."""
    n = np.diff(at)
    codes = words.dictionary_encode().indices.to_numpy() if len(words) else np.empty(0, np.int32)
    order = np.argsort(n, kind="stable")
    order = order[n[order] >= least]
    out, k = [(np.empty(0, np.int64),) * 4], 0
    while k < len(order):
        size = np.cumsum(n[order[k:]])
        alike = np.searchsorted(n[order[k:]], max(64, 2 * n[order[k]]), side="right")
        chosen = order[k : k + max(1, min(int(np.searchsorted(size, TOGETHER, side="right")), int(alike)))]
        k += len(chosen)
        part = np.concatenate([codes[at[d] : at[d + 1]] for d in chosen])
        text, *rest = periodic_runs(part, np.concatenate([[0], np.cumsum(n[chosen])]), least)
        out.append((chosen[text], *rest))
    text, start, length, period = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((period, start, text))
    return text[order], start[order], length[order], period[order]


def _collapsed(words: pa.Array, at: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> pa.Array:
    """The words that no run holds after its first period, joined by one space."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, at[text] + start + period, 1)
    np.add.at(change, at[text] + start + length, -1)
    kept = np.cumsum(change[:-1]) == 0
    offsets = np.concatenate([[0], np.cumsum(kept)])[at].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))


def runs(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, runs, collapsed) for every row: its runs by start and period, and the text with each run cut to its first period."""
    common.ship(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    shape = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            words, at = split(batch.column(1))
            found = _batch_runs(words, at, least)
            which, *columns = found
            offsets = np.searchsorted(which, np.arange(len(batch) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(shape)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), lists, _collapsed(words, at, *found).cast(pa.string())], names=["k", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(common.lean(run), f"k {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string").withColumnRenamed("k", key)
