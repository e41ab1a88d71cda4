r"""Substring dedup over words: removes every word of a window of `window` words that starts in an earlier document too.

Suffix automata of reference shards give matching statistics: for each window, the smallest document that it starts in.
Sending every document through every shard would be quadratic, so passages go to the one shard that can match them:

* Of the word `GRAM`-grams of a window, the one with the smallest hash is its anchor; equal windows have equal anchors. The
  windows of one anchor in a row are a context. Documents are dealt to slots, and a slot sends each of its anchors once,
  so a passage in a third of all documents is as many anchors as there are slots. Anchors in two documents are shared.
* A slot sends the distinct contexts of its shared anchors, with their smallest document, to the anchor's shard. An anchor
  in over `hot` documents is split: each of its windows goes to the shard of its own hash, so no anchor gathers its contexts.
* A shard builds a generalised suffix automaton of its distinct contexts, over word numbers from a dictionary, so words are
  compared, not hashes. A state knows the smallest document of its occurrences; the contexts stream through, and where the
  match is `window` words long, its state's document goes back to the slots.
* Slots cover the windows that an earlier document has, and cut the words out.

Hashes only choose shards: a collision costs work, never a wrong word. A shard has some 100,000 words, whatever the input.

Words: `[^\x20\x09-\x0D]+`, unchanged. Matches never cross documents, and windows are judged on the input.

Defined cases: null and empty texts have no words; keys are integers, a null key comes before all others and never after
itself; rows with the same key are no earlier documents to each other; equal rows have equal results; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common
from atlasloom.llm.jaccard import M4, SPACE, mix, word_hashes

WINDOW, GRAM = 13, 6
CHUNK_BYTES = 2 << 20
#: Input bytes for each task, slot and shard.
TASK_BYTES, SLOT_BYTES, SHARD_BYTES = 128 << 20, 4 << 20, 512 << 10
#: Documents of an anchor beyond which its windows are dealt one by one.
HOT = 2000
NONE = -(1 << 63)
#: The low bits of an anchor carry how many documents of a slot have it, then whether it is hot.
LOW = np.uint64(255)


class Texts:
    """Words, windows and contexts of some texts in a row."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, window: int):
        word = ~SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        self.start = np.flatnonzero(word & (~np.concatenate([[False], word[:-1]]) | edge[:-1]))
        self.end = np.flatnonzero(word & (~np.concatenate([word[1:], [False]]) | edge[1:])) + 1
        self.raw, self.window = raw, window
        self.at = np.searchsorted(self.start, offsets)
        n = len(self.start)
        if n < window:
            self.doc = self.first = self.count = np.empty(0, np.int64)
            self.anchor = self.own = np.empty(0, np.uint64)
            return
        self.hashes = word_hashes(raw, self.start, self.end - self.start)
        grams = self.joined(GRAM)
        low = np.uint64((1 << max(22, n.bit_length())) - 1)
        value = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        least = np.lib.stride_tricks.sliding_window_view(value, window - GRAM + 1).min(axis=1) & low
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(self.at))[: len(least)]
        inside = np.arange(len(least)) + window <= self.at[of + 1]
        new = inside.copy()
        new[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]) & (of[1:] == of[:-1]))
        self.first = np.flatnonzero(new)
        self.count = np.add.reduceat(inside.astype(np.int64), self.first) if len(self.first) else self.first
        self.doc = of[self.first]
        self.anchor = grams[least[self.first].astype(np.int64)] & ~LOW

    def joined(self, n: int) -> np.ndarray:
        """A hash of each n words in a row."""
        out = np.zeros(len(self.hashes) - n + 1, np.uint64)
        for k in range(n):
            turn = np.uint64(1 + 13 * k % 63)
            x = self.hashes[k : k + len(out)]
            out = out * M4 + ((x << turn) | (x >> (np.uint64(64) - turn)))
        return mix(out)

    def routed(self, shared: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """(document, first word, windows, shard) of the contexts with a shared anchor; a hot anchor's windows are contexts of their own."""
        if not len(shared) or not len(self.first):
            return (np.empty(0, np.int64),) * 4
        anchors = shared & ~LOW
        at = np.minimum(np.searchsorted(anchors, self.anchor), len(anchors) - 1)
        found = np.flatnonzero(anchors[at] == self.anchor)
        hot = (shared[at[found]] & LOW) > 0
        times = np.where(hot, self.count[found], 1)
        place = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        found, hot = np.repeat(found, times), np.repeat(hot, times)
        first, route = self.first[found] + place, self.anchor[found] >> np.uint64(8)
        if hot.any():
            route[hot] = self.joined(self.window)[first[hot]] >> np.uint64(8)
        return self.doc[found], first, np.where(hot, 1, self.count[found]), (route % np.uint64(shards)).astype(np.int64)


def _pieces(batches, window: int) -> Iterator[tuple]:
    """(slot, rows beside the documents, None, None) and (slot, None, keys, texts), as they come: documents of a slot follow what stands beside them."""
    for batch in batches:
        slot, text = batch.column(0).to_numpy(), batch.column(4)
        valid = text.is_valid().to_numpy(zero_copy_only=False)
        cuts = np.append(np.flatnonzero(np.concatenate([[True], (slot[1:] != slot[:-1]) | (valid[1:] != valid[:-1])])) if len(slot) else [], len(slot)).astype(int)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if not valid[a]:
                part = batch.slice(a, b - a)
                yield int(slot[a]), list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)), None, None
                continue
            ids, texts = batch.column(3).slice(a, b - a).to_numpy(zero_copy_only=False), text.slice(a, b - a).cast(pa.large_binary())
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
            raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
            k = 0
            while k < len(texts):
                end = min(len(texts), max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, side="right")) - 1))
                yield int(slot[a]), None, ids[k:end], Texts(raw[offsets[k] : offsets[end]], offsets[k : end + 1] - offsets[k], window)
                k = end


def _anchored(window: int, buckets: int):
    """A slot's distinct anchors, each with the number of its documents (up to 255), packed by bucket."""

    def run(batches):
        def done():
            anchor, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, anchor))
            anchor, ids = anchor[order], ids[order]
            first = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            other = first | np.concatenate([[True], ids[1:] != ids[:-1]])
            at = np.flatnonzero(first)
            packed = anchor[at] | np.minimum(np.add.reduceat(other.astype(np.int64), at), 255).astype(np.uint64)
            bucket = ((packed >> np.uint64(8)) % np.uint64(buckets)).astype(np.int32)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(np.full(len(used), slot, np.int32)), pa.array([packed[by[cut[b] : cut[b + 1]]].tobytes() for b in used], pa.binary())], names=["bucket", "slot", "blob"])

        slot, held = None, []
        for s, _, ids, texts in _pieces(batches, window):
            if s != slot:
                if held:
                    yield done()
                slot, held = s, []
            if len(texts.first):
                held.append((texts.anchor, ids[texts.doc]))
        if held:
            yield done()

    return run


def _shared(hot: int):
    """For each slot, which of its anchors two documents have, and which are hot."""

    def run(batches):
        def done():
            packed = [np.frombuffer(b, np.uint64) for b in blobs]
            of = np.repeat(np.arange(len(blobs)), [len(p) for p in packed])
            packed = np.concatenate(packed)
            order = np.argsort(packed, kind="stable")
            anchor, times = packed[order] & ~LOW, (packed[order] & LOW).astype(np.int64)
            at = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            total = np.repeat(np.add.reduceat(times, at), np.diff(np.append(at, len(anchor))))
            keep = total > 1
            out, of = (anchor | (total > hot).astype(np.uint64))[keep], of[order][keep]
            by = np.argsort(of, kind="stable")
            cut = np.searchsorted(of[by], np.arange(len(blobs) + 1))
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(np.array(slots, np.int32)[used]), pa.array([out[by[cut[k] : cut[k + 1]]].tobytes() for k in used], pa.binary())], names=["slot", "blob"])

        bucket, slots, blobs = None, [], []
        for batch in batches:
            for b, s, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if blobs:
                        yield done()
                    bucket, slots, blobs = b, [], []
                slots.append(s)
                blobs.append(blob)
        if blobs:
            yield done()

    return run


def _anchors_of(blobs: list[bytes]) -> np.ndarray:
    return np.sort(np.concatenate([np.frombuffer(b, np.uint64) for b in blobs])) if blobs else np.empty(0, np.uint64)


def _slices(texts: Texts, first: np.ndarray, count: np.ndarray) -> Iterator[bytes]:
    data = texts.raw.tobytes()
    for a, b in zip(texts.start[first].tolist(), texts.end[first + count + texts.window - 2].tolist(), strict=True):
        yield data[a:b]


def _contexts(window: int, shards: int):
    """A slot's distinct contexts with their smallest document, by shard, in order of first sight."""

    def run(batches):
        def done():
            rows = [(shard, slot, np.array([len(c) for c in own], np.uint32).tobytes(), np.array(list(own.values()), np.int64).tobytes(), b"".join(own)) for shard, own in sorted(held.items())]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["shard", "slot", "sizes", "least", "bytes"])

        slot, blobs, shared, held = None, [], None, {}
        for s, beside, ids, texts in _pieces(batches, window):
            if s != slot:
                if held:
                    yield done()
                slot, blobs, shared, held = s, [], None, {}
            if beside is not None:
                blobs += [blob for _, blob in beside]
                continue
            if shared is None:
                shared = _anchors_of(blobs)
            doc, first, count, shard = texts.routed(shared, shards)
            for context, i, b in zip(_slices(texts, first, count), ids[doc].tolist(), shard.tolist(), strict=True):
                own = held.setdefault(b, {})
                if own.setdefault(context, i) > i:
                    own[context] = i
        if held:
            yield done()

    return run


class Automaton:
    """Generalised suffix automaton over word numbers; every state has the smallest document that its strings occur in."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.least = [-1], [0], [1 << 63]

    def add(self, ids: list[int], document: int) -> None:
        last = 0
        for c in ids:
            last = self._extend(last, c)
            if self.least[last] > document:
                self.least[last] = document

    def _state(self, length: int, after: dict[int, int], link: int) -> int:
        self.next.append(after)
        self.length.append(length)
        self.link.append(link)
        self.least.append(1 << 63)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        known = self.next[last].get(c)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, c, known)
        state, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0:
            q = self.next[p].get(c)
            if q is not None:
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
                break
            self.next[p][c] = state
            p = self.link[p]
        return state

    def _split(self, p: int, c: int, q: int) -> int:
        """A state for the shorter strings of q."""
        state = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = state
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = state
            p = self.link[p]
        return state

    def settle(self) -> None:
        """Documents of longer strings count for their suffixes."""
        least, link = self.least, self.link
        for s in np.argsort(-np.array(self.length), kind="stable")[:-1].tolist():
            if least[s] < least[link[s]]:
                least[link[s]] = least[s]

    def firsts(self, ids: list[int], window: int) -> list[int]:
        """Matching statistics of a text: for each window in it that the automaton holds, the smallest document (others: the largest number)."""
        state = n = 0
        out = []
        for k, c in enumerate(ids):
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            while n >= window and self.length[self.link[state]] >= window:
                state = self.link[state]
                n = self.length[state]
            if k + 1 >= window:
                out.append(self.least[state] if n >= window else (1 << 63) - 1)
        return out


def shard_firsts(slots: list[tuple[list[bytes], list[int]]], window: int) -> list[list[int]]:
    """For each slot's contexts, with their smallest documents: the smallest document of each window over all slots."""
    number: dict[bytes, int] = {}
    known: dict[bytes, int] = {}
    distinct: dict[tuple[int, ...], int] = {}
    found: list[list[int]] = []
    for contexts, least in slots:
        own = []
        for context, i in zip(contexts, least, strict=True):
            k = known.get(context)
            if k is None:
                ids = tuple([number.setdefault(w, len(number)) for w in context.split()])
                k = known[context] = distinct.setdefault(ids, len(distinct))
                if k == len(found):
                    found.append([i])
            if found[k][0] > i:
                found[k][0] = i
            own.append(k)
        contexts[:] = own
    automaton = Automaton()
    for ids, [i] in zip(distinct, found, strict=True):
        automaton.add(ids, i)
    automaton.settle()
    firsts = [automaton.firsts(ids, window) for ids in distinct]
    return [[i for k in contexts for i in firsts[k]] for contexts, _ in slots]


def _matched(window: int):
    def run(batches):
        def done():
            slots, parts = [], []
            for slot, sizes, least, data in rows:
                ends = np.cumsum(np.frombuffer(sizes, np.uint32).astype(np.int64)).tolist()
                parts.append(([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.frombuffer(least, np.int64).tolist()))
                slots.append(slot)
            firsts = [np.array(f, np.int64).tobytes() for f in shard_firsts(parts, window)]
            return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(np.full(len(slots), shard, np.int32)), pa.array(firsts, pa.binary())], names=["slot", "shard", "blob"])

        shard, rows = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != shard:
                    if rows:
                        yield done()
                    shard, rows = b, []
                rows.append(row)
        if rows:
            yield done()

    return run


def _cut_out(window: int, shards: int):
    def run(batches):
        slot, beside_, shared, firsts, base, known = None, [], None, None, {}, {}
        for s, beside, ids, texts in _pieces(batches, window):
            if s != slot:
                slot, beside_, shared, known = s, [], None, {}
            if beside is not None:
                beside_ += beside
                continue
            if shared is None:
                shared = _anchors_of([blob for shard, blob in beside_ if shard is None])
                results = [(shard, np.frombuffer(blob, np.int64)) for shard, blob in beside_ if shard is not None]
                base = dict(zip([shard for shard, _ in results], np.cumsum([0, *[len(f) for _, f in results]]).tolist(), strict=False))
                firsts, beside_ = np.concatenate([np.empty(0, np.int64), *[f for _, f in results]]), []
            doc, first, count, shard = texts.routed(shared, shards)
            where = np.empty(len(doc), np.int64)
            for k, (context, b, n) in enumerate(zip(_slices(texts, first, count), shard.tolist(), count.tolist(), strict=True)):
                at = known.get(context)
                if at is None:
                    at = known[context] = base[b]
                    base[b] += n
                where[k] = at
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            hit = firsts[np.repeat(where, count) + inside] < np.repeat(ids[doc], count)
            at = (np.repeat(first, count) + inside)[hit]
            change = np.zeros(len(texts.start) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + window, -1)
            gone = np.cumsum(change[:-1]) > 0
            yield _kept(ids, texts, gone)

    return run


def _kept(ids: np.ndarray, texts: Texts, gone: np.ndarray) -> pa.RecordBatch:
    bounds = np.zeros(len(gone) + 1, bool)
    bounds[texts.at] = True
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    start = np.flatnonzero(gone & (~before | bounds[:-1]))
    end = np.flatnonzero(gone & (~after | bounds[1:])) + 1
    offsets = np.searchsorted(start, texts.at).astype(np.int32)
    origin = texts.at[np.searchsorted(texts.at, start, side="right") - 1]
    data, left = texts.raw.tobytes(), ~gone
    out = []
    for a, b in zip(texts.at[:-1].tolist(), texts.at[1:].tolist(), strict=True):
        own = left[a:b]
        if own.all():
            out.append(b" ".join(data[texts.start[a] : texts.end[b - 1]].split()) if b > a else b"")
        else:
            at = np.flatnonzero(own) + a
            out.append(b" ".join([data[x:y] for x, y in zip(texts.start[at].tolist(), texts.end[at].tolist(), strict=True)]))
    lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array((x - origin).astype(np.int64))) for x in (start, end)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=ids == NONE), pa.array(np.diff(texts.at)), *lists, pa.array(out, pa.binary()).cast(pa.string())], names=["id", "n_words", "span_start", "span_end", "kept"])


def deduplicated(docs: DataFrame, window: int = WINDOW, hot: int = HOT, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, n_words, span_start, span_end, kept) for every row: the removed word ranges, maximal and in order, and the words left, joined by one space."""
    if window < GRAM:
        raise ValueError(f"window must be {GRAM} or more")
    spark = docs.sparkSession
    common.ship(spark)
    t = common.text_or_empty(text).cast("binary")
    size = docs.agg(F.sum(F.octet_length(t))).first()[0] or 0
    parts = max(common.partitions(spark), size // TASK_BYTES)
    slots, shards = max(parts, size // SLOT_BYTES), max(parts, size // shard_bytes)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NONE)).alias("id"), t.alias("text"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = rows.select(F.pmod(F.xxhash64("id", "text"), F.lit(slots)).cast("int").alias("slot"), none("int", "shard"), none("binary", "blob"), "id", "text")

    def by_slot(table: DataFrame) -> DataFrame:
        return table.repartition(parts, "slot").sortWithinPartitions("slot", F.col("text").isNotNull(), "id", "text")

    anchors = by_slot(texts).mapInArrow(common.lean(_anchored(window, slots)), "bucket int, slot int, blob binary")
    shared = common.written(anchors.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(_shared(hot)), "slot int, blob binary"), "passages-shared")
    beside = shared.select("slot", none("int", "shard"), "blob", none("bigint", "id"), none("binary", "text"))
    contexts = by_slot(beside.union(texts)).mapInArrow(common.lean(_contexts(window, shards)), "shard int, slot int, sizes binary, least binary, bytes binary")
    firsts = common.written(contexts.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(common.lean(_matched(window)), "slot int, shard int, blob binary"), "passages-firsts")
    beside = beside.union(firsts.select("slot", "shard", "blob", none("bigint", "id"), none("binary", "text")))
    out = by_slot(beside.union(texts)).mapInArrow(common.lean(_cut_out(window, shards)), "id bigint, n_words bigint, span_start array<bigint>, span_end array<bigint>, kept string")
    return out.withColumnRenamed("id", key)
