r"""N-gram Jaccard join: a size-aware heavy-light join that is exact.

A document's set holds its distinct word shingles; documents with equal sets are one node. Two nodes link when
100 * |x & y| >= percent * |x | y|. The shingles have one global order, by document frequency and then by hash, for
which a fixed space of 2^32 counters over all documents gives the frequency (any order is exact; this one is fast).
Linked sets share an element of their prefixes, and two elements of prefixes longer by one.

* Small sets, up to `boundary` elements, enumerate all subsets of two elements of the longer prefix. Sets so small that
  one shared element can be enough (up to 100 / percent elements, where that is two or more) list their elements too.
* Large sets enter the inverted lists of their prefix elements, and so do the small sets that can link to them.
* The boundary is chosen by cost: subsets are made while they cost less than the shared entries of a list would.

Nodes in the same short list are candidate pairs if their sizes allow a link and an upper bound of their overlap, from
folded parity bitmaps, does. Lists of over `short` nodes are never turned into pairs: they only tie their members to
one group. Groups are the components of candidates and long lists; inside a group the inverted lists of the whole sets
are scanned for exact overlaps, from each node to the nodes not yet reached. A group too large for one task is cut
into blocks by size, and pairs of blocks that can link are scanned in tasks of their own. The links found span every
component, and their components are the answer.

Words: A-Z lower-cased, then `[^\x20\x09-\x0D]+`; fewer words than a shingle give the whole sequence as one.

Defined cases: null texts and texts without words have empty sets and link with nothing; a null key counts as no
smallest key where another is in the component; repeated rows are one node and each return a row; an empty table
gives an empty result; further columns are ignored by `components` and passed on by `one_of_each`.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlasloom.llm import common
from atlasloom.operators.graph import connected_components

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Odd multipliers of the hash (fixed values).
M1, M2, M3, M4, M5 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
CHUNK_BYTES, LONG_WORD = 2 << 20, 256
#: Bits of a counter's bucket, at least and at most; each bucket is counted in one task.
LEAST_BITS, MOST_BITS = 8, 16
#: Bytes of a node's fingerprint.
FP = 12
POSTING = np.dtype([("k", "<u4"), ("a", "<u8"), ("b", "<u4"), ("n", "<u4")])
NODE = np.dtype([("a", "<u8"), ("b", "<u4")])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * M2
    h = (h ^ (h >> np.uint64(27))) * M3
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes; words are taken by descending length, one byte of all of them at a time."""
    order = np.argsort(LONG_WORD - np.minimum(length, LONG_WORD).astype(np.uint16), kind="stable")
    s, n = start[order], np.minimum(length[order], LONG_WORD)
    h = np.full(len(s), M5)
    ends = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
    for k, m in enumerate(ends):
        h[:m] = (h[:m] ^ data[s[:m] + k]) * M1
    for k in np.flatnonzero(length[order] > LONG_WORD):
        w = order[k]
        h[k] = np.frombuffer(hashlib.blake2b(data[start[w] : start[w] + length[w]].tobytes(), digest_size=8).digest(), np.uint64)[0]
    out = np.empty_like(h)
    out[order] = h ^ length[order].astype(np.uint64)
    return mix(out)


def _sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of the texts at `offsets` of lower-cased bytes."""
    word = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    h = word_hashes(data, start, end - start)
    at = np.searchsorted(start, offsets)
    joined = np.zeros(max(0, len(h) - shingle + 1), np.uint64)
    for k in range(shingle):
        turn = np.uint64(1 + 13 * k)
        x = h[k : k + len(joined)]
        joined = joined * M4 + ((x << turn) | (x >> (np.uint64(64) - turn)))
    joined = mix(joined)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= shingle:
            out.append(np.unique(joined[a : b - shingle + 1]))
        elif b > a:
            out.append(np.frombuffer(hashlib.blake2b(h[a:b].tobytes(), digest_size=8).digest(), np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def shingle_sets(texts: pa.Array, shingle: int = 4):
    """Sets of a binary column's texts in order, some megabytes at a time."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.empty(0, np.uint8)
    k = 0
    while k < n:
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK_BYTES, side="right")) - 1)
        end = min(end, n)
        yield from _sets(LOWER[raw[offsets[k] : offsets[end]]], offsets[k : end + 1] - offsets[k], shingle)
        k = end


def fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=FP).digest()


def binaries(data: bytes, width: int) -> pa.Array:
    n = len(data) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(data)])


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the elements at each of the next power of two of 2n places, 256 at least."""
    bits = max(256, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def may_link(nx: int, bx: bytes, ny: int, by: bytes, percent: int) -> bool:
    """False only where the sets differ in so many places that they can't link."""
    x, y, bits = int.from_bytes(bx, "little"), int.from_bytes(by, "little"), 8 * len(bx)
    if len(bx) < len(by):
        x, y, bits = y, x, 8 * len(by)
    small = 8 * min(len(bx), len(by))
    while bits > small:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    overlap = (nx + ny - (x ^ y).bit_count()) // 2
    return (100 + percent) * overlap >= percent * (nx + ny)


def packed_counters(ids: np.ndarray) -> bytes:
    """Sorted numbers of at most 24 bits: the first, then 16-bit steps, or all plainly where a step is larger."""
    steps = np.diff(ids)
    if len(steps) and steps.max() > 65535:
        return b"\1" + ids.astype("<u4").tobytes()
    return b"\0" + ids[:1].astype("<u4").tobytes() + steps.astype("<u2").tobytes()


def unpacked_counters(blob: bytes) -> np.ndarray:
    if blob[0]:
        return np.frombuffer(blob, "<u4", offset=1).astype(np.int64)
    first = np.frombuffer(blob, "<u4", 1, 1).astype(np.int64)
    return np.cumsum(np.concatenate([first, np.frombuffer(blob, "<u2", offset=5).astype(np.int64)]))


def _counter_blobs(shingle: int, bits: int):
    def run(batches):
        for batch in batches:
            found = [s for s in shingle_sets(batch.column(0), shingle) if len(s)]
            if found:
                ids = np.sort((np.concatenate(found) >> np.uint64(32)).astype(np.uint32))
                cut = np.searchsorted(ids, np.arange((1 << bits) + 1, dtype=np.int64) << (32 - bits))
                low = ids & np.uint32((1 << (32 - bits)) - 1)
                blobs = [(k, packed_counters(low[cut[k] : cut[k + 1]])) for k in range(1 << bits) if cut[k] < cut[k + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blobs], pa.int32()), pa.array([b for _, b in blobs], pa.binary())], names=["bucket", "blob"])

    return run


def _counted(frequent: int, bits: int):
    """Frequent counters (id, n), and one row per bucket with the sums of n and n * n of the others."""

    def merged(ids, n, more):
        new, count = np.unique(more, return_counts=True)
        if ids is None:
            return new, count
        both, at = np.unique(np.concatenate([ids, new]), return_inverse=True)
        return both, np.bincount(at, np.concatenate([n, count])).astype(np.int64)

    def run(batches):
        def done():
            keep = n >= frequent
            light = n[~keep]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([(ids[keep] + (bucket << (32 - bits))), [-1]]), pa.int64()), pa.array(np.concatenate([n[keep], [light.sum()]]), pa.int64()), pa.array(np.concatenate([np.zeros(keep.sum()), [float((light.astype(float) ** 2).sum())]]), pa.float64())], names=["id", "n", "squares"])

        bucket, ids, n, waiting, held = None, None, None, [], 0
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket:
                    if bucket is not None:
                        ids, n = merged(ids, n, np.concatenate(waiting)) if waiting else (ids, n)
                        yield done()
                    bucket, ids, n, waiting, held = b, None, None, [], 0
                waiting.append(unpacked_counters(blob.as_py()))
                held += len(waiting[-1])
                if held > 4_000_000:
                    ids, n = merged(ids, n, np.concatenate(waiting))
                    waiting, held = [], 0
        if bucket is not None:
            ids, n = merged(ids, n, np.concatenate(waiting)) if waiting else (ids, n)
            yield done()

    return run


def boundary(shared: float, percent: int) -> int:
    """Largest set size for which all 2-subsets of the longer prefix cost no more than its inverted lists.

    `shared` is how many others a list entry meets on average. An entry that is made, sent and sorted is reckoned as
    four times the cost of a meeting, so subsets pay while 4 * p * (p + 1) / 2 <= p * (4 + shared).
    """
    p = math.floor(1 + shared / 2)
    n = 2
    while prefix_length(n + 1, percent) <= p:
        n += 1
    return n


class Order:
    """The global order of shingles: those that are not known as frequent by hash, then the others by frequency and hash."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        by = np.argsort(ids)
        self.ids, self.counts = ids[by], counts[by]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.ids >> 12] = True

    def first(self, s: np.ndarray, k: int) -> np.ndarray:
        """The first `k` elements of a sorted set, in order."""
        top = (s >> np.uint64(32)).astype(np.int64)
        maybe = np.flatnonzero(self.seen[top >> 12])
        at = np.searchsorted(self.ids, top[maybe])
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == top[maybe] if len(self.ids) else np.zeros(len(maybe), bool)
        if not hit.any():
            return s[:k]
        heavy = np.zeros(len(s), bool)
        heavy[maybe[hit]] = True
        light = s[~heavy][:k]
        if len(light) < k:
            rest, n = s[maybe[hit]], self.counts[at[hit]]
            light = np.concatenate([light, rest[np.lexsort((rest, n))][: k - len(light)]])
        return light

    def keys(self, s: np.ndarray, percent: int, small: int) -> np.ndarray:
        """Join keys of a set: subsets of two for small sets, single elements for large ones and for those that reach them.

        One shared element links sets only if their union has at most 100 / percent elements; equal sets need no key.
        """
        n = len(s)
        alone = 100 // percent
        if n < 2 and alone < 2:
            return np.empty(0, np.uint64)
        p = prefix_length(n, percent)
        first = self.first(s, p + 1)
        out = [mix(s ^ M3)] if n <= alone else []
        if n <= small and n > 1:
            a, b = np.triu_indices(len(first), 1)
            x, y = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
            out.append(mix(x * M4 + ((y << np.uint64(23)) | (y >> np.uint64(41)))))
        if 100 * n >= percent * (small + 1):
            out.append(mix(first[:p] ^ M5))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _postings(shingle: int, percent: int, small: int, order, bits: int):
    def run(batches):
        for batch in batches:
            known: dict[bytes, bool] = {}
            sizes, fps, maps, keys, nodes, counts = [], [], [], [], [], []
            for s in shingle_sets(batch.column(1), shingle):
                n = len(s)
                fp = fingerprint(s) if n else None
                sizes.append(n)
                fps.append(fp)
                new = n and fp not in known
                maps.append(bitmap(s) if new else None)
                if new:
                    known[fp] = True
                    k = order.value.keys(s, percent, small)
                    keys.append(k)
                    nodes.append(fp)
                    counts.append((len(k), n))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(fps), dtype=np.int32) & ((1 << bits) - 1)), pa.nulls(len(fps), pa.binary()), batch.column(0), pa.array(sizes, pa.int32()), pa.array(fps, pa.binary()), pa.array(maps, pa.binary())], names=NAMES)
            total = sum(c for c, _ in counts)
            if total:
                k = np.concatenate(keys)
                bucket = (k >> np.uint64(64 - bits)).astype(np.uint32)
                rows = np.empty(total, POSTING)
                rows["k"] = (k >> np.uint64(32 - bits)).astype(np.uint32)
                f = np.frombuffer(b"".join(nodes), NODE)
                per = np.array([c for c, _ in counts])
                rows["a"], rows["b"], rows["n"] = np.repeat(f["a"], per), np.repeat(f["b"], per), np.repeat([n for _, n in counts], per)
                by = np.argsort(bucket, kind="stable")
                rows, bucket = rows[by], bucket[by]
                at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                ends = np.append(at[1:], total)
                m = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[at], pa.int32()), pa.array([rows[a:b].tobytes() for a, b in zip(at, ends, strict=True)], pa.binary()), pa.nulls(m, batch.schema.field(0).type), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names=NAMES)

    return run


NAMES = ["bucket", "blob", "key", "n", "x", "map"]
#: Kinds of rows: a document, a candidate pair, a member of a long list.
DOCUMENT, PAIR, MEMBER = 0, 1, 2


def listed(rows: np.ndarray, bucket: int, percent: int, short: int) -> tuple[bytes, bytes, bytes, bytes]:
    """Of a bucket's postings: candidate pairs (x, y) of short lists, members (x, list) of long ones, as joined bytes."""
    rows = rows[np.lexsort((rows["b"], rows["a"], rows["k"]))]
    same = (rows["k"][1:] == rows["k"][:-1]) & (rows["a"][1:] == rows["a"][:-1]) & (rows["b"][1:] == rows["b"][:-1])
    rows = rows[np.concatenate([[True], ~same])]
    at = np.flatnonzero(np.concatenate([[True], rows["k"][1:] != rows["k"][:-1]]))
    size = np.diff(np.append(at, len(rows)))
    left, right = [], []
    for n in np.unique(size[(size > 1) & (size <= short)]).tolist():
        a, b = np.triu_indices(n, 1)
        first = at[size == n]
        left.append((first[:, None] + a).ravel())
        right.append((first[:, None] + b).ravel())
    pairs = (b"", b"")
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        n = rows["n"]
        fit = 100 * np.minimum(n[x], n[y]).astype(np.int64) >= percent * np.maximum(n[x], n[y]).astype(np.int64)
        x, y = x[fit], y[fit]
        nodes = np.empty(len(rows), NODE)
        nodes["a"], nodes["b"] = rows["a"], rows["b"]
        _, number = np.unique(nodes, return_inverse=True)
        lo, hi = np.minimum(number[x], number[y]), np.maximum(number[x], number[y])
        _, once = np.unique(lo.astype(np.int64) * (int(number.max()) + 1) + hi, return_index=True)
        swap = number[x[once]] > number[y[once]]
        x, y = np.where(swap, y[once], x[once]), np.where(swap, x[once], y[once])
        pairs = (nodes[x].tobytes(), nodes[y].tobytes())
    long = np.flatnonzero(np.repeat(size > short, size))
    members = np.empty(len(long), NODE)
    members["a"], members["b"] = rows["a"][long], rows["b"][long]
    lists = np.empty(len(long), np.dtype([("bucket", "<u4"), ("k", "<u4")]))
    lists["bucket"], lists["k"] = bucket, rows["k"][long]
    return *pairs, members.tobytes(), lists.tobytes()


def _candidates(percent: int, short: int):
    def run(batches):
        kind = None

        def done():
            x, y, m, lists = listed(np.frombuffer(b"".join(blobs), POSTING), bucket, percent, short)
            for what, left, right, width in ((PAIR, x, y, FP), (MEMBER, m, lists, 8)):
                n = len(left) // FP
                for k in range(0, n, 100_000):
                    e = min(n, k + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(e - k, what, np.int8)), pa.nulls(e - k, kind), pa.nulls(e - k, pa.int32()), binaries(left[k * FP : e * FP], FP), binaries(right[k * width : e * width], width)], names=["kind", "key", "n", "x", "y"])

        bucket, blobs = None, []
        for batch in batches:
            kind = batch.schema.field(2).type
            documents = batch.filter(batch.column(1).is_null())
            if len(documents):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(documents), DOCUMENT, np.int8)), *documents.columns[2:6]], names=["kind", "key", "n", "x", "y"])
            rest = batch.filter(batch.column(1).is_valid())
            for b, blob in zip(rest.column(0).to_pylist(), rest.column(1), strict=True):
                if b != bucket:
                    if blobs:
                        yield from done()
                    bucket, blobs = b, []
                blobs.append(blob.as_py())
        if blobs:
            yield from done()

    return run


def _bounded(percent: int):
    def run(batches):
        for batch in batches:
            x, y, nx, bx, ny, by = (c.to_pylist() for c in batch.columns)
            keep = [may_link(*z, percent) for z in zip(nx, bx, ny, by, strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    return run


def _with_sets(shingle: int):
    def run(batches):
        for batch in batches:
            keep, sets = [], []
            for fp, s in zip(batch.column(1).to_pylist(), shingle_sets(batch.column(0), shingle), strict=True):
                keep.append(fingerprint(s) == fp)
                sets.append(s.tobytes() if keep[-1] else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())], names=[*batch.schema.names[1:], "s"]).filter(pa.array(keep, pa.bool_()))

    return run


def spanning_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that connect what all links between the sets connect: from each set reached, its inverted lists give the overlaps with those not yet reached."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), n)
    by = np.argsort(number, kind="stable")
    owners, elements = owner[by], number[by]
    start = np.searchsorted(elements, np.arange(len(values) + 1))
    open_, links, pool = np.ones(m, bool), [], m
    for seed in range(m):
        if not open_[seed]:
            continue
        open_[seed] = False
        stack = [seed]
        while stack:
            x = stack.pop()
            mine = number[at[x] : at[x + 1]]
            length = start[mine + 1] - start[mine]
            total = int(length.sum())
            if not total:
                continue
            overlap = np.bincount(owners[np.repeat(start[mine] - np.cumsum(length) + length, length) + np.arange(total)], minlength=m)
            new = np.flatnonzero(open_ & (overlap > 0))
            o = overlap[new]
            new = new[100 * o >= percent * (n[x] + n[new] - o)]
            open_[new] = False
            links += [(x, k) for k in new.tolist()]
            stack += new.tolist()
            left = int(open_.sum())
            if pool > 256 and 2 * left < pool:
                keep = open_[owners]
                owners, elements, pool = owners[keep], elements[keep], left
                start = np.searchsorted(elements, np.arange(len(values) + 1))
    return links


def _scanned(percent: int):
    def run(batches):
        def done():
            order = np.argsort([len(s) for s in sets], kind="stable").tolist()
            links = spanning_links([sets[k] for k in order], percent) if len(sets) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([names[order[a]] for a, _ in links], pa.binary()), pa.array([names[order[b]] for _, b in links], pa.binary())], names=["src", "dst"])

        task, names, sets = None, [], []
        for batch in batches:
            for t, x, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if t != task:
                    if task is not None:
                        yield done()
                    task, names, sets = t, [], []
                if not names or names[-1] != x:
                    names.append(x)
                    sets.append(np.frombuffer(s.as_py(), np.uint64))
        if task is not None:
            yield done()

    return run


def components(docs: DataFrame, percent: int = 85, shingle: int = 4, key: str = "doc_id", text: str = "text", frequent: int = 30, known: int = 1_000_000, short: int = 32, task_elements: int = 4_000_000, row: str | None = None) -> DataFrame:
    """(key, n_shingles, component, root) for every row, with `row` too if given; `component` is the smallest key that links reach, `root` names the component even where keys repeat.

    `known` bounds the frequent shingles that are broadcast (16 bytes each), `task_elements` the shingles of a group
    that one task scans. `percent` is a whole number from 1 to 100; the join is exact for each of them.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent is from 1 to 100")
    spark = docs.sparkSession
    common.ship(spark)
    parts = common.partitions(spark)
    folder = common.fresh_path(spark, "jaccard")
    cut = lambda df, name: common.written_at(df, f"{folder}/{name}")
    t = F.coalesce(F.col(text), F.lit("")).cast("binary")

    wide = max(LEAST_BITS, min(MOST_BITS, math.ceil(math.log2(parts))))
    blobs = docs.select(t.alias("t")).mapInArrow(common.lean(_counter_blobs(shingle, wide)), "bucket int, blob binary")
    counters = cut(blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(_counted(frequent, wide)), "id bigint, n bigint, squares double"), "counters")
    total, squares = counters.where("id < 0").agg(F.sum("n"), F.sum("squares")).first()
    small = boundary(max(0.0, squares / total - 1) if total else 0.0, percent)
    top = common.most_frequent(counters.where("id >= 0"), "n", known).select("id", "n").toArrow()
    order = spark.sparkContext.broadcast(Order(top["id"].to_numpy(), top["n"].to_numpy()))

    bits = max(4, min(16, math.ceil(math.log2(4 * parts))))
    ids = docs.select(F.struct(F.col(key).alias("id"), *([F.col(row).alias("row")] if row else [])).alias("key"), t.alias("t"))
    kind = ids.schema["key"].dataType.simpleString()
    posted = ids.mapInArrow(common.lean(_postings(shingle, percent, small, order, bits)), f"bucket int, blob binary, key {kind}, n int, x binary, map binary")
    found = cut(posted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(common.lean(_candidates(percent, short)), f"kind tinyint, key {kind}, n int, x binary, y binary"), "candidates")
    documents = found.where(F.col("kind") == DOCUMENT).select("key.*", "n", "x", F.col("y").alias("map"))
    nodes = cut(documents.where("x IS NOT NULL").groupBy("x").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.max("map").alias("map")), "nodes")

    pairs = found.where(F.col("kind") == PAIR).select("x", "y").distinct()
    sides = [nodes.select(F.col("x").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"b{s}")) for s in "xy"]
    likely = pairs.join(sides[0], "x").join(sides[1], "y").select("x", "y", "nx", "bx", "ny", "by").mapInArrow(common.lean(_bounded(percent)), "x binary, y binary")
    ties = found.where(F.col("kind") == MEMBER).select("x", "y").union(likely)
    groups = connected_components(ties, "x", "y", folder).withColumnRenamed("node", "x")

    members = cut(groups.join(nodes.drop("map"), "x"), "members")
    sums = members.groupBy("component").agg(F.sum("n").alias("elements"))
    sized = members.join(sums, "component")
    running = Window.partitionBy("component").orderBy("n", "x").rowsBetween(Window.unboundedPreceding, 0)
    whole = sized.where(F.col("elements") <= task_elements).select("x", "id", "n", "component", F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"))).alias("tasks"))
    blocks = sized.where(F.col("elements") > task_elements).withColumn("block", F.floor(F.sum("n").over(running) / (task_elements / 2)).cast("int"))
    ends = blocks.groupBy("component", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    near = ends.alias("a").join(ends.alias("b"), F.expr(f"a.component = b.component AND a.block <= b.block AND 100 * a.hi >= {percent} * b.lo")).select("a.component", F.col("a.block").alias("i"), F.col("b.block").alias("j"))
    each = near.select("component", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")).groupBy("component", "block").agg(F.collect_list(F.struct("i", "j")).alias("tasks"))
    tasks = whole.union(blocks.join(each, ["component", "block"]).select("x", "id", "n", "component", "tasks"))
    # Null keys meet null keys; the fingerprint tells whose text it is.
    texts = docs.select(F.col(key).alias("_id"), t.alias("t")).join(tasks.hint("shuffle_hash"), F.col("_id").eqNullSafe(F.col("id"))).select("t", "x", "component", "tasks")
    sets = texts.mapInArrow(common.lean(_with_sets(shingle)), "x binary, component binary, tasks array<struct<i: int, j: int>>, s binary")
    spread = sets.select(F.explode("tasks").alias("task"), "component", "x", "s").select(F.struct("component", "task.i", "task.j").alias("task"), "x", "s")
    links = cut(spread.repartition(parts, "task").sortWithinPartitions("task", "x").mapInArrow(common.lean(_scanned(percent)), "src binary, dst binary"), "links")

    linked = connected_components(links, folder=folder).withColumnRenamed("node", "x")
    rooted = nodes.select("x", "id").join(linked, "x", "left").select("x", "id", F.coalesce("component", "x").alias("root"))
    # Written first, so that the join below has its own exchanges, which Spark can split at a very large component.
    firsts = cut(rooted.groupBy("root").agg(F.min("id").alias("component")), "firsts")
    labels = rooted.select("x", "root").join(firsts, "root").select("x", "component", "root")
    out = documents.select("id", *(["row"] if row else []), "n", "x").join(labels, "x", "left")
    return out.select(F.col("id").alias(key), *([F.col("row").alias(row)] if row else []), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"), "root")


def one_of_each(docs: DataFrame, percent: int = 80, shingle: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component, that of the smallest key; of repeated rows (same key, same text) one stays. Texts without words all stay.

    Rows are told apart by key and text digest; columns are the input's.
    """
    k, r = f"_key_{uuid.uuid4().hex}", f"_row_{uuid.uuid4().hex}"
    marked = docs.withColumns({k: F.col(key), r: F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)})
    slim = marked.select(F.col(k).alias("_k"), F.col(r).alias("_r"), F.col(text).alias("_t"))
    found = common.written(components(slim, percent, shingle, "_k", "_t", row="_r"), "jaccard-rows")
    rows = found.where("n_shingles > 0").groupBy("_k", "_r").agg(F.min("root").alias("root"), F.count(F.lit(1)).alias("copies"))
    first = common.written(rows.groupBy("root").agg(F.min(F.struct("_k", "_r")).alias("first")), "jaccard-firsts")
    marks = rows.join(first, "root").select("_k", "_r", "copies", F.struct("_k", "_r").eqNullSafe(F.col("first")).alias("stays"))
    out = marked.join(marks.where("NOT stays").hint("shuffle_hash"), F.col(k).eqNullSafe(F.col("_k")) & (F.col(r) == F.col("_r")), "left_anti")
    if not marks.where("stays AND copies > 1").isEmpty():
        again = marks.where("stays AND copies > 1").select("_k", "_r")
        on = F.col(k).eqNullSafe(F.col("_k")) & (F.col(r) == F.col("_r"))
        out = out.join(again, on, "left_anti").union(out.join(again, on, "left_semi").dropDuplicates([k, r]))
    return out.select(*docs.columns)
