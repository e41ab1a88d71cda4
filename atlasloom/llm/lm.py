r"""LM scoring with a subword lattice: the marginal probability of a text over all segmentations into known pieces.

The pieces are those of an existing vocabulary. Its file gives ranks, not probabilities, so a piece's weight is its
smoothed share of the training documents' pieces as the vocabulary's own library cuts them (each distinct word is cut
once and counts as often as it occurs). Pieces never cross a space, so the lattice of a text falls apart into words:
the log-space forward recursion runs once for each distinct word of the corpus, and a text's log probability is the
sum over its words and one end mark.

Words are counted over all training documents. The most frequent words, at most `head` of at most 64 bytes, are
broadcast with their scores; the others of every document are joined to the word table.

Text is lower-cased in A-Z; words are `[^\x20\x09-\x0D]+`; every document has one end, which counts as a token.

Defined cases: null and empty texts have the end alone; a document with a null key is held out; repeated rows are
scored, and if they are training documents counted, each for itself; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasloom.llm import common

SPACE_MARK = "▁"
SMOOTH = 0.1
HEAD_WORDS, HEAD_BYTES = 65_536, 64
#: The end mark in word tables; no word is empty.
END = b""


def held_out(key: str) -> Column:
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _word_counts():
    def run(batches):
        for batch in batches:
            train: Counter = Counter()
            every: Counter = Counter()
            for held, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or b"").lower().split()
                words.append(END)
                (every if held else train).update(words)
            listed = list(train)
            listed += [w for w in every if w not in train]
            yield pa.RecordBatch.from_arrays([pa.array(listed, pa.binary()), pa.array([train[w] for w in listed], pa.int64()), pa.array([train[w] + every[w] for w in listed], pa.int64())], names=["word", "train", "n"])

    return run


_models: dict = {}


def pieces(path: str):
    """The library's processor, loaded once in a worker."""
    if path not in _models:
        import sentencepiece

        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _models[path]


def _piece_counts(path: str):
    def run(batches):
        total = None
        for batch in batches:
            model = pieces(path)
            total = np.zeros(model.get_piece_size(), np.int64) if total is None else total
            words = [w.decode(errors="replace") for w in batch.column(0).to_pylist()]
            cut = model.encode(words, num_threads=1)
            sizes = [len(c) for c in cut]
            ids = np.fromiter((i for c in cut for i in c), np.int64, sum(sizes))
            total += np.bincount(ids, np.repeat(batch.column(1).to_numpy(), sizes), len(total)).astype(np.int64)
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["piece", "n"])

    return run


class Lattice:
    """Log probability of a word, summed over all ways to cut it into pieces."""

    def __init__(self, logs: dict[str, float]):
        self.bytes = [logs.get(f"<0x{b:02X}>", -99.0) for b in range(256)]
        #: Log probability by piece; None for what only begins a longer piece.
        self.known: dict[str, float | None] = {}
        for piece, value in logs.items():
            if not (len(piece) == 6 and piece.startswith("<0x")):
                for k in range(1, len(piece)):
                    self.known.setdefault(piece[:k], None)
                self.known[piece] = value

    def word(self, text: str) -> float:
        known, n, exp, log = self.known, len(text), math.exp, math.log
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        for i in range(n):
            paths = into[i]
            if not paths:
                continue
            if len(paths) == 1:
                here = paths[0]
            else:
                top = max(paths)
                here = top + log(sum([exp(p - top) for p in paths]))
            j = i + 1
            while j <= n:
                piece = text[i:j]
                if piece not in known:
                    break
                value = known[piece]
                if value is not None:
                    into[j].append(here + value)
                j += 1
            if known.get(text[i]) is None:
                into[i + 1].append(here + sum(self.bytes[b] for b in text[i].encode(errors="replace")))
        top = max(into[n])
        return top + log(sum([exp(p - top) for p in into[n]]))


def piece_logs(path: str, counts: dict[int, int], ends: int) -> tuple[dict[str, float], float]:
    """Natural logs of the pieces' smoothed shares, and that of the end mark; they sum to one."""
    model = pieces(path)
    used = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i))]
    total = sum(counts.get(i, 0) for i in used) + ends + SMOOTH * (len(used) + 1)
    share = lambda n: math.log((n + SMOOTH) / total)
    return {model.id_to_piece(i): share(counts.get(i, 0)) for i in used}, share(ends)


def _word_scores(shared):
    def run(batches):
        lattice, end = None, shared.value[1]
        for batch in batches:
            lattice = lattice or Lattice(shared.value[0])
            scores = [lattice.word(SPACE_MARK + w.decode(errors="replace")) if w else end for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.array(scores) / math.log(10), pa.float64())], names=["word", "train", "n", "score"])

    return run


class _Head:
    def __init__(self, rows, base):
        self.number = {bytes(r.word): k for k, r in enumerate(rows)}
        self.base = np.array([base(r.train) for r in rows])
        self.score = np.array([r.score for r in rows])
        self.known = np.array([r.train > 0 for r in rows])


def _document_parts(shared):
    def run(batches):
        from itertools import repeat

        from pyspark import TaskContext

        head, row = shared.value, TaskContext.get().partitionId() << 39
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            tails, times, sizes = [], [], []
            for text in batch.column(2):
                words = (text.as_py() or b"").lower().split()
                words.append(END)
                at = np.fromiter(map(head.number.get, words, repeat(-1)), np.int64, len(words))
                rare = Counter(words[k] for k in np.flatnonzero(at < 0).tolist())
                at = at[at >= 0]
                for o, v in zip(out, (len(words), int(head.known[at].sum()), float(head.base[at].sum()), float(head.score[at].sum())), strict=True):
                    o.append(v)
                tails += rare.keys()
                times += rare.values()
                sizes.append(len(rare))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64()), pa.ListArray.from_arrays(offsets, pa.array(tails, pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                names=["row", "key", "held_out", "n_tokens", "n_known", "base_score", "score", "words", "times"],
            )
            row += n

    return run


def scored(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD_WORDS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row; scores are log10 probabilities."""
    spark = docs.sparkSession
    common.ship(spark)
    t = common.text_or_empty(text).cast("binary").alias("t")
    counted = docs.select(held_out(key).alias("held"), t).mapInArrow(_word_counts(), "word binary, train bigint, n bigint")
    words = common.written(counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n")), "lm-words")
    sums = words.agg(F.sum("train").alias("tokens"), F.count(F.when(F.col("train") > 0, 1)).alias("distinct"), F.max(F.when(F.length("word") == 0, F.col("train"))).alias("ends")).first()
    tokens, distinct, ends = (int(x or 0) for x in sums)

    cut = words.where("train > 0 AND length(word) > 0").select("word", "train").mapInArrow(_piece_counts(path), "piece int, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    logs = spark.sparkContext.broadcast(piece_logs(path, {r.piece: r.n for r in cut.collect()}, ends))
    table = common.written(words.mapInArrow(_word_scores(logs), "word binary, train bigint, n bigint, score double"), "lm-scores")

    below = tokens + SMOOTH * (distinct + 1)
    top = common.most_frequent(table.where(F.length("word") <= HEAD_BYTES), "n", head).collect()
    shared = spark.sparkContext.broadcast(_Head(top, lambda c: math.log10((c + SMOOTH) / below)))
    rows = docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), t)
    kind = rows.schema["key"].dataType.simpleString()
    parts = common.written(rows.mapInArrow(_document_parts(shared), f"row bigint, key {kind}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, words array<binary>, times array<int>"), "lm-parts")

    rare = parts.where(F.size("words") > 0).select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("k"))
    priced = table.select("word", "train", "score")
    base = F.log10((F.col("train") + SMOOTH) / F.lit(below))
    tail = rare.join(priced, "word").groupBy("row").agg(F.sum(F.when(F.col("train") > 0, F.col("k")).otherwise(0)).alias("k"), F.sum(F.col("k") * base).alias("b"), F.sum(F.col("k") * F.col("score")).alias("s"))
    out = parts.drop("words", "times").join(tail, "row", "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(F.col(b), F.lit(0))).alias(a)
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", plus("n_known", "k"), F.lit(tokens).cast("long").alias("train_tokens"), plus("base_score", "b"), plus("score", "s"))
