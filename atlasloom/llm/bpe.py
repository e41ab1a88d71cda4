"""Byte-level BPE through the tokenizers library, one pre-token at a time, with worker caches.

The library splits a text into pre-tokens and merges inside each, so ids and counts of a pre-token never depend on its
neighbours. A worker therefore asks the library once for each distinct pre-token and joins what it got. Texts with
characters on which two regular-expression engines might differ go to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from atlasloom.llm import pretokens

#: The pre-token pattern of this vocabulary, written for Python's `re` (fixed value; equal to the library's on texts that PLAIN matches).
PRE_TOKEN = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters that both engines put into the same class; Latin, Greek, Cyrillic letters and common marks, without superscripts and fractions.
NOT_PLAIN = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏΑ-ΡΣ-ϿЀ-ҁ‐-‧]")
#: Slots of a worker's table of pre-tokens, as a power of two; 12 bytes each.
TABLE_BITS = 21
#: Longer pre-tokens do not enter the broadcast table.
LONGEST_KEPT = 64

_loaded: dict = {}


def library(path: str):
    """The tokenizer of a worker process, loaded once."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def id_type(tokenizer) -> np.dtype:
    return np.dtype("<u2" if tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")


class Pieces:
    """The library's tokenizer and its added tokens."""

    def __init__(self, path: str):
        self.tokenizer = library(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]


class Grouped(Pieces):
    """Values of the pre-tokens of groups of texts.

    Texts come in groups. A group is cut into pre-tokens at once; those that the table lacks go to the library
    together: words after a blank side by side in one string, whose ids are cut where the words end, bare words each
    after a line end, all others singly. At its bound the table begins anew.
    """

    def __init__(self, path: str, bits: int = TABLE_BITS):
        super().__init__(path)
        self.type = id_type(self.tokenizer)
        self.table = pretokens.Table(self.value_type(), bits)
        #: Bytes of text behind each id; byte-level pieces have one character for each byte.
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.lengths[i] = len(piece)

    def value_type(self):
        return self.type

    def values(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """What the table keeps of ids: all numbers in a row, and how many of each."""
        return np.concatenate(ids), np.array([len(i) for i in ids], np.int64)

    def renewed(self) -> None:
        self.table.clear()

    def _ask(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type)

    def _learned(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each of many pre-tokens."""
        out: dict[str, np.ndarray] = {}
        # A blank and what follows it is one pre-token, whatever stands before the blank.
        for chosen, lead in (([w for w in words if w[0] == " " and w[1:2] > " "], ""), ([w for w in words if w.isalpha()], "\n")):
            for k in range(0, len(chosen), 5000):
                self._together(chosen[k : k + 5000], lead, out)
        return [out[w] if w in out else self._ask(w) for w in words]

    def _together(self, words: list[str], lead: str, out: dict[str, np.ndarray]) -> None:
        text = lead + lead.join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.type)
        size = [len(w) for w in words] if text.isascii() else [len(w.encode()) for w in words]
        ends, at = np.cumsum(np.array(size) + len(lead)), np.cumsum(self.lengths[ids])
        cut = np.searchsorted(at, ends)
        if not len(at) or at[-1] != ends[-1] or (at[cut] != ends).any():
            return
        last, skip = 0, len(lead)
        for word, end in zip(words, (cut + 1).tolist(), strict=True):
            out[word] = ids[last + skip : end]
            last = end

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Table numbers of the pre-tokens of plain texts without added tokens, and each text's first one, with the end."""
        whole, begin, length, h, first = pretokens.cut(texts)
        if self.table.full:
            self.renewed()
        words = self.table.find(h)
        new = np.flatnonzero(words < 0)
        if len(new):
            value, once = np.unique(h[new], return_index=True)
            at = new[once]
            listed = [whole[b : b + n] for b, n in zip(begin[at].tolist(), length[at].tolist(), strict=True)]
            self.table.add(value, *self.values(self._learned(listed)))
            words[new] = self.table.find(h[new])
        return words, first

    def quick(self, texts: list[str]) -> list[int]:
        """Texts that are cut here; the others go to the library whole."""
        return [k for k, t in enumerate(texts) if NOT_PLAIN.search(t) is None and not any(s in t for s in self.special)]


class Encoder(Grouped):
    """Ids of whole texts as little-endian bytes."""

    def encode_many(self, texts: list[str]) -> list[bytes]:
        quick = self.quick(texts)
        words, first = self.numbers([texts[k] for k in quick])
        ids, size = self.table.joined(words)
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        out: list[bytes] = [b""] * len(texts)
        data, width = ids.tobytes(), self.type.itemsize
        for k, a, b in zip(quick, (ends[:-1] * width).tolist(), (ends[1:] * width).tolist(), strict=True):
            out[k] = data[a:b]
        for k in set(range(len(texts))).difference(quick):
            out[k] = self._ask(texts[k]).tobytes()
        return out


class Counter(Grouped):
    """Token counts of whole texts: the frequent pre-tokens' lengths first, then what this worker has learned, then the library."""

    def __init__(self, path: str, frequent: tuple[np.ndarray, np.ndarray] | None = None, bits: int = TABLE_BITS):
        super().__init__(path, bits)
        self.frequent = frequent
        self.renewed()

    def value_type(self):
        return np.uint32

    def values(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([len(i) for i in ids], np.uint32), np.ones(len(ids), np.int64)

    def renewed(self) -> None:
        self.table.clear()
        if self.frequent is not None and len(self.frequent[0]):
            self.table.add(*self.frequent, np.ones(len(self.frequent[0]), np.int64))

    def count_many(self, texts: list[str]) -> list[int]:
        quick = self.quick(texts)
        words, first = self.numbers([texts[k] for k in quick])
        sums = np.concatenate([[0], np.cumsum(self.table.flat[self.table.offset[words]], dtype=np.int64)])[first]
        out = dict(zip(quick, np.diff(sums).tolist(), strict=True))
        return [out[k] if k in out else len(self._ask(t)) for k, t in enumerate(texts)]


def encoder(path: str) -> Encoder:
    """One encoder, and so one cache, for all tasks of a worker process."""
    if ("encoder", path) not in _loaded:
        _loaded["encoder", path] = Encoder(path)
    return _loaded["encoder", path]


def counter(path: str, name: str, frequent) -> Counter:
    """`frequent` is called once for each worker process and broadcast name."""
    if ("counter", path, name) not in _loaded:
        for old in [k for k in _loaded if k[:2] == ("counter", path)]:
            del _loaded[old]
        _loaded["counter", path, name] = Counter(path, frequent())
    return _loaded["counter", path, name]
