r"""Pre-tokens of whole groups of texts in numpy, and a compact table of what the library made of each.

The pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+` only looks at the class of a
character and at its neighbours, so the places where pre-tokens begin follow from a few shifted comparisons of the
classes of all characters of a group. A pre-token is known by a 64-bit hash of its characters and by its length.
"""

from __future__ import annotations

import numpy as np

from atlasloom.llm.jaccard import word_hashes

LETTER, DIGIT, MARK, SPACE = 0, 1, 2, 3
#: Classes of the characters below U+2030 (plain texts have no others), as Python's own tables give them.
CLASSES = np.array([LETTER if chr(c).isalpha() else DIGIT if chr(c).isdecimal() else SPACE if chr(c).isspace() else MARK for c in range(0x2030)], np.uint8)
ENDINGS = {2: "stmd", 3: ("re", "ve", "ll")}


def starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin; `points` are the characters of all texts, `offsets` where each text begins, and the end."""
    n = len(points)
    kind = CLASSES[points]
    space, blank = kind == SPACE, points == 32
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first, last = first[:n], first[1:]
    before = np.concatenate([[np.uint8(SPACE)], kind[:-1]])
    blank_before = np.concatenate([[False], blank[:-1]])
    space_after = np.concatenate([space[1:], [True]]) | last
    # A character other than white space begins one where the class changes, but joins a single blank before it; of a
    # run of white space the last character stands apart, unless the run ends its text.
    begin = np.where(space, (before != SPACE) | ~space_after, np.where(before == SPACE, ~blank_before, before != kind))
    begin |= first
    # A contraction begins at an apostrophe that begins a pre-token.
    at = np.flatnonzero(points == 39)
    at = at[begin[at] & ~(blank_before[at] & ~first[at])]
    if len(at):
        text_end = offsets[np.searchsorted(offsets, at, side="right")]
        take = lambda k: np.where(at + k < text_end, points[np.minimum(at + k, n - 1)], 0)
        one, two = take(1), take(2)
        size = np.where(np.isin(one, [ord(c) for c in ENDINGS[2]]), 2, 0)
        for pair in ENDINGS[3]:
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 3
        at, size, text_end = at[size > 0], size[size > 0], text_end[size > 0]
        begin[at + 1] = False
        begin[(at + 2)[size == 3]] = False
        after = at + size
        begin[after[after < text_end]] = True
    return np.flatnonzero(begin)


class Table:
    """Hash table in numpy from pre-token hashes to values; a value is a run of numbers in one flat array."""

    def __init__(self, dtype, bits: int = 22):
        self.least, self.dtype = bits, dtype
        self.clear()

    def clear(self) -> None:
        self.bits = self.least
        self.slot = np.zeros(1 << self.bits, np.uint64)
        self.word = np.zeros(1 << self.bits, np.int32)
        self.n, self.used = 0, 0
        self.offset, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, self.dtype)

    @property
    def full(self) -> bool:
        return self.n > 0.5 * (1 << self.least)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words, -1 for unknown ones. Hashes are never 0."""
        out = np.full(len(h), -1, np.int32)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            there = self.slot[at]
            hit = there == h[left]
            out[left[hit]] = self.word[at[hit]]
            on = ~hit & (there != 0)
            left, at = left[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _place(self, h: np.ndarray, number: np.ndarray) -> None:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.slot[at] == 0
            self.slot[at[free]] = h[left[free]]
            own = free & (self.slot[at] == h[left])
            self.word[at[own]] = number[left[own]]
            left, at = left[~own], (at[~own] + 1) & ((1 << self.bits) - 1)

    def add(self, h: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Distinct unknown hashes, their values one after another and the size of each; one group of texts may make the table larger, until it is cleared."""
        if self.n + len(h) > 0.7 * (1 << self.bits):
            held = self.slot != 0
            known, numbers = self.slot[held], self.word[held]
            while self.n + len(h) > 0.5 * (1 << self.bits):
                self.bits += 1
            self.slot, self.word = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(known, numbers)
        self._place(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        while self.n + len(h) + 1 > len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.offset[self.n + 1 : self.n + len(h) + 1] = self.used + np.cumsum(size)
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + len(h), self.used + len(flat)

    def sizes(self, words: np.ndarray) -> np.ndarray:
        return self.offset[words + 1] - self.offset[words]

    def joined(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of words one after another, and the size of each."""
        size = self.sizes(words)
        run = np.repeat(self.offset[words] - (np.cumsum(size) - size), size)
        return self.flat[run + np.arange(len(run))], size


def cut(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of plain texts: them joined; begin, length and hash of each pre-token; and each text's first pre-token, with the end."""
    whole = "".join(texts)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    if not len(points):
        return whole, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    begin = starts(points, offsets)
    length = np.diff(np.append(begin, len(points)))
    h = word_hashes(points, begin, length)
    h[h == 0] = 1
    return whole, begin, length, h, np.searchsorted(begin, offsets)


def hashes(words: list[str]) -> np.ndarray:
    """Hashes of single pre-tokens, as `cut` gives them."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    length = np.array([len(w) for w in words], np.int64)
    h = word_hashes(points, np.cumsum(length) - length, length)
    h[h == 0] = 1
    return h
