"""Words of many texts at once, and 64-bit hashes of words and shingles.

All functions work on the concatenated bytes of a run of texts, so that a
batch costs a few numpy passes however many texts it holds.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Words of letters, digits and non-ASCII bytes, after lower-casing A-Z.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Words are what stands between ASCII white space.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB,
                  0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def lower_table() -> bytes:
    """A translation table that lower-cases A-Z only."""
    return _LOWER.tobytes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                x = np.full(size, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of the texts, and each text's first
    word number (n + 1 of them).  A word never crosses two texts."""
    w = is_word[data]
    n = len(w)
    firsts = offsets[:-1][offsets[:-1] < n]
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = w[:-1]
        before[firsts] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = w[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        after[lasts] = False
    ends = np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers,
                lower: bool = True) -> np.ndarray:
    """64-bit hash of the bytes of each span (A-Z lower-cased)."""
    up, down = powers.upto(len(data) + 1)
    x = (_LOWER[data] if lower else data).astype(np.uint64)
    x += np.uint64(1)
    x *= up[:len(data)]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(x, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5
                   ) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words of each text and the text it is of;
    a text of fewer words, but not none, has one shingle of all its words.
    ``first``: each text's first word number (n + 1 of them)."""
    counts = np.diff(first)
    n = len(words)
    text_of = np.repeat(np.arange(len(counts)), counts)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = first[1:][text_of] - np.arange(n)  # words of the text from here on
    h = np.zeros(n, np.uint64)
    for j in range(min(size, n)):
        # A text's end stops the sum, so short texts get the hash of what they have.
        x = words[j:] * _STEP[j % len(_STEP)] + np.uint64(j // len(_STEP))
        if j:
            x = np.where(left[:n - j] > j, mix(x), np.uint64(0))
            h[:n - j] += x
        else:
            h += mix(x)
    at_start = np.arange(n) == first[:-1][text_of]
    keep = (left >= size) | (at_start & (left < size))
    length = np.minimum(left[keep], size).astype(np.uint64)
    return mix(h[keep] + length * np.uint64(0xC2B2AE3D27D4EB4F)), text_of[keep]


def distinct_per_text(hashes: np.ndarray, text_of: np.ndarray, n_texts: int
                      ) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and each text's first
    place in them (n + 1 of them)."""
    if len(hashes) == 0:
        return hashes, np.zeros(n_texts + 1, np.int64)
    order = np.argsort(hashes)
    # 16-bit numbers are sorted by radix.
    small = text_of.astype(np.uint16) if n_texts < 1 << 16 else text_of
    order = order[np.argsort(small[order], kind="stable")]
    h, t = hashes[order], text_of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[new], t[new]
    return h, np.searchsorted(t, np.arange(n_texts + 1))
