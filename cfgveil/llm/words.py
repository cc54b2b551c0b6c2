"""Words, word hashes and shingle hashes of whole batches of texts, in numpy.

A word is a maximal run of bytes other than space and x09-x0D; A-Z count as a-z. Hashes are
64-bit, over random values of the bytes, and mixed; they stand for words and shingles where
sets of one or two texts are compared (a clash there has a chance below n^2 / 2^64).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
STEP = 1 << 16  # bytes hashed at once: the working arrays stay in the processor's cache


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a copy of x is changed)."""
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_values(fold: bool = True) -> np.ndarray:
    """A fixed random odd 64-bit value for each byte; `fold`: A-Z have the values of a-z."""
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
    if fold:
        values[65:91] = values[97:123]
    return values


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = 0x9E3779B97F4A7C15
            size = max(n, STEP + 1)
            for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
                x = np.full(size, b, U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=U))
        return self.up, self.down


def is_space() -> np.ndarray:
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return space


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of each text (and the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~is_space()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a text's end ends its last word
    before = np.empty_like(ink)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.empty_like(ink)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hashes of byte ranges that start in ascending order."""
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + STEP)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        up, down = powers.upto(hi - lo + 1)
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(values[data[lo:hi]] * up[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    return hash_spans(data, starts, ends, byte_values(), powers)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words within each text, ordered by text: (hash, text, word index).

    A text with fewer words than `size`, but some, has its whole sequence as one shingle.
    """
    n = np.diff(first)
    by_text = np.repeat(np.arange(len(n)), n)
    out, texts, at = [], [], []
    for k in range(1, size + 1):
        wanted = n >= size if k == size else n == k
        if not wanted.any():
            continue
        index = np.arange(first[-1])[wanted[by_text]]
        index = index[index + k <= first[by_text[index] + 1]]
        h = np.full(len(index), k, U)
        for j in range(k):
            h = mix(h * U(0x9E3779B97F4A7C15) + words[index + j])
        out.append(h)
        texts.append(by_text[index])
        at.append(index)
    if not out:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, t, a = np.concatenate(out), np.concatenate(texts), np.concatenate(at)
    if len(out) > 1:
        order = np.argsort(a, kind="stable")
        h, t, a = h[order], t[order], a[order]
    return h, t, a
