"""Hashed spans, words and word shingles, MinHash signatures and exact Jaccard of texts."""

from __future__ import annotations

import numpy as np

WORDS, THRESHOLD = 5, 0.8
BASE = 0x9E3779B97F4A7C15
#: Positions hashed at once: a very long text needs no more room for powers than this, but for longer spans.
BLOCK = 1 << 18
_step = np.uint64(BASE)
_inverse = pow(BASE, -1, 1 << 64)
_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True


class Powers:
    """BASE to the i and its inverse, modulo 2^64, for as many positions as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int):
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            for name, b in (("up", BASE), ("down", _inverse)):
                powers = np.full(n, b, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        return self.up, self.down


_powers = Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads what differs in few bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span (starts and ends ascending, no span empty) that depends on its codes alone."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        part = codes[low : int(ends[to - 1])]
        up, down = _powers.upto(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64, out=sums[1:])
        first = starts[at:to] - low
        out[at:to] = mixed((sums[ends[at:to] - low] - sums[first]) * down[first])
        at = to
    return out


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of bytes start and end; words are divided by ASCII white space."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_blank[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(text: str) -> np.ndarray:
    """A hash for each lower-cased word."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    return span_hashes(raw, *word_spans(raw))


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """A hash for each run of `size` words; a shorter text is one shingle; no words, none."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = out * _step + words[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct hashes. Two empty sets are not alike."""
    if not len(a) or not len(b):
        return 0.0
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return both / (len(a) + len(b) - both)


class MinHash:
    """Signatures of k 32-bit values."""

    def __init__(self, k: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, k, dtype=np.uint32)
        self.k = k

    def of(self, hashes: np.ndarray, block: int = 128) -> np.ndarray:
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for at in range(0, len(short), block):
            np.minimum(out, (short[at : at + block, None] * self.a + self.b).min(0), out=out)
        return out
