"""Word hashes of whole texts in numpy, for tasks that work on shingles or word windows."""

from __future__ import annotations

import functools

import numpy as np

#: Odd multiplier of the rolling hash (from the golden ratio); arithmetic is modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and ASCII punctuation: what parts words when only letters and digits count.
_BREAK = _SPACE | np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, BASE), np.full(n, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None, plain: bool = False) -> np.ndarray:
    """64-bit hash of every word, in order; ASCII letters in either case are equal.

    Words are parted by white space, with ``plain`` by ASCII punctuation too.
    """
    if not text:
        return np.zeros(0, dtype=np.uint64)
    data = _LOWER[np.frombuffer(text.encode(), dtype=np.uint8)]
    inside = np.concatenate([[False], ~(_BREAK if plain else _SPACE)[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(max(17, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``size`` words and how often each occurs.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    w = words(text)
    if not len(w):
        return w, np.zeros(0, dtype=np.int64)
    n = min(size, len(w))
    out = np.zeros(len(w) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * BASE + w[k : k + len(out)]
    return np.unique(mix(out + np.uint64(n)), return_counts=True)
