"""Word positions and word, shingle and window hashes of whole text batches, computed with array operations.

A word is a run of bytes other than the ASCII white space 0x20 and 0x09-0x0D; UTF-8 keeps these bytes out of other
characters, so working on bytes equals working on characters.
"""

from __future__ import annotations

import numpy as np

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of letters: A-Z, a-z and all bytes of non-ASCII characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS = np.ones(64, np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_STEP = 0x2545F4914F6CDD1D
_cache: dict[int, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a fixed permutation of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    held = _cache.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 256), base, np.uint64)
        held[0] = 1
        held = _cache[base] = np.multiply.accumulate(held)
    return held[:n]


def words(data: np.ndarray, offsets: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n + 1 word offsets of the rows. ``of`` marks the bytes of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = (~_WHITE if of is None else of)[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0, lower: bool = False) -> np.ndarray:
    """One 64-bit hash for each word; ``lower`` folds A-Z first. Lanes are independent."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    chars = data[place + np.repeat(starts, lens)]
    if lower:
        chars = _LOWER[chars]
    terms = (chars.astype(np.uint64) + np.uint64(1)) * _powers(_BASES[lane], int(lens.max()))[place]
    return mixed(np.add.reduceat(terms, at) + lens.astype(np.uint64))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring words; callers drop those that cross a row's end."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k, c in enumerate(_powers(_STEP, size)):
        total += hashes[k : k + n] * c
    return mixed(total)
