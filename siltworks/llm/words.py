"""Words and shingles of a text as numpy arrays of 64-bit hashes, the same in every process."""

from __future__ import annotations

from functools import cache

import numpy as np

#: Odd multiplier of the rolling word hash; its inverse modulo 2^64 follows from it.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of splitmix64), another one for each seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1B54A32D192ED03 + BASE) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [
                np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (BASE, INVERSE)
            ]
    return _powers[0][:n], _powers[1][:n]


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words (runs of letters and digits) of the whole text, in order; null is empty."""
    if not text:
        return np.empty(0, np.uint64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(codes) + 2, np.int8)
    inside[1:-1] = _alnum()[codes]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    if not len(start):
        return np.empty(0, np.uint64)
    up, down = powers(len(codes))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        return mix((sums[end] - sums[start]) * down[start], 1)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words; of a shorter text that isn't empty, the hash of all its words."""
    if len(words) == 0:
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(width))
        for k in range(width):
            out = out * np.uint64(BASE) + words[k : k + n]
    return mix(out, 2)


def sequence_hash(words: np.ndarray) -> tuple[int, int]:
    """128 bits that equal word sequences share, as two signed 64-bit integers."""
    up, _ = powers(max(1, len(words)))
    with np.errstate(over="ignore"):
        a = int((mix(words, 3) * up[: len(words)]).sum(dtype=np.uint64))
        b = int((mix(words, 4) * up[: len(words)]).sum(dtype=np.uint64)) ^ len(words)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return sign(a), sign(b)
