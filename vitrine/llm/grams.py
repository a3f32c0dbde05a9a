"""Hashes of words and of runs of words, as numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from vitrine.llm.memo import Memo

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _signed_hash(word: bytes) -> int:
    h = xxhash.xxh64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


#: The hashes that a worker remembers.
_MEMO = Memo(_signed_hash)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(_MEMO.many(words), np.int64, len(words)).view(np.uint64)


def run_hashes(words: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """A hash of every n consecutive words, in order; empty if there are fewer.

    A polynomial in the words, put together from runs of 1, 2, 4, ... words by the binary digits of n.
    """
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    run, size, factor = words, 1, np.full(1, ODD + np.uint64(2 * seed))  # an array: its products wrap silently
    out, done = np.zeros(count, np.uint64), 0
    while True:
        if n & size:
            out = out * factor + run[done : done + count]
            done += size
        if done == n:
            return mix(out)
        run = run[:-size] * factor + run[size:]
        factor = factor * factor
        size *= 2


def minimizers(hashes: np.ndarray, span: int) -> np.ndarray:
    """For every `span` consecutive hashes the position of the least one, the leftmost of equal ones.

    The least of a stretch is the least of two shorter ones that cover it, so stretches double.
    """
    count = len(hashes) - span + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, at, size = hashes, np.arange(len(hashes)), 1
    while size < span:
        step = min(size, span - size)
        less = best[step:] < best[:-step]
        best, at = np.where(less, best[step:], best[:-step]), np.where(less, at[step:], at[:-step])
        size += step
    return at
