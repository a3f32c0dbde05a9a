"""Hashes of all words of a buffer at once, without an object for each word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

from vitrine.llm.grams import ODD, mix

#: Bytes that one pass of prefix sums covers; the tables of powers have this length.
CHUNK = 1 << 17
#: Longer words are hashed one by one.
LONG = 64
#: Texts are joined to buffers of about so many bytes; a longer text is a buffer of its own.
BUFFER = 1 << 20

FACTOR = 0xD1342543DE82EF95
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
_POWERS = np.cumprod(np.full(CHUNK, FACTOR, np.uint64))
_INVERSES = np.cumprod(np.full(CHUNK, pow(FACTOR, -1, 1 << 64), np.uint64))
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def buffers(texts: Iterable[str]) -> Iterator[list[bytes]]:
    """The texts in order, as UTF-8, in lists of about `BUFFER` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode())
        size += len(held[-1]) + 1
        if size >= BUFFER:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of every word between blanks and the word's hash.

    A hash is a polynomial in values of the word's bytes modulo 2**64. Differences of running sums give the words'
    own sums times a power, which its inverse takes away. Words over `LONG` bytes have the XXH64 of their bytes instead.
    """
    buf = np.frombuffer(text, np.uint8)
    blank = np.ones(len(buf) + 2, bool)
    blank[1:-1] = _BLANK[buf]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        origin = starts[at]
        upto = max(int(np.searchsorted(ends, origin + CHUNK, "right")), at + 1)
        piece = buf[origin : min(ends[upto - 1], origin + CHUNK)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUES[piece] * _POWERS[: len(piece)], out=sums[1:])
        first, last = starts[at:upto] - origin, np.minimum(ends[at:upto] - origin, CHUNK)
        out[at:upto] = (sums[last] - sums[first]) * _INVERSES[first]
        at = upto
    for i in np.flatnonzero(ends - starts > LONG):
        out[i] = xxhash.xxh64_intdigest(text[starts[i] : ends[i]])
    return starts, mix(out + (ends - starts).astype(np.uint64) * ODD)
