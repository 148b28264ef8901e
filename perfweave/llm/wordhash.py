"""Vectorised 64-bit hashes of words and word windows (numpy, inside tasks).

A text is UTF-8 bytes; words are the runs between the bytes 0x20 and
0x09-0x0D.  A word's hash is a polynomial over its bytes (each byte first
mapped to a random 64-bit number), mixed; a window's hash is a polynomial over
its words' hashes, mixed again.  All arithmetic is modulo 2**64 with odd
bases, so prefix sums give every window at once.  Two seeds give 128 bits.
"""

from __future__ import annotations

import functools

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (a copy; wraps modulo 2**64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@functools.lru_cache(maxsize=8)
def _tables(seed: int) -> tuple[np.ndarray, int]:
    rng = np.random.default_rng(7919 + seed)
    return rng.integers(0, 1 << 64, 256, U64), int(rng.integers(0, 1 << 63)) * 2 + 1


@functools.lru_cache(maxsize=16)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_table(base: int, n: int) -> np.ndarray:
    size = _CHUNK
    while size < n:
        size *= 2
    return _powers(base, size)[:n]


def word_hashes(text: bytes, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a text."""
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, U64), starts, ends
    table, base = _tables(seed)
    # Position inside the word, so equal words have equal sums at any place.
    at = np.arange(len(b), dtype=np.int64)
    at -= np.repeat(starts, np.diff(np.append(starts, len(b)))) if starts[0] == 0 else np.concatenate(
        [np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(b))))])
    value = table[b]
    value *= _power_table(base, int(at.max()) + 1)[at]
    value[space] = 0
    total = np.add.reduceat(value, starts)
    return mix(total + (ends - starts).astype(U64) * U64(0x9E3779B97F4A7C15)), starts, ends


def window_hashes(words: np.ndarray, size: int, at: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Hashes of the windows of ``size`` words that start at ``at`` (all, if not given)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, U64)
    if at is None:
        at = np.arange(n)
    base = _tables(seed + 101)[1]
    inverse = pow(base, -1, 1 << 64)
    total = np.empty(len(words) + 1, U64)
    total[0] = 0
    np.cumsum(mix(words ^ U64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) * _power_table(base, len(words)), out=total[1:])
    return mix((total[at + size] - total[at]) * _power_table(inverse, n)[at])
