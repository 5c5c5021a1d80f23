"""Words of UTF-8 texts and their 64-bit hashes, for whole Arrow batches at once in numpy.

A word is a run of bytes other than space and bytes 9 to 13. Hashes are polynomial over the bytes modulo 2**64
with a random value for each byte, and mixed at the end; two different words share one with a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np

_RNG = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_P = 0x9E3779B97F4A7C1B | 1
_PINV = pow(_P, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], k = 1, 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 2**64))
            k *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def running(body: np.ndarray, lower: bool) -> np.ndarray:
    """Sums of the polynomial up to each byte: span() gets the hash of any run of bytes from them."""
    run = np.empty(len(body) + 1, np.uint64)
    run[0] = 0
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[body] * _power(_P, len(body)), out=run[1:])
    return run


def span(run: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((run[ends] - run[starts]) * _power(_PINV, len(run))[starts] + (ends - starts).astype(np.uint64))


def bounds(body: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs, within a text, of bytes that `outside` doesn't have."""
    n = len(body)
    inside = ~outside[body]
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(body: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts body[offsets[i]:offsets[i+1]]: each word's start, end and hash in order, and the words before each text."""
    if len(body) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    starts, ends = bounds(body, offsets, _SPACE)
    return starts, ends, span(running(body, lower), starts, ends), np.searchsorted(starts, offsets)


def chain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a sequence that has hash a, followed by b."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + b)
