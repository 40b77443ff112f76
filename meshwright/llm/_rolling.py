"""Vectorised polynomial hashes of stretches of bytes, modulo 2^64."""

from __future__ import annotations

import numpy as np

#: An odd base, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the 0th to (n-1)th power, kept and grown as needed."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(12, (n - 1).bit_length())
        known = np.empty(size, np.uint64)
        known[0] = 1
        done, step = 1, base
        with np.errstate(over="ignore"):
            while done < size:
                known[done : 2 * done] = known[:done] * np.uint64(step)
                done, step = 2 * done, step * step & 0xFFFFFFFFFFFFFFFF
        _POWERS[base] = known
    return known[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * BASE^i, one longer than ``values``."""
    out = np.zeros(len(values) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(values)), out=out[1:])
    return out


def scramble(h: np.ndarray) -> np.ndarray:
    """Spread the weak low bits of a polynomial hash."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def stretches(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of values[start:end], equal wherever those are equal."""
    with np.errstate(over="ignore"):
        h = (sums[end] - sums[start]) * powers(INVERSE, len(sums))[start]
        return scramble(h + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
