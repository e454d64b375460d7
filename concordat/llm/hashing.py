"""Vectorised polynomial hashes of byte strings, modulo 2^64, and a finishing mixer."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240229)
BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_POWERS: dict = {"n": 0}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse."""
    if _POWERS["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _P), ("down", pow(_P, -1, 2**64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["n"] = size
    return _POWERS["up"][:n], _POWERS["down"][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running sums of the values times their powers: ``(p[j] - p[i]) * down[i]`` is the hash of values i to j."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:-1], out=total[1:])
    return total


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))
