"""Hashes of every stretch of a byte string at once, by numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Powers that stay with a worker; longer texts have their own.
_KEPT = 1 << 17


def _computed(length: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.full(length, _MULTIPLIER, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps)
    steps[1:] = _INVERSE
    return powers, np.cumprod(steps)


_kept_powers = lru_cache(maxsize=1)(lambda: _computed(_KEPT))


def _powers(length: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``length`` powers of the multiplier, and of its inverse."""
    return _kept_powers() if length <= _KEPT else _computed(length)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits (the finalizer of SplitMix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


class Stretches:
    """Polynomial hashes modulo 2**64 of stretches of bytes or code points, from prefix sums."""

    def __init__(self, data: bytes | np.ndarray):
        data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
        values = _BYTE_VALUES[data] if data.dtype == np.uint8 else mixed(data.astype(np.uint64))
        powers, self.inverses = _powers(len(values) + 1)
        self.size = len(values)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverses[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """The hash of each stretch of ``width`` bytes, by its start."""
        count = max(0, self.size - width + 1)
        return mixed((self.sums[width : width + count] - self.sums[:count]) * self.inverses[:count])
