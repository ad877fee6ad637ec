"""The numpy twin of ``columns.draw62``, used inside pandas tasks."""

from __future__ import annotations

import numpy as np

from voxtally.functions.columns import MIX_MULTIPLIER, MIX_RESAMPLE, MIX_SAMPLE, MIX_SEED

LOW_BITS = 30  # a draw is a word of 32 bits and the leading 30 bits of another
SLAB = 1 << 16  # draws made at once, so that they stay in the cache


def _mix(h: np.ndarray) -> np.ndarray:
    """In place; words of 32 bits overflow as the remainder that is wanted."""
    shifted = np.empty_like(h)
    for _ in range(2):
        h ^= np.right_shift(h, 16, out=shifted)
        h *= MIX_MULTIPLIER
    h ^= np.right_shift(h, 16, out=shifted)
    return h


def _words(seed: int, resample: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, high words of the draws)."""
    r, s = (np.array(v).astype(np.uint32) for v in (resample, sample))
    shape = np.broadcast_shapes(r.shape, s.shape)
    r, s = np.atleast_1d(r), np.atleast_1d(s)
    key = _mix(r * np.uint32(MIX_RESAMPLE) + np.uint32((seed * MIX_SEED) % (1 << 32)))
    high = _mix(s * np.uint32(MIX_SAMPLE) + key)
    high += key * np.uint32(5) + np.uint32(7)
    high ^= key
    return key.reshape(key.shape if len(shape) else ()), _mix(high).reshape(shape)


def high_word(seed: int, resample: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """The leading 32 of the 62 bits of ``draw62``; they order draws but for rare ties."""
    return _words(seed, resample, sample)[1]


def draw62(seed: int, resample: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """Broadcasts ``resample`` against ``sample``; returns int64."""
    key, high = _words(seed, resample, sample)
    low = _mix(np.array(high + key * np.uint32(3) + np.uint32(1), ndmin=1)).reshape(high.shape)
    return (high.astype(np.int64) << LOW_BITS) | (low >> 2)


def slabs(n: int, width: int) -> list[np.ndarray]:
    """The numbers 0..n-1 in runs that give about ``SLAB`` draws with ``width`` samples."""
    step = max(1, SLAB // max(1, width))
    return [np.arange(first, min(n, first + step)) for first in range(0, n, step)]
