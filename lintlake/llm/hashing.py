"""Vectorised hashes of bytes, words and windows (numpy, 64 bit, the same on every machine)."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))


class Rolling:
    """Hashes of any slice of a sequence of 64-bit values, from one cumulative sum.

    The hash of ``[i, j)`` is ``mix(sum(value * M**position) / M**i)``: it depends on the values
    and their order alone, not on where they stand.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        with np.errstate(over="ignore"):
            powers = np.full(n, _MULTIPLIER, np.uint64)
            powers[:1] = 1
            self.sums = np.zeros(n + 1, np.uint64)
            np.cumsum(values * np.cumprod(powers), out=self.sums[1:])
            inverse = np.full(n + 1, _INVERSE, np.uint64)
            inverse[:1] = 1
            self.back = np.cumprod(inverse)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all windows of ``width`` values; none when there are fewer values."""
        n = len(self.sums) - 1
        if n < width:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.sums[width:] - self.sums[:-width]) * self.back[: n - width + 1])


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[0::2], edges[1::2]


def words_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of consecutive texts of ``raw`` (``ends[0]`` = 0): starts, ends, hashes, and the
    n + 1 word offsets of the texts. A word never spans two texts."""
    spread, shift = raw, np.zeros(len(ends) - 1, np.int64)
    if len(ends) > 2:  # a blank between neighbours
        lengths = np.diff(ends)
        shift = np.arange(len(lengths))
        spread = np.full(len(raw) + len(lengths), 32, np.uint8)
        spread[np.arange(len(raw)) + np.repeat(shift, lengths)] = raw
    starts, stops = word_spans(spread)
    hashes = Rolling(BYTE_VALUES[spread]).of(starts, stops)
    offsets = np.searchsorted(starts, ends[:-1] + shift)
    offsets = np.append(offsets, len(starts))
    back = np.repeat(shift, np.diff(offsets))
    return starts - back, stops - back, hashes, offsets
