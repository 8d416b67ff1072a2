"""Words of UTF-8 bytes and their 64-bit hashes, whole arrays at a time.

A hash is a polynomial in an odd base modulo 2**64, so that the hash of any
range comes from one running sum: the base has an inverse, which moves a range
to the origin. Equal ranges have equal hashes; different ranges may too, so a
caller that needs certainty compares the bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BASE = 0x9E3779B97F4A7C15
BLOCK = 1 << 18
_ALL = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(b: int) -> np.ndarray:
        out = np.full(n, b, dtype=np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)

    return run(base & _ALL), run(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    size = 1 << max(12, (max(n, 1) - 1).bit_length())
    return _powers(base, size)


def mix(h: np.ndarray) -> np.ndarray:
    """Bits of every place of `h` spread over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=8)
def byte_values(fold: bytes) -> np.ndarray:
    """A 64-bit value for each byte, after the 256-byte table `fold`."""
    return mix(np.frombuffer(fold, dtype=np.uint8).astype(np.uint64) + np.uint64(1))


def ranges(starts: np.ndarray, ends: np.ndarray, values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hash of values[starts:ends] for each pair."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def split(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which the table `is_word` is 1."""
    flags = np.zeros(len(data) + 2, dtype=np.int8)
    flags[1:-1] = is_word[data]
    steps = np.diff(flags)
    return np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)


def word_hashes(
    data: np.ndarray, is_word: np.ndarray, fold: bytes
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words; byte arrays of 8 bytes a place exist for a block only."""
    starts, ends = split(data, is_word)
    if not len(starts):
        return starts, ends, np.zeros(0, dtype=np.uint64)
    values = byte_values(fold)
    # A block takes the words that start in it, to the end of the last one.
    cuts = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
    out = np.empty(len(starts), dtype=np.uint64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            low, high = starts[a], ends[b - 1]
            out[a:b] = ranges(starts[a:b] - low, ends[a:b] - low, values[data[low:high]])
    return starts, ends, mix(out)
