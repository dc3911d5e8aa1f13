"""Word shingles of whole texts as sorted sets of 64-bit hashes, a slice of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from presswork.llm import common as C

_U = np.uint64
# Words are runs of anything but these bytes: space and \t to \r.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# A-Z to lower case, all other bytes as they are.
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = C.fmix(_LOWER.astype(_U) + _U(0x1F83D9ABFB41BD6B))


def _place_factors(width: int) -> np.ndarray:
    return C.fmix(np.arange(1, width + 1, dtype=_U) * _U(0xA0761D6478BD642F)) | _U(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the word offsets of each text."""
    base = int(offsets[0])
    data, offsets = data[base:int(offsets[-1])], offsets - base
    if not len(data):
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    prefix = C.prefix_hashes(_BYTE[data])
    return C.span_hash(prefix, start, end), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text.

    With fewer than ``width`` words the whole sequence is the one shingle; without
    words the set is empty.
    """
    factors = _place_factors(width)
    for first, last in C.slices(offsets):
        words, at = word_hashes(data, offsets[first:last + 1])
        full = max(len(words) - width + 1, 0)
        sums = np.zeros(full, _U)
        for j in range(width):
            sums += words[j:j + full] * factors[j]
        sums = C.fmix(sums)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= width:
                yield np.unique(sums[a:b - width + 1])
            elif b > a:
                short = (words[a:b] * factors[:b - a]).sum(dtype=_U) + _U(b - a)
                yield C.fmix(np.array([short], _U))
            else:
                yield np.zeros(0, _U)
