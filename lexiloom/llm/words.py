"""Words of many texts at once, as 64-bit hashes and as lanes, from their UTF-8 bytes.

A word's bytes fill lanes of eight. Each lane is mixed with its place by a bijection that isn't
linear, and the mixed lanes are added up with the length, so words that differ anywhere, however
far apart, share a hash only by chance. The lanes themselves tell two words apart for certain.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes handled together; a word that is longer stays whole.
PIECE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32
LANE = 8
_SALTS = np.random.default_rng(7).integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
#: Of a lane's bytes, those that belong to a word with so many bytes in it.
_FILLED = np.array([(1 << 8 * n) - 1 for n in range(LANE + 1)], np.uint64)


class Words(NamedTuple):
    """Hash, first byte and length of each word; its lanes follow each other from heads on."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    lanes: np.ndarray
    heads: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64; its constants are fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def find_words(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False) -> Words:
    """The words of the texts data[bounds[i]:bounds[i + 1]]; a word is a run of bytes that aren't separators, within one text.

    lower takes ASCII capitals for small letters. Hashes are the same in any batch.
    """
    found = []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:  # not within a word
            stop = separators[data[hi : hi + 4096]].nonzero()[0]
            if len(stop):
                hi += int(stop[0])
                break
            hi = min(n, hi + 4096)
        found.append(_piece(data[lo:hi], bounds, lo, separators, lower))
        lo = hi
    if not found:
        return Words(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    hashes, starts, lengths, lanes = (np.concatenate(c) for c in zip(*found, strict=True))
    count = lanes_of(lengths)
    return Words(hashes, starts, lengths, lanes, np.cumsum(count) - count)


def word_hashes(data: np.ndarray, bounds: np.ndarray, separators: np.ndarray = SPACE, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and length of every word."""
    return find_words(data, bounds, separators, lower)[:3]


def lanes_of(lengths: np.ndarray) -> np.ndarray:
    return (lengths + (LANE - 1)) // LANE


def places_in(count: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each run of so many."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count, count)


def _piece(data: np.ndarray, bounds: np.ndarray, base: int, separators: np.ndarray, lower: bool) -> tuple[np.ndarray, ...]:
    inside = ~separators[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[np.searchsorted(bounds, base) : np.searchsorted(bounds, base + len(data))] - base
    begins[edges] = inside[edges]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | begins[1:]
    starts, lengths = begins.nonzero()[0], stops.nonzero()[0] + 1
    lengths -= starts
    if not len(starts):
        return np.zeros(0, np.uint64), starts, lengths, np.zeros(0, np.uint64)
    raw = np.zeros(len(data) + LANE, np.uint8)
    raw[: len(data)] = SMALL[data] if lower else data
    wide = np.ndarray(len(data), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    count = lanes_of(lengths)
    place = places_in(count)
    lanes = wide[np.repeat(starts, count) + LANE * place]
    lanes &= _FILLED[np.minimum(np.repeat(lengths, count) - LANE * place, LANE)]
    sums = np.add.reduceat(mix(lanes ^ mix(place.astype(np.uint64) * _SALTS[0] + _SALTS[1])), np.cumsum(count) - count)
    return mix(sums + lengths.astype(np.uint64)), starts + base, lengths, lanes
