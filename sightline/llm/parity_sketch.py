r"""Parity sketches of shingle sets, and the pigeonhole keys by which similar sets meet.

Each shingle hash flips one bit of a sketch: a bit is the parity of the shingles on it. A shingle in
one set alone flips one bit, so the Hamming distance of two sketches never exceeds the size d of the
symmetric difference. For sets of sizes a, b with Jaccard similarity p/q or more,
d <= (a + b)(q - p)/(q + p). The shingles are dealt to blocks by their hash; a block's value is the
exclusive or of its hashes, and a shingle in one set alone changes the value of one block. Of B blocks,
similar sets therefore share at least B - d values: these are the join keys, within bands of like sizes.

A block of few shingles says little and is shared by unlike sets. So a band has spare blocks, and each
set leaves out those that hold least: with d' the largest difference that the set can have to any
similar set of the band, it keeps d' + 1 of its blocks, ordered by (shingles, value). A shared block is
the same in both sets, so both order it alike; of the shared blocks the highest has B - d - 1 others
below it in either order, which is no less than either set leaves out: it is kept by both. No pair is
lost. A set is *own* in the band of its size and a *guest* in the bands of larger sets; two guests
meet in a lower band, so a bucket of guests alone gives nothing. The lowest bit of a key tells them apart.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_S32, _S29 = np.uint64(32), np.uint64(29)
_EVEN = ~np.uint64(1)
#: Words whose hash a worker remembers, some 8 MB, and bytes of the longest of them. More words made no text faster.
MEMO_WORDS, MEMO_BYTES = 50_000, 32
#: Each band holds sizes up to this ratio.
BAND_RATIO = 1.25
#: Spare blocks of a band, in proportion to those that it needs.
SPARE = 0.25


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S29)) * _M2
    return x ^ (x >> _S32)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= MEMO_BYTES:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = h
        return h


_HASH = _WordHash()


def shingle_set(words: list[bytes], width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a shorter sequence is one shingle, no words none."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, n)
    if n < width:
        return mix(np.array([_chain(h.tolist())], np.uint64))
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mix(out * _M3 + h[i : n - width + 1 + i])
    out.sort()  # plain sorting is several times faster than numpy.unique here
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def _chain(values: list[int]) -> int:
    return xxhash.xxh3_64_intdigest(np.array([len(values), *values], np.uint64).tobytes())


def set_id(hashes: np.ndarray) -> int:
    """64-bit id of a set; equal sets have equal ids."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Band:
    """Sizes low..high, met by smaller sets down to ``least``."""

    number: int
    least: int
    low: int
    high: int
    blocks: int


class Bands:
    """All size bands for Jaccard similarity of at least p/q."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.bands: list[Band] = []
        self.lows: list[int] = []
        low = 1
        while low < 1 << 31:
            high = max(low, int(low * BAND_RATIO) - 1)
            d = self.limit(2 * high)
            self.bands.append(Band(len(self.bands), -(-low * p // q), low, high, d + 1 + int(SPARE * (d + 1))))
            self.lows.append(low)
            low = high + 1

    def limit(self, total: int) -> int:
        """Largest symmetric difference of similar sets whose sizes add up to ``total``."""
        return total * (self.q - self.p) // (self.q + self.p)

    def of(self, n: int) -> list[Band]:
        """Bands in which a set of n elements looks for others; none if only equal sets are similar."""
        out = []
        k = bisect_right(self.lows, n) - 1
        while k < len(self.bands) and self.bands[k].least <= n:
            if self.limit(2 * self.bands[k].high):
                out.append(self.bands[k])
            k += 1
        return out

    def kept(self, band: Band, n: int) -> int:
        """Blocks that a set of n elements keeps in a band: one more than it can differ in from a similar set."""
        return self.limit(n + min(band.high, n * self.q // self.p)) + 1

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """64-bit keys of a sorted set of hashes: its fullest blocks of each band, even where it is own."""
        parts, n = [], len(hashes)
        top = hashes >> _S32
        for band in self.of(n):
            block = ((top * np.uint64(band.blocks)) >> _S32).astype(np.int64)  # ascending, as hashes are
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            value = np.zeros(band.blocks, np.uint64)
            value[block[first]] = np.bitwise_xor.reduceat(hashes, first)
            keys = mix(mix(value + _M3) ^ (np.uint64(band.number) << _S32 | np.arange(band.blocks, dtype=np.uint64)) * _M2)
            order = np.lexsort((keys, np.bincount(block, minlength=band.blocks)))
            parts.append((keys[order[band.blocks - self.kept(band, n) :]] & _EVEN) | np.uint64(n < band.low))
        return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

    def similar(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Exact: q * |a & b| >= p * |a | b|; empty sets are similar to nothing."""
        if not len(a) or not len(b) or min(len(a), len(b)) * self.q < max(len(a), len(b)) * self.p:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return self.q * both >= self.p * (len(a) + len(b) - both)


@lru_cache(maxsize=8)
def bands(p: int, q: int) -> Bands:
    return Bands(p, q)
