"""Signatures of operator 3: b-bit MinHash over word shingles, in numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from .common import LOWER, mix64, utf8

#: Bits kept of each minimum: one byte, so that bands are byte ranges of the packed signature.
BITS = 8
ROWS, BANDS = 5, 44
#: A sure link may be estimated lower by so many standard deviations before its check is skipped.
SIGMAS = 6


def word_hashes(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes of the words (runs of anything but ASCII white space, A-Z lowered)."""
    words = utf8(text).translate(LOWER).split()
    try:
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > 300_000:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sorted distinct hashes of ``size`` consecutive words, or of all words if they are fewer."""
    if not len(hashes):
        return hashes
    n = max(1, len(hashes) - size + 1)
    out = np.full(n, min(size, len(hashes)), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(size, len(hashes))):
            out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return np.unique(out)


def multipliers(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def signatures(sets: list[np.ndarray], count: int) -> np.ndarray:
    """A row of ``count`` bytes for each set, none of which may be empty: the low bits of the minima."""
    flat = np.concatenate(sets)
    begins = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), count), np.uint8)
    with np.errstate(over="ignore"):
        for k, a in enumerate(multipliers(count)):
            least = np.minimum.reduceat(flat * a, begins)
            out[:, k] = (mix64(least) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of signatures row by row, corrected for minima whose low bits agree by chance.

    Each lane of ``BITS`` bits of the exclusive or is folded into its lowest bit, and these are counted.
    """
    x = np.ascontiguousarray(a).view(np.uint64) ^ np.ascontiguousarray(b).view(np.uint64)
    for s in (4, 2, 1):
        x |= x >> np.uint64(s)
    differ = np.bitwise_count(x & np.uint64(0x0101010101010101)).sum(axis=1)
    same = 1 - differ / a.shape[1]
    chance = 1 / (1 << BITS)
    return (same - chance) / (1 - chance)


def least_estimate(similarity: float, count: int) -> float:
    return similarity - SIGMAS * math.sqrt(similarity * (1 - similarity) / count)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets: 100 * intersection >= percent * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


