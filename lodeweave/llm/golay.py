"""Fuzzy keys from the perfect binary Golay code of length 23.

Every 23-bit word has exactly one codeword within three bits. Two words that differ in at most two bits have a word
between them that differs from each in at most one, so the codeword nearest to that one is within four bits of both: the
codewords within four bits of a word are its keys, and such two words share at least one of them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

#: The generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. A fixed value.
GENERATOR = 0b101011100011
LENGTH, CHECKS, RADIUS = 23, 11, 4


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndrome of each single bit, and for each syndrome the error patterns of up to RADIUS bits, padded with -1."""
    unit = np.zeros(LENGTH, dtype=np.int64)
    for bit in range(LENGTH):
        rest = 1 << bit
        for high in range(LENGTH - 1, CHECKS - 1, -1):
            if rest >> high & 1:
                rest ^= GENERATOR << (high - CHECKS)
        unit[bit] = rest
    found: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(LENGTH), weight):
            syndrome = 0
            for b in bits:
                syndrome ^= int(unit[b])
            found[syndrome].append(sum(1 << b for b in bits))
    patterns = np.full((1 << CHECKS, max(map(len, found))), -1, dtype=np.int64)
    for s, errors in enumerate(found):
        patterns[s, : len(errors)] = errors
    return unit, patterns


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word, the 12-bit indices of the codewords within RADIUS bits of it, padded with -1."""
    unit, patterns = _tables()
    words = words.astype(np.int64)
    syndrome = np.zeros_like(words)
    for b in range(LENGTH):
        syndrome ^= np.where(words >> b & 1, unit[b], 0)
    errors = patterns[syndrome]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECKS)


def segments(prints: np.ndarray) -> list[np.ndarray]:
    """A 64-bit fingerprint as words of 22, 21 and 21 bits, each padded with zero bits to LENGTH."""
    prints = prints.astype(np.uint64)
    return [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in ((42, 22), (21, 21), (0, 21))]


def link_keys(prints: np.ndarray) -> np.ndarray:
    """Keys of which two fingerprints that differ in at most two bits share at least one; padded with -1.

    With two errors at most, one of the three segments is free of errors and the one before it (in a circle) has two at
    most: a key is the exact value of the one and a codeword index of the other.
    """
    parts, out = segments(prints), []
    for i in range(3):
        near = codeword_indices(parts[i - 1])
        out.append(np.where(near < 0, -1, (parts[i][:, None] << 14) | (near << 2) | i))
    return np.concatenate(out, axis=1)
