"""The perfect binary Golay code of length 23, as lookup tables made from its generator polynomial."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
LENGTH, CHECK_BITS = 23, 11


@cache
def _bit_syndromes() -> np.ndarray:
    """Remainder of x^i by the generator, for each i."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> CHECK_BITS:
            r ^= GENERATOR
    return np.array(out, np.int64)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits, and for each syndrome the errors of up to four bits that have it.

    The code is perfect: a syndrome has exactly one error of at most three bits, in column 0.  If that one has three
    bits there are five of four bits as well, columns 1 to 5; else these columns hold -1.
    """
    bits = _bit_syndromes()

    def span(part: np.ndarray) -> np.ndarray:
        out = np.zeros(1, np.int64)
        for s in part:
            out = np.concatenate([out, out ^ s])
        return out

    errors = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    for weight in range(5):
        for at in combinations(range(LENGTH), weight):
            s = 0
            for i in at:
                s ^= int(bits[i])
            if weight < 4 or filled[s] and bin(int(errors[s, 0])).count("1") == 3:
                errors[s, filled[s]] = sum(1 << i for i in at)
                filled[s] += 1
    return span(bits[:12]), span(bits[12:]), errors


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high, _ = _tables()
    return low[words & 0xFFF] ^ high[words >> 12]


def nearest(words: np.ndarray) -> np.ndarray:
    """12-bit index of the only codeword within three bits of each word."""
    return (words ^ _tables()[2][syndrome(words), 0]) >> CHECK_BITS


def nearby(words: np.ndarray) -> np.ndarray:
    """Indices of all codewords within four bits of each word: (n, 6), -1 where there are fewer.

    If two words differ in at most one bit, ``nearest`` of either is among ``nearby`` of the other.
    """
    errors = _tables()[2][syndrome(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)
