"""The perfect binary Golay code: 23 bits, 12 of them information, any two codewords 7 bits apart.

Every 23-bit word is within 3 bits of one codeword.  A word has one codeword within 4 bits, or six when
the nearest is 3 bits away.  Two words that differ in at most 2 bits have a word halfway between them, at
most one bit from either; its codeword is within 4 bits of both.  So the codewords within 4 bits, as
keys, bring together all words that differ in at most 2 bits.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

BITS = 23
CHECKS = 11
#: Generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
RADIUS = 4


def remainder(word: int) -> int:
    for bit in range(BITS - 1, CHECKS - 1, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - CHECKS)
    return word


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome, its errors of at most 4 bits and their number."""
    single = [remainder(1 << bit) for bit in range(BITS)]

    def spread(bits: list[int]) -> np.ndarray:
        out = np.zeros(1 << len(bits), dtype=np.int64)
        for i, syndrome in enumerate(bits):
            out[1 << i : 2 << i] = out[: 1 << i] ^ syndrome
        return out

    errors: list[list[int]] = [[] for _ in range(1 << CHECKS)]
    for weight in range(RADIUS + 1):
        for bits in combinations(range(BITS), weight):
            syndrome = pattern = 0
            for bit in bits:
                syndrome ^= single[bit]
                pattern |= 1 << bit
            errors[syndrome].append(pattern)
    number = np.array([len(e) for e in errors], dtype=np.int64)
    padded = np.zeros((len(errors), number.max()), dtype=np.int64)
    for i, e in enumerate(errors):
        padded[i, : len(e)] = e
    return spread(single[:12]), spread(single[12:]), padded, number


def indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (the 12 information bits) of the codewords within 4 bits: a row per word, and how many of it hold."""
    low, high, errors, number = tables()
    syndrome = low[words & 0xFFF] ^ high[words >> 12]
    return (words[:, None] ^ errors[syndrome]) >> CHECKS, number[syndrome]
