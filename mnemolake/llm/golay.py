"""The binary Golay code (23, 12, 7) as a table: 16-bit values to the indices of nearby codewords."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
REACH = 4
NEAR = 6  # codewords within REACH of a word, at most


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; zero for codewords."""
    left = np.array(words, np.uint32)
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        left ^= np.where(left >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - CHECK)), np.uint32(0))
    return left


@cache
def nearby(bits: int = 16) -> np.ndarray:
    """For each value of `bits` bits, set before zero bits, its codewords within REACH as 12-bit indices; -1 where fewer.

    The code is perfect: each word has one codeword within 3. Two words that differ in at most one bit share the first
    one's codeword, which is then within 4 of the other, so they share an index; up to two bits do through a word between.
    """
    errors = np.array(
        [sum(1 << i for i in places) for weight in range(REACH + 1) for places in combinations(range(LENGTH), weight)], np.uint32
    )
    of = syndrome(errors)
    order = np.argsort(of, kind="stable")  # by syndrome, lighter errors first
    start = np.searchsorted(of[order], np.arange(2**CHECK + 1))
    table = np.full((2**CHECK, NEAR), -1, np.int64)
    for value in range(2**CHECK):
        own = errors[order[start[value] : start[value + 1]]]
        table[value, : len(own)] = own
    words = np.arange(2**bits, dtype=np.uint32) << np.uint32(LENGTH - bits)
    error = table[syndrome(words)]
    return np.where(error < 0, -1, (words[:, None] ^ np.maximum(error, 0)) >> CHECK)
