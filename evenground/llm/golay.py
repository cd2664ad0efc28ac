"""The perfect binary Golay code [23, 12, 7] on NumPy words, built from its generator polynomial."""

from __future__ import annotations

from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011


def _remainder(word: int) -> int:
    for shift in range(11, -1, -1):
        if word >> (shift + 11) & 1:
            word ^= GENERATOR << shift
    return word


_HIGH = np.array([_remainder(high << 11) for high in range(1 << 12)], np.uint32)
_ERROR = np.zeros(1 << 11, np.uint32)
for _weight in (1, 2, 3):
    for _places in combinations(range(23), _weight):
        _word = sum(1 << p for p in _places)
        _ERROR[_remainder(_word)] = _word


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one codeword within distance 3 of each 23-bit word."""
    words = words.astype(np.uint32)
    syndrome = _HIGH[words >> 11] ^ (words & 0x7FF)
    return (words ^ _ERROR[syndrome]) >> 11


def nearby_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Indices of the codewords next to each word: what it and its ``bits`` one-bit neighbours decode to.

    One row per word, one column per neighbour, repeats included (there are 1 or 6 different ones per row when all 23
    bits vary). Two words that differ in at most two places have an index in common: both are neighbours of, or equal
    to, a word between them.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint32)
    return codeword_index(words.astype(np.uint32)[:, None] ^ flips[None, :])
