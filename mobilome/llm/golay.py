"""The binary Golay code of length 23, and fuzzy keys from it.

Every 23-bit word lies within 3 bits of exactly one codeword.  Two words that
differ in at most 2 bits have a word between them that is within 1 of both, so
its codeword is within 4 of both: the codewords within 4 of a word (one, or six)
are keys of which such two words share at least one.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011
REACH = 4
MOST_KEYS = 6


@cache
def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Remainders modulo the generator of the low 12 bits and of the high 11 bits of a word."""
    power = []
    for i in range(LENGTH):
        r = 1 << i
        for d in range(i, CHECK - 1, -1):
            if r >> d & 1:
                r ^= GENERATOR << (d - CHECK)
        power.append(r)

    def table(bits: list[int]) -> np.ndarray:
        t = np.zeros(1, np.int64)
        for p in bits:
            t = np.concatenate((t, t ^ p))
        return t

    return table(power[:12]), table(power[12:])


def syndrome(words: np.ndarray) -> np.ndarray:
    low, high = _syndromes()
    return low[words & 0xFFF] ^ high[words >> 12]


@cache
def _errors() -> np.ndarray:
    """Per syndrome the error patterns of at most REACH bits, padded with -1."""
    table = np.full((1 << CHECK, MOST_KEYS), -1, np.int64)
    used = np.zeros(1 << CHECK, np.int64)
    for weight in range(REACH + 1):
        for bits in combinations(range(LENGTH), weight):
            e = sum(1 << b for b in bits)
            s = int(syndrome(np.array([e]))[0])
            table[s, used[s]] = e
            used[s] += 1
    return table


def keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) 12-bit indices of the codewords within REACH of each word, -1 where there are fewer."""
    errors = _errors()[syndrome(words)]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> CHECK, -1)
