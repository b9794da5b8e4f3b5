"""Python's random numbers from any place of their sequence on.

random.Random and NumPy's RandomState share the Mersenne Twister and the way two of
its words make a number. Its state follows a linear law over bits, so the state
after any count of words is a sum of the first states, without the words between.
"""

from __future__ import annotations

import random
from functools import lru_cache

import numpy as np

#: Published constants: words of the state, the word that is mixed in, bits of a word's lower part, what an odd word adds.
WORDS, MIDDLE, LOWER, ADDED = 624, 397, 31, 0x9908B0DF
#: Bits of the state that count.
DEGREE = WORDS * 32 - LOWER


@lru_cache(1)
def _law() -> list[int]:
    """Exponents under DEGREE of the generator's characteristic polynomial, as Matsumoto and Nishimura give it."""
    power = lambda k: sum(1 << ((WORDS - 1) * j + (MIDDLE - 1) * (k - j)) for j in range(k + 1) if j & k == j)
    upper = 0
    for k, taken in [(LOWER, 1), *((LOWER - 1 - i, ADDED >> i & 1) for i in range(LOWER))]:
        upper ^= power(k) * taken
    law = upper << WORDS ^ upper << MIDDLE ^ ADDED >> LOWER
    return [e for e in range(DEGREE) if law >> e & 1]


def _steps(words: int) -> np.ndarray:
    """The first states, by number, whose sum is the state after so many words: x ** words modulo the law."""
    v = 1
    for bit in f"{words:b}":
        v = int("0".join(f"{v:b}"), 2) << int(bit)  # a square over bits has the same bits, twice as far apart
        while high := v >> DEGREE:
            v ^= high << DEGREE
            for e in _law():
                v ^= high << e
    return np.flatnonzero(np.frombuffer(f"{v:b}"[::-1].encode(), np.uint8) == ord("1"))


def random_after(seed: int, numbers: int) -> np.random.RandomState:
    """random_sample() goes on as random.Random(seed) does after so many calls of random()."""
    state = lambda key: {"bit_generator": "MT19937", "state": {"key": key, "pos": WORDS}}
    bits, key = np.random.MT19937(), np.array(random.Random(seed).getstate()[1][:-1], np.uint32)
    bits.state = state(key)
    if numbers:
        words = [key]
        for _ in range(DEGREE // WORDS + 1):
            bits.random_raw(WORDS, output=False)
            words.append(bits.state["state"]["key"])
        states = np.lib.stride_tricks.sliding_window_view(np.concatenate(words), WORDS)
        bits.state = state(np.bitwise_xor.reduce(states[_steps(2 * numbers)]))
    return np.random.RandomState(bits)
