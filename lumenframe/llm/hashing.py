"""64-bit hashes of words and arrays, for the operators that run in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose values are remembered in a worker; beyond it, all are forgotten.
CACHE_WORDS = 120_000

U64 = np.uint64
#: Odd multipliers of a common finaliser of 64-bit hashes.
MIX_A, MIX_B = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


class Remembered(dict):
    """Values of words by a function, remembered up to a bound."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.value(word)
        return found

    def array(self, words: list, dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype, len(words))


def word_hash(word: str | bytes) -> int:
    return xxhash.xxh64_intdigest(word)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers, one to one."""
    x = (x ^ (x >> U64(30))) * MIX_A
    x = (x ^ (x >> U64(27))) * MIX_B
    return x ^ (x >> U64(31))


def seeds(n: int, seed: int = 0) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)
