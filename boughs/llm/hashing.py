"""Vectorised 64-bit hashes of words and shingles, for operators that run in Python workers."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64


def mix(z: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


class WordHashes(dict):
    """Word bytes to their 64-bit hash; forgets all once it holds ``most`` words, so that it stays small."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashes of k consecutive words, sorted; of all words as one if they are fewer; none of none."""
    n = len(ids)
    if not n:
        return np.zeros(0, U)
    k = min(k, n)
    h = np.full(n - k + 1, k, U)
    for j in range(k):
        h = mix(h * U(0x9E3779B97F4A7C15) + ids[j : n - k + 1 + j])
    return np.unique(h)
