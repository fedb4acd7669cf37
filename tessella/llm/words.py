"""Words of a text: maximal runs of characters other than ASCII white space, lower-cased over A-Z only.

``bytes.split`` and ``bytes.lower`` do exactly that on UTF-8, much faster than a pattern over characters.
"""

from __future__ import annotations

import numpy as np
import xxhash


def lower_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes(dict):
    """word -> 64-bit hash, remembered up to ``limit`` words, then forgotten and started anew."""

    def __init__(self, limit: int = 400_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if it has fewer words."""
    if not len(hashes):
        return hashes
    width = min(n, len(hashes))
    rows = len(hashes) - width + 1
    value = np.full(rows, width, dtype=np.uint64)
    for i in range(width):
        value = mixed(value * np.uint64(31) + hashes[i : i + rows], i + 1)
    return np.unique(value)
