"""Words, word hashes and shingle hashes of whole texts, vectorised per document.

Words are maximal runs outside the six ASCII white space bytes, which is what ``bytes.split()`` cuts at. Hashes are
64 bits wide; arithmetic wraps modulo 2^64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from xxhash import xxh3_64_intdigest

#: Odd multipliers (fixed values): the golden ratio's and two finaliser constants.
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)
#: A vocabulary cache is emptied at this size, so that a worker's memory is bounded.
CACHE = 250_000


class WordHash(dict):
    """word -> its 64-bit hash; remembers the words seen."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 of each text; null: empty."""
    for value in batch.column(name).cast(pa.large_binary()):
        yield value.as_py() or b""


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * MIX[1]
    h = (h ^ (h >> np.uint64(27))) * MIX[2]
    return h ^ (h >> np.uint64(31))


def shingles(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in order of their starts."""
    if len(words) < n:
        return words[:0]
    out = np.full(len(words) - n + 1, np.uint64(salt * 2 + 1), dtype=np.uint64)
    for i in range(n):
        out = (out ^ words[i : len(out) + i]) * MIX[0]
        out ^= out >> np.uint64(29)
    return mixed(out)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes; with fewer words, the whole sequence as one; without words, none."""
    if len(words) == 0:
        return words
    return np.unique(shingles(words, min(n, len(words)), salt=min(n, len(words))))


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """A bit per hash modulo ``bits`` (a multiple of 64), as 64-bit words."""
    flags = np.zeros(bits, dtype=np.uint8)
    flags[hashes % np.uint64(bits)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)
