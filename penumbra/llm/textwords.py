"""Words of whole texts as arrays of 64-bit fingerprints, for the operators that work in Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose fingerprint each worker remembers.
KNOWN_WORDS = 300_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Fingerprints(dict):
    """Word (bytes) to fingerprint; frequent words are remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < KNOWN_WORDS:
            self[word] = value
        return value


KNOWN = Fingerprints()


def split_words(text: str | None, fold: bool) -> list[bytes]:
    """Words are what bytes.split() finds: runs without space, \\t, \\n, \\v, \\f, \\r. fold lowers A-Z only."""
    if not text:
        return []
    data = text.encode()
    return (data.lower() if fold else data).split()


def fingerprint(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * _A
    x ^= x >> np.uint64(29)
    x *= _B
    x ^= x >> np.uint64(32)
    return x


def windows(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of ``width`` words: a polynomial in the word fingerprints, scrambled."""
    n = len(prints) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    k = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out *= k
        out += prints[j : j + n]
    return mix(out)
