"""Hashes of words and word sequences inside tasks (numpy)."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 150_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word -> 64-bit hash, kept per worker up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit hashes (a bijection)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


class Prefix:
    """Sums of a text's word hashes, scaled by powers, from which the hash of
    any run of words follows in constant time (polynomials modulo 2**64)."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        if n > len(Prefix.powers):
            Prefix.powers, Prefix.inverses = (
                np.multiply.accumulate(np.append(np.uint64(1), np.full(2 * n, x, np.uint64)), dtype=np.uint64)
                for x in (_MULTIPLIER, np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(words * Prefix.inverses[:n - 1], out=self.sums[1:])

    def runs(self, n: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the ``n`` words from each place (all places: ``at`` None)."""
        k = len(self.sums) - n
        if at is None:
            if k <= 0:
                return np.empty(0, np.uint64)
            return mix((self.sums[n:] - self.sums[:k]) * Prefix.powers[n - 1:n - 1 + k])
        return mix((self.sums[at + n] - self.sums[at]) * Prefix.powers[at + n - 1])


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive hashes; fewer than ``n``: none."""
    return Prefix(words).runs(n)
