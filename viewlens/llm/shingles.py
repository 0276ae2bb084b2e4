"""Word shingles of whole texts as sets of 64-bit hashes (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

from viewlens.llm.common import WordMemo

STEP = np.uint64(0x9E3779B97F4A7C15)  # odd; makes a shingle's hash depend on the words' order


def words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split()  # on bytes, both are ASCII-only


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes."""

    def __init__(self, size: int = 5):
        self.size = size
        self.hashes = WordMemo(xxhash.xxh64_intdigest, 100_000, room=16 << 20)

    def set_of(self, text: str | None) -> np.ndarray:
        found = words(text or "")
        n = len(found)
        if not n:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.hashes.__getitem__, found), np.uint64, n)
        k = min(self.size, n)
        s = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            s = mixed(s * STEP + h[j:n - k + 1 + j])
        # a shorter text's one shingle differs from every full one in its length
        return np.unique(mixed(s + np.uint64(k)))
