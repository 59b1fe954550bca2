"""Words and shingles of texts as numpy hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

MEMO_WORDS = 200_000
MULT = np.uint64(0x9E3779B97F4A7C15)
SHIFTS = (np.uint64(30), np.uint64(27), np.uint64(31))
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> SHIFTS[0])) * MIX[0]
    x = (x ^ (x >> SHIFTS[1])) * MIX[1]
    return x ^ (x >> SHIFTS[2])


def word_hashes(text: str, memo: dict) -> np.ndarray:
    """64-bit hashes of the words: A-Z in lower case, split at ASCII blanks (bytes.split knows no others)."""
    if "m" not in memo:
        memo["m"] = _Memo()
    get = memo["m"].__getitem__
    words = text.encode().lower().split()
    return np.fromiter(map(get, words), np.uint64, len(words))


def shingle_hashes(text: str, k: int, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; a shorter text with words is one shingle."""
    w = word_hashes(text, memo)
    if not len(w):
        return w
    k = min(k, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64) + np.uint64(k)
    for i in range(k):
        h = mix(h * MULT + w[i : len(w) - k + 1 + i])
    return np.unique(h)
