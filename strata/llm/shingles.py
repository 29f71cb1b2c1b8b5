"""Word shingles of whole texts as 64-bit hashes, computed inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

from strata.llm.worker import held

WORDS = 5
# Words whose hash a worker keeps; all are forgotten when there are more.
CACHED_WORDS = 200_000

# A to Z in lower case; the white space of the data contract is what bytes.split() splits at.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value




def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(32))


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """One hash per run of ``words`` words, repeats included.

    A text with fewer words has one shingle, the whole sequence; a text without
    words has none.
    """
    found = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(held("words", None, _WordHashes).__getitem__, found), np.uint64, len(found))
    size = min(words, len(hashes))
    n = len(hashes) - size + 1
    total = np.full(n, size, np.uint64) * _ODD
    for i in range(size):
        total = (total ^ hashes[i : i + n]) * _ODD
        total ^= total >> np.uint64(29)
    return mix(total)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))
