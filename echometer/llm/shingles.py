"""Word shingles of whole texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WORDS = 5

#: Words whose hashes a worker remembers.
_REMEMBERED = 1 << 20

_MULTIPLIERS = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in UTF-8.

    A-Z become a-z and words are what white space (20, 09 to 0D) parts. A text of fewer words is one
    shingle, a text without words has none.
    """
    # bytes.lower and bytes.split know just these letters and these characters.
    found = text.lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mixed(out * _MULTIPLIERS[k % len(_MULTIPLIERS)] + hashed[k : k + count])
    return np.unique(out)
