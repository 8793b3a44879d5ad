"""Word shingles of texts as 64-bit hashes, and their min-wise signatures."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
WIDTH = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Shingles hashed at once, which bounds the work arrays of a long text.
BLOCK = 8_192


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word; A-Z are lowered, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words."""
    n = len(words) - width + 1
    out = words[:n].copy()
    for k in range(1, width):
        out = out * STEP + words[k : k + n]
    return mixed(out)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` are one shingle, none is none."""
    words = word_hashes(text)
    if not len(words):
        return words
    if len(words) < width:
        return windows(words, len(words)) ^ np.uint64(len(words))
    return np.unique(windows(words, width))


class MinHash:
    """``count`` universal hash functions over shingle hashes, fixed by ``seed``."""

    def __init__(self, count: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.factor = draw.integers(0, 1 << 32, (count, 1), dtype=np.uint32) | np.uint32(1)
        self.shift = draw.integers(0, 1 << 32, (count, 1), dtype=np.uint32)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """The low 16 bits of the least value of every function over a set that is not empty."""
        folded = (shingles >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(self.factor), np.iinfo(np.uint32).max, dtype=np.uint32)
        for at in range(0, len(folded), BLOCK):
            part = folded[None, at : at + BLOCK]
            least = np.minimum(least, (self.factor * part + self.shift).min(axis=1))
        return mixed(least.astype(np.uint64)).astype("<u2")
