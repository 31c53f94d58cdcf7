"""Word shingle sets and their MinHash signatures."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import xxhash

_UP = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text, A-Z lower-cased,
    words split at ASCII white space.  Fewer words: one shingle of all; none: empty."""
    words = (text or "").encode("utf-8", "replace").translate(_UP).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.full(n, min(len(h), width), dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def set_key(hashes: np.ndarray) -> bytes | None:
    """128 bits that stand for the whole set; null for the empty set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


class MinHash:
    """Signatures of ``k`` coordinates of 32 bits."""

    def __init__(self, k: int, seed: int = 5):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.k = k
        self.a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(self.k, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(hashes), 1024):
            h = hashes[at:at + 1024, None] * self.a
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xFF51AFD7ED558CCD)
            h += self.b
            np.minimum(low, h.min(axis=0), out=low)
        return (low >> np.uint64(32)).astype(np.uint32)


def match_floor(k: int, similarity: float, miss: float) -> int:
    """Most matches that a pair of the given similarity reaches but for a chance of ``miss``."""
    below, t = 0.0, 0
    while t < k:
        below += math.comb(k, t) * similarity ** t * (1 - similarity) ** (k - t)
        if below > miss:
            break
        t += 1
    return max(t, 1)
