"""Word n-gram sets of whole texts, as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_hash = xxhash.xxh64_intdigest
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers; a bijection."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Distinct windows of ``width`` words; a shorter text is one window of all its words, an empty one none."""
    words = text.encode().split()  # bytes split at 0x20 and 0x09 to 0x0D exactly
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_hash, words), np.uint64, len(words))
    if len(w) < width:
        return mix(np.add.reduce(w * _ODD[: len(w)], keepdims=True) + np.uint64(len(w)))
    n = len(w) - width + 1
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += w[j : j + n] * _ODD[j]
    return np.unique(mix(total))
