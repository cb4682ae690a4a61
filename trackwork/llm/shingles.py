"""Sets of word shingles as sorted 64-bit hashes.

Two different shingles of one pair of documents have equal hashes with a chance of about 1e-13, which
the operators that use this module accept.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_HALF = np.uint64(32)


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII white space, with A-Z in lower case."""
    return (text or b"").lower().split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), dtype=np.uint64, count=len(found))


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    values = (values ^ (values >> _HALF)) * _MULTIPLIERS[1]
    values = (values ^ (values >> _HALF)) * _MULTIPLIERS[2]
    return values ^ (values >> _HALF)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` words, in text order."""
    count = len(hashes) - size + 1
    total = np.zeros(max(count, 0), dtype=np.uint64)
    for i in range(size if count > 0 else 0):
        total = total * _MULTIPLIERS[0] + hashes[i : i + count]
    return mixed(total)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct shingles; a text of fewer words is one shingle, one without words has none."""
    found = words(text)
    if not found:
        return np.empty(0, dtype=np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    return np.unique(windows(word_hashes(found), size))
