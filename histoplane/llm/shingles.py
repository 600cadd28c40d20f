"""Word shingles as 64-bit hashes, computed with numpy on UTF-8 bytes.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``bytes.split()`` splits at; ``bytes.lower()`` lower-cases A-Z only.
"""

from __future__ import annotations

import numpy as np
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_R = np.uint64(29)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _R)) * _MIX
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def shingles(text: bytes | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer than k words give one for the whole sequence, none give none."""
    h = word_hashes(text)
    n = min(k, len(h))
    if not n:
        return h
    last = len(h) - n + 1
    acc = np.full(last, n, dtype=np.uint64)
    for i in range(n):
        acc = _mix(acc * _MUL + h[i : i + last])
    acc.sort()
    keep = np.empty(last, dtype=bool)
    keep[0] = True
    np.not_equal(acc[1:], acc[:-1], out=keep[1:])
    return acc[keep]


def set_key(sh: np.ndarray) -> int:
    """Signed 64-bit key of a shingle set: equal sets have equal keys."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(sh.tobytes(), seed=len(sh))).astype(np.int64))
