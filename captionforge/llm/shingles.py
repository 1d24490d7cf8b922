"""Hashed words and word shingles of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np
from pandas.util import hash_array

BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their order looks random (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and where each text's words end (with a 0 before)."""
    words: list[bytes] = []
    ends = np.zeros(len(texts) + 1, "i8")
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        words += (raw.lower() if lower else raw).split()
        ends[k + 1] = len(words)
    hashes = hash_array(np.array(words, object), categorize=False) if words else np.zeros(0, "u8")
    return hashes, ends


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of k words, at its first word."""
    if len(hashes) < k:
        return np.zeros(0, "u8")
    out = np.zeros(len(hashes) - k + 1, "u8")
    for j in range(k):
        out = out * BASE + hashes[j : len(hashes) - k + 1 + j]
    return mixed(out)


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct k-word shingles; fewer than k words are one shingle, no words none."""
    hashes, ends = word_hashes(texts)
    whole = runs(hashes, k)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            out.append(runs(np.append(hashes[a:b], np.uint64(b - a)), b - a + 1))
        else:
            out.append(np.zeros(0, "u8"))
    return out
