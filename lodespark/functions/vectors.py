"""Hashed trigram vectors: FNV-1a over code points, counted in buckets.

Counts and squared lengths are whole numbers, so products of two vectors are exact
in any order of summation and a similarity is one division."""

from __future__ import annotations

import numpy as np

DIM, N, OFFSET, PRIME, MASK = 512, 3, 2166136261, 16777619, 0xFFFFFFFF


def buckets(text: str | None, dim: int = DIM) -> np.ndarray:
    """The bucket of each trigram of the lower-cased text; one of under three characters gets two spaces at the end, the empty one has none."""
    text = (text or "").lower()
    if not text:
        return np.zeros(0, np.int64)
    if len(text) < N:
        text += "  "
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes) - N + 1
    h = np.full(n, OFFSET, np.uint64)
    for j in range(N):
        h = ((h ^ codes[j : j + n]) * np.uint64(PRIME)) & np.uint64(MASK)
    return (h % np.uint64(dim)).astype(np.int64)


def counts(text: str | None, dim: int = DIM) -> np.ndarray:
    return np.bincount(buckets(text, dim), minlength=dim)
