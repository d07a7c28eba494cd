"""Words of many texts at once, as arrays over the bytes of an Arrow column.

A word is a run of bytes of a class; the classes used here keep every byte of a
multi-byte UTF-8 character together, so byte runs are character runs."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of the words of the benchmark contract: digits, a-z and all of UTF-8's multi-byte characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


#: Bytes that prefix sums run over at once. Each worker keeps 16 bytes of powers for each of them, and sums that fit a core's cache are made faster.
BLOCK = 1 << 16


@lru_cache(maxsize=1)
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to BLOCK."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    first, second = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(BLOCK, b, np.uint64)])) for b in (BASE, inverse))
    return first, second


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of bytes data[start:end], by prefix sums over blocks; runs are ascending and don't overlap."""
    up, down = powers()
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        base = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        if end[i] - base > BLOCK:  # one run of several blocks
            total = 0
            for at in range(base, int(end[i]), BLOCK):
                part = data[at : min(at + BLOCK, int(end[i]))]
                total += int(((part + np.uint64(1)) * up[: len(part)]).sum(dtype=np.uint64)) * pow(int(BASE), at - base, 1 << 64)
            out[i], j = np.uint64(total % (1 << 64)), i + 1
        else:
            part = data[base : int(end[j - 1])].astype(np.uint64)
            part += np.uint64(1)
            part *= up[: len(part)]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part, out=sums[1:])
            a, b = start[i:j] - base, end[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


@dataclass
class Words:
    data: np.ndarray  # lower-cased bytes
    doc: np.ndarray  # text that a word belongs to
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # number of words before each text, and of all

    def text(self, i: int, j: int) -> str:
        """Words i to j, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True)).decode()


def byte_view(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, null counting as empty, and where each text starts (and the end)."""
    texts = pc.fill_null(texts, "")
    lengths = np.asarray(pc.binary_length(texts), dtype=np.int64)
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])
    joined = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2], np.uint8) if joined.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], ends


def words_of(texts: pa.Array, member: np.ndarray = ALNUM) -> Words:
    data, ends = byte_view(texts)
    data = LOWER[data]
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = member[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[ends] = False  # a text begins
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[ends[1:] - 1] = False  # a text ends; the last slot stands for the empty first text
    end = np.flatnonzero(inside & ~after) + 1
    value = run_hashes(data, start, end)
    first = np.searchsorted(start, ends)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(data, doc, start, end, value, first)


def grams(w: Words, k: int) -> np.ndarray:
    """Hash of the k words from each word on; only meaningful where :func:`whole` holds."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total * BASE) + w.hash[j : j + n]
    return mix(total + np.uint64(k))


def whole(w: Words, k: int) -> np.ndarray:
    """Where the k words from a word on are of one text."""
    n = len(w.hash) - k + 1
    return w.doc[:n] == w.doc[k - 1 : k - 1 + n] if n > 0 else np.zeros(0, bool)


def winnow(hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of hashes, the place of its smallest one, the rightmost of equal ones."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        other = hashes[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = j
    return np.arange(n), np.arange(n) + at
