"""The word tokens of many texts at once, as arrays over the bytes of an Arrow column.

They are those of :func:`text.word_list`. Bytes decide alone which characters are in words, so that none
is decoded, and a token is looked up by its bytes, so that none becomes an object."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits and lower-case letters of ASCII.
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = True
#: The first bytes of a number that holds 0 to 8 bytes, the first one lowest.
FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
WIDE = 16


def _hangul(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where a Hangul syllable, U+AC00 to U+D7A3, begins; it has three bytes, all of one text. data: with two bytes or more after the last text."""
    at = np.flatnonzero((data[:-2] >= 0xEA) & (data[:-2] <= 0xED))
    a, b, c = (data[at + i].astype(np.int64) for i in range(3))
    code = (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F
    at = at[(b >> 6 == 2) & (c >> 6 == 2) & (code >= 0xAC00) & (code <= 0xD7A3)]
    end = np.searchsorted(ends, at, "right")
    return at[at + 3 <= ends[end]]


class Words:
    """Words of a column of texts in UTF-8: where each starts and ends among the bytes, and how many words are before each text and in all."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        n = int(offsets[-1] - offsets[0])
        self.data = np.zeros(n + WIDE + 8, np.uint8)
        if n:
            self.data[:n] = LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]]
        ends = offsets - offsets[0]
        inside = PLAIN[self.data[: n + 1]]
        for i in range(3) if n and self.data.max() >= 0xEA and len(at := _hangul(self.data[: n + 2], ends)) else ():
            inside[at + i] = True
        edge = np.ones(n + 1, bool)  # where a byte is of another kind than the one before, or of another text
        edge[1:] = inside[1:] != inside[:-1]
        starts = edge & inside
        starts[ends] = inside[ends]
        stops = edge & ~inside
        stops[ends] = inside[ends - 1]  # of the first text no stop is read
        self.start, self.end = np.flatnonzero(starts), np.flatnonzero(stops[1:]) + 1
        self.first = np.searchsorted(self.start, ends)


class Vocabulary:
    """Places of different tokens. One of up to WIDE bytes is two numbers, found in a table by a hash of these; longer ones are compared as bytes."""

    def __init__(self, tokens: list[str]):
        own = [t.encode() for t in tokens]
        short = [i for i, t in enumerate(own) if len(t) <= WIDE]
        self.long = {t: i for i, t in enumerate(own) if len(t) > WIDE}
        self.begun = np.unique(np.array([int.from_bytes(t[:8], "little") for t in self.long], np.uint64))
        self.place = np.array(short, np.int64)
        self.keys = np.array([[int.from_bytes(own[i][:8], "little"), int.from_bytes(own[i][8:], "little")] for i in short], np.uint64).reshape(-1, 2).T.copy()
        self.bits = max(10, (4 * len(short)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int64)
        for i, at in enumerate(self._slot(*self.keys).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % len(self.slots)
            self.slots[at] = i

    def _slot(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        mixed = (one ^ (two * np.uint64(0xC4CEB9FE1A85EC53))) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def places(self, w: Words) -> np.ndarray:
        """The place of each word, -1 for one that is not here."""
        size, out = w.end - w.start, np.full(len(w.start), -1, np.int64)
        eight = np.ndarray(len(w.data) - 7, "<u8", w.data, strides=(1,))  # the eight bytes from each byte on
        one = eight[w.start] & FIRST[np.minimum(size, 8)]
        two = eight[np.minimum(w.start + 8, len(eight) - 1)] & FIRST[np.clip(size - 8, 0, 8)]
        left, at = np.arange(len(out)), self._slot(one, two)
        while len(left) and len(self.place):
            i = self.slots[at]
            same = (i >= 0) & (self.keys[0][i] == one[left]) & (self.keys[1][i] == two[left])
            out[left[same]] = self.place[i[same]]
            on = (i >= 0) & ~same
            left, at = left[on], (at[on] + 1) % len(self.slots)
        out[size > WIDE] = -1
        for i in np.flatnonzero((size > WIDE) & np.isin(one, self.begun)).tolist() if self.long else ():
            out[i] = self.long.get(w.data[w.start[i] : w.end[i]].tobytes(), -1)
        return out
