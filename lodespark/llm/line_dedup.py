"""Line dedup by content-defined chunks of lines.

A line ends at a line break; a line of several sentences, as a paragraph of prose is,
is folded after each ASCII . ! or ? that ends a word. A rolling hash over the hashes
of two neighbouring lines is taken after each line; where it is a local maximum, a
chunk ends. That depends on the lines around only, so equal passages are cut alike
wherever they stand. Chunks that occur again, by comparison of their bytes, are removed
where neighbouring ones together have two lines and ``MIN_WORDS`` words or more: the
occurrence in the document with the smallest id stays, the first one there.

A block of a few lines may hold no whole chunk. So each line also begins a finest chunk, of as few
lines, two at least, as have MIN_WORDS words. Those that occur again outside of what goes with larger
chunks are compared word by word with their first occurrence, and to the right as far
as whole lines agree. As any repeated block is made up of them, none of two lines
and more is missed.

Equal passages may begin or end within a line, and one very long line is never cut.
So passages of ``PASSAGE`` words and more go too, wherever they begin: seeds are the
smallest hashes of ``SEED_WORDS`` words in each window of ``SEED_WINDOW``, so that each
such passage has one at the same place. A seed that occurs again is compared word by
word, to either side, with the first occurrence, and what agrees goes if it has PASSAGE
words. Seeds within text that goes with its chunks anyway are not compared."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.arrow import map_in_arrow
from ..operators.sizes import small
from .shared import bit_words, lookup, marked, materialize, slices, unused
from .words import BASE, byte_view, mix, run_hashes

#: What neighbouring chunks have at least to be removed: shorter ones may be equal by chance.
MIN_WORDS, MIN_LINES = 8, 2
#: A cut is the largest of so many rolling hashes to either side.
RADIUS = 1
#: Words that a passage has at least to be removed wherever lines end. Any such passage has SEED_WINDOW places where a seed may begin.
PASSAGE, SEED_WORDS = 51, 26
SEED_WINDOW = PASSAGE - SEED_WORDS + 1
#: Words to either side that a seed is compared in: what agrees beyond has seeds of its own.
AROUND = PASSAGE - 1
#: Neighbouring seeds are compared together, in stretches that end at one seed in so many and after so many.
STRETCH_EVERY, STRETCH_SEEDS = 8, 32
#: Pairs of stretches that are compared at once.
COMPARED = 512
#: Words that a finest chunk of lines has at most: longer ones are passages.
LINE_WORDS = SEED_WORDS + AROUND
#: Bytes of text that are taken apart at once; arrays over them take some fifty times as much.
SLICE = 1 << 19
SENTENCE = np.zeros(256, bool)
SENTENCE[list(b".!?")] = True
#: A seed as it is packed into the bytes of a text's row: hash, stretch, word in it, first and last byte around it, words of a finest chunk.
SEED = np.dtype([("h", "<i8"), ("s", "<i4"), ("w", "<i4"), ("a", "<i4"), ("b", "<i4"), ("n", "<i4")])
PLACES = {"id": None, "key": "bigint", "a": "int", "b": "int", "lines": "int", "words": "int", "again": "boolean", "content": "binary", "digest": "binary", "seeds": "binary"}
#: Hashes are dealt out by their first HASH_BITS bits, HELD_HASHES of them at a time, packed.
HASH_BITS, HELD_HASHES = 11, 1 << 20
#: Rows of packed hashes that are held before they are put together.
HELD_ROWS = 4096


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, where each text starts and the end, start, end and hash of each word, its text, whether a line ends with it)."""
    data, ends = byte_view(texts)
    word, word_end = word_places(data, ends)
    doc_of_word = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(word, ends)))
    return data, ends, word, word_end, run_hashes(data, word, word_end), doc_of_word, line_ends(data, word, word_end, doc_of_word)


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the bytes of texts, of which each starts at one of ``ends``."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = (data != 32) & (data - np.uint8(9) > 4)
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside[:-1]
    before[ends] = False  # a text begins
    word = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside[1:]
    after[ends[1:] - 1] = False
    return word, np.flatnonzero(inside & ~after) + 1


def line_ends(data: np.ndarray, word: np.ndarray, word_end: np.ndarray, doc_of_word: np.ndarray) -> np.ndarray:
    """Whether a line ends with each word."""
    if not len(word):
        return np.zeros(0, bool)
    fold = SENTENCE[data[word_end - 1]]
    fold[np.searchsorted(word, np.flatnonzero(data == 10)) - 1] = True  # the word before the end of a line; before a text's first word, that is a word that ends a text anyway
    fold[np.append(doc_of_word[1:] != doc_of_word[:-1], True)] = True
    return fold


def chunks(found: tuple) -> dict[str, np.ndarray]:
    """The chunks of texts that :func:`split` took apart: doc, start and end byte, lines, words and hash.

    A text's chunks make it up, but a text without words has none."""
    data, ends, word, word_end, word_hash, doc_of_word, fold = found
    if not len(word):
        none = np.zeros(0, np.int64)
        return {"doc": none, "start": none, "end": none, "lines": none, "words": none, "hash": none.view(np.uint64)}
    fresh = np.concatenate([[True], doc_of_word[1:] != doc_of_word[:-1]])
    begins = np.flatnonzero(np.concatenate([[True], fold[:-1]]) | fresh)
    doc, first = doc_of_word[begins], fresh[begins]
    last = np.concatenate([first[1:], [True]])
    stops = np.append(begins[1:], len(word))
    start = np.where(first, ends[doc], word[begins])  # white space goes with the line before it, at the start of a text with the first
    stop = np.where(last, ends[doc + 1], np.roll(start, -1))
    own = run_hashes(word_hash, begins, stops)
    rolled = np.maximum(mix(own + np.where(first, np.uint64(0), np.roll(own, 1)) * np.uint64(3)), np.uint64(1))
    best, again = ~last, np.zeros(len(last), bool)
    for r in range(1, RADIUS + 1):  # larger than those before, not smaller than those behind; another text counts as zero
        behind, ahead = np.roll(rolled, r), np.roll(rolled, -r)
        behind[np.roll(doc, r) != doc], ahead[np.roll(doc, -r) != doc] = 0, 0
        behind[:r], ahead[len(ahead) - r :] = 0, 0
        best &= (rolled > behind) & (rolled >= ahead)
        again |= rolled == behind
    edge = again & ~(np.roll(again, 1) & np.roll(again, -1))  # a run of equal lines ends a chunk at its first repeat and at its last
    cut = np.flatnonzero(best | edge | last)
    lines = np.diff(np.concatenate([[-1], cut]))
    from_word, to_word = begins[cut - lines + 1], stops[cut]
    return {"doc": doc[cut], "start": start[cut - lines + 1], "end": stop[cut], "lines": lines, "words": to_word - from_word, "hash": run_hashes(word_hash, from_word, to_word)}


def sliding(x: np.ndarray, width: int, best: Callable) -> np.ndarray:
    """``best`` (minimum or maximum) of each ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        x, size = best(x[:-size], x[size:]), size * 2
    return best(x[: len(x) - (width - size)], x[width - size :])


def gram_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of each ``width`` neighbours, put together from those of 1, 2, 4 and so on."""
    n, out, done, part, size = len(x) - width + 1, np.zeros(len(x) - width + 1, np.uint64), 0, x, 1
    while True:
        if width & size:
            out = out * np.uint64(pow(int(BASE), size, 1 << 64)) + part[done : done + n]
            done += size
        if done == width:
            return mix(out)
        part, size = part[:-size] * np.uint64(pow(int(BASE), size, 1 << 64)) + part[size:], size * 2


def seeds(found: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the seeds of texts that :func:`split` took apart."""
    hashes, doc = found[4], found[5]
    windows = len(hashes) - PASSAGE + 1
    if windows <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.maximum(gram_hashes(hashes, SEED_WORDS), np.uint64(1))
    low = np.where(doc[:windows] == doc[len(doc) - windows :], sliding(h, SEED_WINDOW, np.minimum), np.uint64(0))  # a window is of one text
    side = np.zeros(SEED_WINDOW - 1, np.uint64)
    at = np.flatnonzero(sliding(np.concatenate([side, low, side]), SEED_WINDOW, np.maximum) == h)
    if not len(at):
        return at, h[at]
    # of a run of equal ones, as repeated words have, the first and last of each stretch of SEED_WINDOW words are enough
    same = np.concatenate([[False], (h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] < SEED_WINDOW) & (doc[at[1:]] == doc[at[:-1]])])
    stretch = (at - np.maximum.accumulate(np.where(same, 0, at))) // SEED_WINDOW
    begins = ~same | (stretch != np.roll(stretch, 1))
    at = at[begins | np.append(begins[1:], True)]
    return at, h[at]


def line_seeds(found: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, words) of the finest chunks of lines."""
    hashes, doc = found[4], found[5]
    none = np.zeros(0, np.int64)
    if not len(hashes):
        return none, none.view(np.uint64), none
    stops = np.flatnonzero(found[6]) + 1
    begins = np.concatenate([[0], stops[:-1]])
    last = np.maximum(np.arange(len(begins)) + 1, np.searchsorted(stops, begins + MIN_WORDS))
    begins, last = begins[last < len(stops)], last[last < len(stops)]
    own = (doc[begins] == doc[stops[last] - 1]) & (stops[last] - begins <= LINE_WORDS)
    begins, ends = begins[own], stops[last[own]]
    return begins, np.maximum(run_hashes(hashes, begins, ends) ^ BASE, np.uint64(1)), ends - begins


def all_seeds(found: tuple, passages: bool, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, hash, words) of the seeds of both kinds, by place; a passage's seeds have no words of their own."""
    none = np.zeros(0, np.int64)
    at, h = seeds(found) if passages else (none, none.view(np.uint64))
    more = line_seeds(found) if lines else (none, none.view(np.uint64), none)
    at, h, n = np.concatenate([at, more[0]]), np.concatenate([h, more[1]]), np.concatenate([np.zeros(len(at), np.int64), more[2]])
    order = np.argsort(at, kind="stable")
    return at[order], h[order], n[order]


def rows_of(part: pa.RecordBatch, of: np.ndarray, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of PLACES for the rows ``of`` of a batch, with nulls for columns that are not given."""
    take = pa.array(of, pa.int64())
    types = {"a": pa.int32(), "b": pa.int32(), "lines": pa.int32(), "words": pa.int32(), "again": pa.bool_(), "content": pa.binary(), "digest": pa.binary(), "seeds": pa.binary()}
    made = {n: columns[n].cast(t) if n in columns else pa.nulls(len(take), t) for n, t in types.items()}
    return pa.RecordBatch.from_arrays([part.column("id").take(take), part.column("key").take(take), *made.values()], ["id", "key", *made])


def chunk_rows(part: pa.RecordBatch, found: tuple, known: Callable) -> pa.RecordBatch:
    """A row for each chunk whose hash is ``known``: its bytes, first and last byte in the text, lines and words, and whether the text had it before."""
    c = chunks(found)
    at = np.flatnonzero(known(c["hash"]))
    doc, raw = c["doc"][at], found[0].tobytes() if len(at) else b""
    contents, digests, again, seen, of = [], [], [], set(), -1
    for d, s, e in zip(doc.tolist(), c["start"][at].tolist(), c["end"][at].tolist(), strict=True):
        if d != of:
            seen, of = set(), d
        contents.append(raw[s:e].rstrip(b" \n"))
        again.append(contents[-1] in seen)
        seen.add(contents[-1])
        digests.append(sha256(contents[-1]).digest())
    base = found[1][doc]
    numbers = {"a": c["start"][at] - base, "b": c["end"][at] - base, "lines": c["lines"][at], "words": c["words"][at]}
    return rows_of(part, doc, **{n: pa.array(x) for n, x in numbers.items()}, again=pa.array(again, pa.bool_()), content=pa.array(contents, pa.binary()), digest=pa.array(digests, pa.binary()))


@dataclass
class Stretches:
    """The seeds with certain hashes of some texts, in stretches: hash, text, number of the stretch in all and in its text, word in
    the stretch, and first and last byte in the text of the words around each; and of each stretch its first seed, first and last byte."""

    h: np.ndarray
    doc: np.ndarray
    number: np.ndarray
    s: np.ndarray
    w: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    begins: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def stretches(found: tuple, known: Callable, kinds: tuple[bool, bool]) -> Stretches | None:
    """The seeds of these kinds (passages, lines) whose hashes are ``known``, if there are any."""
    _, ends, word, word_end, _, doc_of_word, _ = found
    at, h, n = all_seeds(found, *kinds)
    take = known(h)
    at, h, n = at[take], h[take], n[take]
    if not len(at):
        return None
    doc = doc_of_word[at]
    first = np.searchsorted(word, ends)
    low, high = first[doc], first[doc + 1]
    fresh = np.concatenate([[True], doc[1:] != doc[:-1]])
    far = np.concatenate([[True], at[1:] - at[:-1] > 2 * AROUND])
    begins = np.flatnonzero(fresh | far | (h % np.uint64(STRETCH_EVERY) == 0))
    nth = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
    begins = np.flatnonzero(nth % STRETCH_SEEDS == 0)
    stops = np.append(begins[1:], len(at)) - 1
    from_word = np.maximum(at[begins] - AROUND, low[begins])
    to_word = np.minimum(at[stops] + SEED_WORDS + AROUND, high[stops])
    number = np.repeat(np.arange(len(begins)), stops - begins + 1)
    of = np.flatnonzero(fresh)
    s = number - number[np.repeat(of, np.diff(np.append(of, len(at))))]
    base = ends[doc]
    a = word[np.where(n > 0, at, np.maximum(at - AROUND, low))] - base
    b = word_end[np.where(n > 0, at + n, np.minimum(at + SEED_WORDS + AROUND, high)) - 1] - base
    to_byte = np.where(to_word == high[stops], ends[doc[stops] + 1], word[np.minimum(to_word, len(word) - 1)])  # with the space behind, which tells whether a line ends there
    return Stretches(h, doc, number, s, at - from_word[number], a, b, n, begins, word[from_word], to_byte)


def twice_at_most(hashes: list[np.ndarray]) -> np.ndarray:
    """The hashes in order, each once or, if it occurs again, twice."""
    h = np.sort(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
    return h[np.concatenate([np.ones(min(len(h), 2), bool), h[2:] != h[:-2]])]


def dealt_hashes(hashes: list[np.ndarray]) -> pa.RecordBatch:
    """A row for each beginning of HASH_BITS bits: that, and the hashes with it, packed."""
    h = twice_at_most(hashes)
    ends = np.append(np.searchsorted(h, np.arange(1 << HASH_BITS, dtype=np.uint64) << np.uint64(64 - HASH_BITS)), len(h))
    part = np.flatnonzero(np.diff(ends))
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), packed_rows(h, np.append(ends[part], len(h)))], ["part", "h"])


def met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes that occur more than once, of rows of :func:`dealt_hashes` in order of their beginnings."""
    held, of = [], None

    def again() -> pa.RecordBatch:
        h = twice_at_most(held)
        return pa.RecordBatch.from_arrays([pa.array(h[1:][h[1:] == h[:-1]].view(np.int64))], ["h"])

    for batch in batches:
        for part, raw in zip(batch.column("part").to_pylist(), batch.column("h"), strict=True):
            if part != of or len(held) >= HELD_ROWS:
                if part != of:
                    yield again()
                    held = []
                else:
                    held = [twice_at_most(held)]
                of = part
            held.append(np.frombuffer(raw.as_buffer(), np.uint64))
    yield again()


def packed_rows(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of ``values`` between neighbouring ``ends``, a row each."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, seed) of all seeds in a column of packed ones."""
    each = np.asarray(pc.binary_length(column), np.int64) // SEED.itemsize
    return np.repeat(np.arange(len(each)), each), np.frombuffer(b"".join(column.to_pylist()), SEED)


def seed_rows(part: pa.RecordBatch, found: tuple, known: Callable, kinds: tuple[bool, bool]) -> Iterator[pa.RecordBatch]:
    """A row for each text that has such seeds, with them."""
    if x := stretches(found, known, kinds):
        packed = np.empty(len(x.h), SEED)
        for name, values in zip(SEED.names, (x.h.view(np.int64), x.s, x.w, x.a, x.b, x.n), strict=True):
            packed[name] = values
        of = np.flatnonzero(np.concatenate([[True], x.doc[1:] != x.doc[:-1]]))
        yield rows_of(part, x.doc[of], seeds=packed_rows(packed, np.append(of, len(packed))))


#: A stretch among all, as one hash: its text's key with its number over the first bits. In SQL and numpy.
STRETCH_SHIFT = 40
STRETCH_SQL = f"{{0}} ^ shiftleft(cast({{1}} as bigint), {STRETCH_SHIFT})"


def stretch_rows(part: pa.RecordBatch, found: tuple, known: Callable, kinds: tuple[bool, bool], wanted: Callable) -> Iterator[pa.RecordBatch]:
    """A row (id, key, s, a, content) for each stretch that is ``wanted``: its number and first byte in the text, and its bytes, at a text's end with a line's end."""
    if x := stretches(found, known, kinds):
        data, ends = found[0], found[1]
        keys = np.asarray(part.column("key"), np.int64)[x.doc[x.begins]] ^ (x.s[x.begins].astype(np.int64) << STRETCH_SHIFT)
        which = np.flatnonzero(wanted(keys.view(np.uint64)))
        for i in range(0, len(which), 1024):
            some = which[i : i + 1024]
            mine = x.begins[some]
            doc, take = x.doc[mine], pa.array(x.doc[mine], pa.int64())
            texts = [data[p:q].tobytes() + b"\n" * last for p, q, last in zip(x.start[some].tolist(), x.stop[some].tolist(), (x.stop[some] == ends[doc + 1]).tolist(), strict=True)]
            arrays = [part.column("id").take(take), part.column("key").take(take), pa.array(x.s[mine]).cast(pa.int32()), pa.array(x.start[some] - ends[doc]).cast(pa.int32()), pa.array(texts, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "key", "s", "a", "content"])


def alike(mine: list[bytes], theirs: list[bytes], i: int, j: int) -> int:
    """How many words agree from word i of one and j of the other on; whole runs are compared at once."""
    n, step, most = 0, 64, min(len(mine) - i, len(theirs) - j)
    while n < most and mine[i + n : i + n + step] == theirs[j + n : j + n + step]:
        n += step
    while n < most and step > 1:
        step //= 2
        if mine[i + n : i + n + step] == theirs[j + n : j + n + step]:
            n += step
    return min(n, most)


def agreeing(own: bytes, other: bytes, places: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray, least: int = PASSAGE) -> list[tuple[int, int]]:
    """Bytes of ``own``, whose words have these ``starts`` and ``ends``, that agree with ``other`` around places, as words in each; the space behind goes with them.

    A place is the first word in each, and the number of words of a finest chunk of lines, which with
    the lines after it that agree is enough, or 0: then runs of ``least`` words or more are."""
    mine, theirs, out, done, ended, back = own.split(), other.split(), [], {}, {}, []

    def ends_line(k: int) -> bool:
        return own[ends[k] - 1] in b".!?" or b"\n" in own[ends[k] : starts[k + 1] if k + 1 < len(starts) else len(own)]

    for i, j, n in sorted(places):
        if n:
            if i + n <= ended.get(i - j, 0) or mine[i : i + n] != theirs[j : j + n]:
                continue
            whole = i + n
            b = whole + alike(mine, theirs, whole, j + n)
            if b > whole:
                whole = next((x for x in range(b, whole, -1) if ends_line(x - 1)), whole)
            ended[i - j] = whole
            out.append((i, whole))
            continue
        if i < done.get(i - j, 0):
            continue
        back = back or [mine[::-1], theirs[::-1]]
        a, b = i - alike(*back, len(mine) - i, len(theirs) - j), i + alike(mine, theirs, i, j)
        done[i - j] = b
        if b - a >= least:
            out.append((a, b))
    return [(int(starts[a]), int(starts[b] if b < len(starts) else ends[-1])) for a, b in out]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans with those that touch or overlap made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_chunks(places: DataFrame, kind: str, min_words: int) -> DataFrame:
    """(id, key, gone) per text: spans of chunks that another document of smaller id, or the text itself before, has with the same bytes."""
    rows = places.where("content is not null")
    # by content: equal digests alone remove nothing
    equal = rows.groupBy("digest", "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    equal = equal.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("contents")).where("contents = 1")
    equal = materialize(equal.select("digest", "first", "n"), "repeated-chunks")
    found = lookup(rows.select("id", "key", "a", "b", "lines", "words", "again", "digest"), equal, "digest", "n", hashed=True)
    found = found.where(F.col("n").isNotNull() & (F.col("again") | ~F.col("id").eqNullSafe(F.col("first"))))
    found = found.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "b", "lines", "words"))).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, (a, b, lines, words) = list_fields(batch.column("found"), "a", "b", "lines", "words")
            if not len(of):
                continue
            # neighbours count together
            begins = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (a[1:] != b[:-1])]))
            keep = (np.add.reduceat(lines, begins) >= MIN_LINES) & (np.add.reduceat(words, begins) >= min_words)
            a, b, of = a[begins][keep], b[np.append(begins[1:], len(b)) - 1][keep], of[begins][keep]
            spans = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(batch)))])
            gone = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), gone], ["id", "key", "gone"])

    return found.mapInArrow(run, f"id {kind}, key bigint, gone array<struct<a:int,b:int>>").where("size(gone) > 0")


def list_fields(column: pa.Array, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The row of each struct in a column of lists, null counting as empty, and the fields of them all."""
    each = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(each)), each), [np.asarray(flat.field(n), np.int64) for n in names]


#: Seeds of one batch of rows, and those that a task puts in order at once.
HELD_SEEDS, SORTED_SEEDS = 1 << 16, 1 << 18
#: Types of ids that Arrow orders as Spark does.
ORDERED = ("bigint", "int", "smallint", "tinyint", "string")


@dataclass
class Places:
    """The first place of each hash among some, as (hash, key, stretch, word, how often the hash occurs), and the place's id; in order of the hash."""

    x: np.ndarray
    ids: pa.Array

    PLACE = np.dtype([("h", "<i8"), ("key", "<i8"), ("s", "<i4"), ("w", "<i4"), ("n", "<i8")])

    @classmethod
    def of(cls, many: list[Places]) -> Places:
        x, ids = np.concatenate([p.x for p in many]), pa.concat_arrays([p.ids for p in many])
        rank = pc.rank(ids, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy()
        order = np.lexsort((x["w"], x["s"], x["key"], rank, x["h"].view(np.uint64)))
        begins = np.flatnonzero(np.concatenate([np.ones(min(len(x), 1), bool), x["h"][order[1:]] != x["h"][order[:-1]]]))
        first = x[order[begins]]
        first["n"] = np.add.reduceat(x["n"][order], begins) if len(x) else 0
        return cls(first, ids.take(pa.array(order[begins])))


def first_seeds(places: DataFrame, kind: str) -> DataFrame:
    """(h, id, key, s, w, weight): the first place of each seed that occurs more than once, and how often it does.

    First is the smallest id, null last, then the place."""
    rows = places.where("seeds is not null").select("id", "key", "seeds")
    if kind not in ORDERED:
        place = F.struct(F.col("id").isNull().alias("last"), "id", "key", "s", "w")
        return every_seed(rows, kind).groupBy("h").agg(F.min(place).alias("f"), F.count(F.lit(1)).alias("weight")).where("weight > 1").select("h", "f.id", "f.key", "f.s", "f.w", "weight")

    def dealt(held: list[Places]) -> pa.RecordBatch:
        p = Places.of(held)
        ends = np.append(np.searchsorted(p.x["h"].view(np.uint64), np.arange(1 << HASH_BITS, dtype=np.uint64) << np.uint64(64 - HASH_BITS)), len(p.x))
        part = np.flatnonzero(np.diff(ends))
        ends = np.append(ends[part], len(p.x))
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), packed_rows(p.x, ends), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), p.ids)], ["part", "x", "ids"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            of, seed = unpacked(batch.column("seeds"))
            for i in range(0, len(of), HELD_SEEDS):
                row, some = of[i : i + HELD_SEEDS], seed[i : i + HELD_SEEDS]
                x = np.ones(len(row), Places.PLACE)
                x["key"] = np.asarray(batch.column("key"))[row]
                for name in ("h", "s", "w"):
                    x[name] = some[name]
                held.append(Places(x, batch.column("id").take(pa.array(row))))
                n += len(row)
                if n >= SORTED_SEEDS:
                    yield dealt(held)
                    held, n = [], 0
        if held:
            yield dealt(held)

    def again(held: list[Places]) -> pa.RecordBatch:
        p = Places.of(held)
        some = np.flatnonzero(p.x["n"] > 1)
        x = p.x[some]
        return pa.RecordBatch.from_arrays([pa.array(x["h"].copy()), p.ids.take(pa.array(some)), *(pa.array(x[n].copy()) for n in ("key", "s", "w", "n"))], ["h", "id", "key", "s", "w", "weight"])

    def all_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for batch in batches:
            for part, raw, ids in zip(batch.column("part").to_pylist(), batch.column("x"), batch.column("ids"), strict=True):
                if part != of and held:
                    yield again(held)
                    held = []
                elif len(held) >= HELD_ROWS:
                    held = [Places.of(held)]
                of = part
                held.append(Places(np.frombuffer(raw.as_buffer(), Places.PLACE), ids.values))
        if held:
            yield again(held)

    rows = rows.mapInArrow(own, f"part int, x binary, ids array<{kind}>").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(all_of_part, f"h bigint, id {kind}, key bigint, s int, w int, weight bigint")


def every_seed(rows: DataFrame, kind: str) -> DataFrame:
    """(id, key, h, s, w) of all seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x = unpacked(batch.column("seeds"))
            for i in range(0, len(of), HELD_SEEDS):
                take, some = pa.array(of[i : i + HELD_SEEDS], pa.int64()), x[i : i + HELD_SEEDS]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), *(pa.array(some[n].copy()) for n in ("h", "s", "w"))], ["id", "key", "h", "s", "w"])

    return rows.mapInArrow(run, f"id {kind}, key bigint, h bigint, s int, w int")


def open_seeds(places: DataFrame, gone: DataFrame, kind: str) -> DataFrame:
    """(id, key, s, w, h, n) of the seeds with words around them, or in their lines, that are not gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x = unpacked(batch.column("seeds"))
            row, (start, stop) = list_fields(batch.column("gone"), "a", "b")
            # the spans of a text are in order and apart; those of all texts are, as texts go into one line
            start, stop = (row << 32) + start, np.concatenate([[-1], (row << 32) + stop])
            left = np.flatnonzero(stop[np.searchsorted(start, (of << 32) + x["a"], "right")] < (of << 32) + x["b"])  # the last span that begins before ends before
            for some in (left[i : i + HELD_SEEDS] for i in range(0, len(left), HELD_SEEDS)):
                take = pa.array(of[some], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), *(pa.array(x[n][some]) for n in ("s", "w", "h", "n"))], ["id", "key", "s", "w", "h", "n"])

    rows = places.where("seeds is not null").select("id", "key", "seeds")
    gone = gone.select(F.col("id").alias("id_"), F.col("key").alias("key_"), "gone")
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left")
    return rows.select("id", "key", "seeds", "gone").mapInArrow(run, f"id {kind}, key bigint, s int, w int, h bigint, n int")


def repeated_passages(rows: DataFrame, places: DataFrame, gone: DataFrame, kind: str, known: Callable, kinds: tuple[bool, bool]) -> DataFrame:
    """(id, key, a, b) of the passages that agree with those around the first occurrence of a seed.

    First is the smallest id, null last, then the place. Rows of one id but unlike texts are not compared."""
    first = first_seeds(places, kind)
    first = materialize(first.select("h", "weight", F.struct("id", "key", "s").alias("f"), F.col("w").alias("f_w")), "first-seeds")
    some = materialize(open_seeds(places, gone, kind), "open-seeds")
    pairs = lookup(some, first, "h", "weight", hashed=True).where("weight is not null")
    same_row = F.col("id").eqNullSafe(F.col("f.id")) & (F.col("key") == F.col("f.key"))
    pairs = pairs.where(F.when(same_row, (F.col("s") != F.col("f.s")) | (F.col("w") != F.col("f_w"))).otherwise(~F.col("id").eqNullSafe(F.col("f.id"))))
    # the places in one stretch; its words are read only now, from the texts that have some such stretch
    pairs = materialize(pairs.groupBy("id", "key", "s", "f").agg(F.collect_set(F.struct("w", "f_w", "n")).alias("at")), "stretch-pairs")
    both = pairs.select("key", "s").unionByName(pairs.select("f.key", "f.s"))
    made = both.select("key", F.expr(STRETCH_SQL.format("key", "s")).alias("h")).distinct()
    made = materialize(made, "pair-keys")
    sent = rows.sparkSession.sparkContext.broadcast((bit_words(made.select(F.col("key").alias("h")).distinct()), bit_words(made.select("h"))))

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts_wanted, stretches_wanted = sent.value
            some = batch.filter(pa.array(marked(texts_wanted, np.asarray(batch.column("key"), np.int64).view(np.uint64))))
            for part in slices(some, "text", SLICE):
                yield from stretch_rows(part, split(part.column("text")), known, kinds, lambda h: marked(stretches_wanted, h))

    texts = materialize(rows.mapInArrow(cut_out, f"id {kind}, key bigint, s int, a int, content binary"), "stretches")
    weight = pairs.groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    other = texts.select(F.struct("id", "key", "s").alias("f"), F.col("content").alias("f_content")).join(weight, "f").dropDuplicates(["f"])
    both = lookup(pairs, materialize(other, "first-stretches"), "f", "n").select("id", "key", "s", "at", "f_content")
    own = texts.select(F.col("id").alias("id_"), F.col("key").alias("key_"), F.col("s").alias("s_"), "a", "content")
    both = both.join(own, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")) & (F.col("s") == F.col("s_")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (some.slice(i, COMPARED) for some in batches for i in range(0, len(some), COMPARED)):
            of, spans = [], []
            own, other, first = (batch.column(c).to_pylist() for c in ("content", "f_content", "a"))
            base = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            word, word_end = word_places(np.frombuffer(b"".join(own), np.uint8), base)
            words = np.searchsorted(word, base).tolist()
            row, fields = list_fields(batch.column("at"), "w", "f_w", "n")
            at, ends = list(zip(*(x.tolist() for x in fields), strict=True)), np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            for i, a in enumerate(first):
                mine = slice(words[i], words[i + 1])
                for x, y in agreeing(own[i], other[i], at[ends[i] : ends[i + 1]], word[mine] - base[i], word_end[mine] - base[i]):
                    of.append(i)
                    spans.append((a + x, a + y))
            take = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(take), batch.column("key").take(take), *(pa.array([x[k] for x in spans], pa.int32()) for k in (0, 1))], ["id", "key", "a", "b"])

    return both.select("id", "key", "a", "content", "f_content", "at").mapInArrow(compare, f"id {kind}, key bigint, a int, b int")


def deduplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, bits: int | None = None, passages: bool = False, lines: bool = False) -> DataFrame:
    """``docs`` with repeated chunks of lines taken out of the text, plus columns chunks_removed (spans taken out) and chars_removed.

    With ``lines``, so do repeated blocks of two lines and MIN_WORDS words or more that hold no whole chunk. With
    ``passages``, repeated passages of PASSAGE words go too, whole, wherever lines end.
    ``bits``: length of the bit map that passes over hashes that occur once; by default it
    follows their number. It decides only how much is looked at, never what goes.

    Null and empty texts stay as they are. Rows that share an id count as one document;
    what they have in common stays in each. Rows without an id come after all others, and
    count as one document likewise. All other columns stay, whatever their names, but
    chunks_removed and chars_removed are replaced. An empty table gives an empty one."""
    kind, kinds = docs.schema[id_col].dataType.simpleString(), (passages, lines)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{id_col}`", f"`{text_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = split(part.column("text"))
                more = [chunks(found)["hash"], *(seeds(found)[1:] if passages else ()), *(line_seeds(found)[1:2] if lines else ())]
                held, n = held + more, n + sum(map(len, more))
                if n >= HELD_HASHES:
                    yield dealt_hashes(held)
                    held, n = [], 0
        yield dealt_hashes(held)

    met = rows.select("text").mapInArrow(hashes, "part int, h binary").repartition("part").sortWithinPartitions("part").mapInArrow(met_again, "h bigint")
    sent = docs.sparkSession.sparkContext.broadcast(bit_words(materialize(met, "repeated-hashes"), bits))

    def known(h: np.ndarray) -> np.ndarray:
        return marked(sent.value, h)

    def found_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                found = split(part.column("text"))
                yield chunk_rows(part, found, known)
                if any(kinds):
                    yield from seed_rows(part, found, known, kinds)

    places = rows.mapInArrow(found_places, ", ".join(f"{n} {t or kind}" for n, t in PLACES.items()))
    places = materialize(places, "chunk-places")
    gone = materialize(repeated_chunks(places, kind, min_words), "gone-chunks")
    spans = gone.select("id", "key", F.explode("gone").alias("x")).select("id", "key", "x.a", "x.b")
    spans = spans.unionByName(repeated_passages(rows, places, gone, kind, known, kinds)) if any(kinds) else spans

    keep = [c for c in docs.columns if c not in ("chunks_removed", "chars_removed")]
    own_id, own_key, drops = unused(docs, "id_", "key_", "gone")
    found = spans.groupBy("id", "key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("gone")).toDF(own_id, own_key, drops)
    keyed = F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.xxhash64(f"`{id_col}`", f"`{text_col}`") == F.col(own_key))
    # texts stay where they are unless very many of them lose something
    joined = docs.select(*(f"`{c}`" for c in keep)).join(small(materialize(found, "spans")), keyed, "left").drop(own_id, own_key)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for batch in batches for part in slices(batch, text_col, SLICE)):
            lists, text = batch.column(drops), batch.column(text_col)
            counts, chars, new = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64), {}
            for i in np.flatnonzero(np.asarray(lists.is_valid())).tolist():
                whole = text[i].as_py()
                raw, cut = whole.encode(), merged([(s["a"], s["b"]) for s in lists[i].as_py()])
                ends = [0, *(b for _, b in cut)]
                new[i] = b"".join(raw[a:b] for a, b in zip(ends, [*(a for a, _ in cut), len(raw)], strict=True)).decode()
                counts[i], chars[i] = len(cut), len(whole) - len(new[i])
            if new:
                out = text.to_pylist()
                for i, t in new.items():
                    out[i] = t
                text = pa.array(out, pa.string())
            arrays = [text if c == text_col else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts), pa.array(chars)], [*keep, "chunks_removed", "chars_removed"])

    fields = [docs.schema[c] for c in keep]
    return map_in_arrow(joined, without, StructType([*fields, StructField("chunks_removed", LongType()), StructField("chars_removed", LongType())]))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passages=True, lines=True)
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select("doc_id", "chunks_removed", "chars_removed", F.length("text").cast("bigint").alias("chars_left"), digest.alias("text_sha256"))


QUERIES = {"op10_line_dedup": op10_line_dedup}
ORACLE: dict[str, str] = {}
