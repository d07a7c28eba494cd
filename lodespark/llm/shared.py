"""Tables in the shared folder, skew-safe lookups and Arrow batch slicing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import delete, kept_tables, materialize, temporary_tables  # noqa: F401 - for the operators and the pipeline

#: A key is hot when it has more than 1/HOT_SHARE of all rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a table made by :func:`materialize` that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it unlike all columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, hashed: bool = False) -> DataFrame:
    """Left join on ``key`` that stays even when one key holds a third of ``left``.

    ``right`` has each key once, ``weight`` being the number of rows of ``left``
    with it. Keys above 1/HOT_SHARE of the weight are fewer than HOT_SHARE by
    arithmetic, so that part is broadcast; all other keys are shuffled. Both
    inputs should be tables or cheap scans, as they are read twice. Rows with a
    null key come back unmatched. ``hashed``: a partition of ``right`` is held as a hash map,
    so that neither side is sorted; its rows must be small."""
    total = right.agg(F.sum(weight)).first()[0] or 0
    cut = max(total // HOT_SHARE, 100)
    hot = F.broadcast(right.where(F.col(weight) > cut))
    held = (lambda x: x.hint("shuffle_hash")) if hashed else (lambda x: x)
    cold = held(right.where(F.col(weight) <= cut))
    if total <= cut or hot.isEmpty():
        return left.join(held(right), key, "left")
    first = left.join(hot, key)
    rest = left.join(hot.select(key), key, "left_anti").join(cold, key, "left")
    return first.unionByName(rest)


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 19):
    """Runs of rows of a batch with at most ``most`` bytes of text, or one row."""
    text = batch.column(column)
    text = pa.array(text.to_pylist(), pa.large_string()) if not (pa.types.is_string(text.type) or pa.types.is_large_string(text.type)) else text
    lengths = np.asarray(pc.fill_null(pc.binary_length(text), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """A mark for each first ``bits`` bits that some hash in column h has: 2^bits of them, whatever the number of hashes."""
    words = hashes.selectExpr(f"shiftrightunsigned(h, {64 - bits}) as place").selectExpr("cast(shiftright(place, 6) as int) as i", "shiftleft(1L, cast(pmod(place, 64) as int)) as b")
    marked = np.zeros(1 << bits, bool)
    for i, b in words.groupBy("i").agg(F.bit_or("b").alias("b")).collect():  # at most 2^bits / 64 rows
        marked[i * 64 : i * 64 + 64] = np.unpackbits(np.array([b], np.int64).view(np.uint8), bitorder="little")
    return marked


#: Lengths of a bit map, as powers of 2: from 8 KB to 8 MB.
LEAST_BITS, MOST_BITS = 16, 26


def bit_words(hashes: DataFrame, bits: int | None = None) -> np.ndarray:
    """A bit map over the first bits of the hashes in column h, packed into words: 64 bits a hash or more, as far as MOST_BITS goes.

    Beyond that it fills up and passes over less, and is never wrong. ``hashes`` is read twice unless ``bits`` is given."""
    bits = bits or min(max(LEAST_BITS, (64 * hashes.count()).bit_length()), MOST_BITS)
    place = hashes.selectExpr(f"shiftrightunsigned(h, {64 - bits}) as place")
    word = place.selectExpr("cast(shiftright(place, 6) as int) as i", "shiftleft(1L, cast(pmod(place, 64) as int)) as b")
    out = np.zeros(max(1, (1 << bits) >> 6), np.uint64)
    found = word.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()  # at most 2^MOST_BITS / 64 rows of 12 bytes
    out[np.asarray(found.column("i"))] = np.asarray(found.column("b"), np.int64).view(np.uint64)
    return out


def marked(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes :func:`bit_words` has a bit for."""
    bits = len(words).bit_length() + 5
    place = h >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
