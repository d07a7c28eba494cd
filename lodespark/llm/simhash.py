"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits that differ in 2 bits or fewer are linked. Cut into two
halves, one of them differs in at most one bit. So each half gives one variant a
bit with that bit struck out, and two linked fingerprints share a variant of one
half. Buckets of equal variants are compared in runs of a sorted partition. A
bucket of more than ``cap`` fingerprints is not compared but cut again: of its
other half, one quarter differs in at most one bit, and so on; the third cut
leaves 8 free bits, so at most some 2,000 fingerprints, by arithmetic. Nothing is
dropped and no task compares an unbounded bucket.

Equal fingerprints are one node from the start, however many rows have them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components
from .shared import lookup, materialize

SEED, SHINGLE, BITS = 42, 3, 2
CAP = 2048
#: Bits of the two parts that the first, second and third cut make of what is still free.
PARTS = (32, 16, 8)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text; 0 where it has no words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change and only \x20 \x09-\x0D separate
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(size, len(words))
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])[: len(words) - size + 1]
    counts, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 1 << 16):
        some = zip(starts[at : at + (1 << 16)].tolist(), ends[size - 1 :][at : at + (1 << 16)].tolist(), strict=True)
        hashes = np.fromiter([xxh64_intdigest(joined[s:e], SEED) for s, e in some], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE) -> DataFrame:
    """(id, print) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made.view(np.int64))], ["id", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, print bigint")


def variants(rows: DataFrame, cut: int) -> DataFrame:
    """(k, m, print): the one-bit variants of both parts of a cut, each a bucket.

    k packs the struck bit and the rest of its part: 6 + 32 bits after the first cut,
    5 + 16 more after the second; the third cut's 4 + 8 bits are in m."""
    width = PARTS[cut]
    places = F.array(*[F.lit(i) for i in range(2 * width)])
    out = rows.select("*", F.explode(places).alias("bit"))
    if cut == 0:
        free = "0"
    elif cut == 1:  # the half that the first cut did not strike
        free = "if(shiftright(k, 32) >= 32, 0, 32)"
    else:  # and of that the quarter that the second did not strike
        free = "if(shiftright(k, 53) >= 32, 0, 32) + if(pmod(shiftright(k, 16), 32) >= 16, 0, 16)"
    low = f"({free} + if(bit >= {width}, {width}, 0))"
    part = f"shiftrightunsigned(print, {low}) & {(1 << width) - 1}L"
    kept = f"(({part}) & ~shiftleft(1L, bit % {width}))"
    if cut < 2:
        before = "k" if cut else "0L"
        return out.selectExpr(f"shiftleft(shiftleft({before}, {5 if cut else 6}) | bit, {width}) | {kept} as k", "0 as m", "print")
    return out.selectExpr("k", f"cast(shiftleft(bit, {width}) | {kept} as int) as m", "print")


def compared(rows: DataFrame, cut: int, bits: int, cap: int) -> DataFrame:
    """(a, b, k): links (k null) of buckets of up to ``cap``, and the members a of larger ones, for the next cut."""

    def pairs(k: np.ndarray, m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at, step = np.arange(len(x)), 1
        while len(at := at[at + step < len(x)]):
            at = at[(k[at] == k[at + step]) & (m[at] == m[at + step])]
            differ = x[at] ^ x[at + step]
            near = np.bitwise_count(differ) <= bits
            if cut == 0:  # halves that are equal are compared in one of their 32 buckets only
                bit = (k[at] >> 32).astype(np.uint64)
                near &= (bit % np.uint64(32) == 0) | (differ >> bit & np.uint64(1) == 1)
            found_a.append(at[near])
            found_b.append(at[near] + step)
            step += 1
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        return (a, b) if len(a) <= 2 * len(x) else forest(a, b)

    def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links that connect what a and b connect, fewer than there are rows."""
        up: dict[int, int] = {}

        def top(i: int) -> int:
            while (j := up.get(i, i)) != i:
                up[i] = up.get(j, j)
                i = j
            return i

        keep = []
        for n, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            i, j = top(i), top(j)
            if i != j:
                up[max(i, j)] = min(i, j)
                keep.append(n)
        return a[keep], b[keep]

    def out(k, a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), b, k], ["a", "b", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = m = np.zeros(0, np.int64)
        x = np.zeros(0, np.uint64)
        hot = None
        for batch in batches:
            k = np.concatenate([k, np.asarray(batch.column("k"), np.int64)])
            m = np.concatenate([m, np.asarray(batch.column("m"), np.int64)])
            x = np.concatenate([x, np.asarray(batch.column("print"), np.int64).view(np.uint64)])
            yield from step(k, m, x, False, state := {"hot": hot})
            hot, k, m, x = state["hot"], state["k"], state["m"], state["x"]
        if len(k):
            yield from step(k, m, x, True, {"hot": hot})

    def step(k, m, x, last, state):
        """Compare the runs that are complete; a run that goes on stays, or if it is too long already is known as hot."""
        starts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])) if len(k) else np.zeros(0, np.int64)
        lengths = np.diff(np.append(starts, len(k)))
        large = lengths > cap
        if len(starts) and state["hot"] == (k[0], m[0]):
            large[0] = True
        state["hot"] = (k[-1], m[-1]) if len(starts) and large[-1] else None
        stay = len(k) if last or not len(starts) or large[-1] else int(starts[-1])
        big = np.repeat(large, lengths)
        state |= {"k": k[stay:], "m": m[stay:], "x": x[stay:]}
        k, m, x, big = k[:stay], m[:stay], x[:stay], big[:stay]
        if big.any():
            yield out(pa.array(k[big]), x[big], pa.nulls(int(big.sum()), pa.int64()))
            k, m, x = k[~big], m[~big], x[~big]
        a, b = pairs(k, m, x)
        if len(a):
            yield out(pa.nulls(len(a), pa.int64()), x[a], pa.array(x[b].view(np.int64)))

    return rows.repartition("k", "m").sortWithinPartitions("k", "m", "print").mapInArrow(run, "a bigint, b bigint, k bigint")


def links(prints: DataFrame, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints that chains of ``bits`` or fewer differing bits connect.

    prints: distinct non-null fingerprints in a column print."""
    if bits > 2:
        raise ValueError("two parts have one that differs in at most one bit only for up to 2 bits")
    found, rows = None, prints.select("print")
    for cut in range(3):
        made = materialize(compared(variants(rows, cut), cut, bits, cap if cut < 2 else 1 << 62), f"compared-{cut}")
        own = made.where("k is null").select("a", "b")
        found = own if found is None else found.unionByName(own)
        rows = made.where("k is not null").select("k", F.lit(0).alias("m"), F.col("a").alias("print"))
        if rows.isEmpty():
            break
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bits: int = BITS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id (smallest id that links reach).

    Null and empty texts have fingerprint zero and link like any other. Rows that
    repeat are one node with their first; null ids never name a component unless
    nothing else is there. Other columns are ignored, whatever their names."""
    base = materialize(fingerprints(docs, id_col, text_col, size), "fingerprints")
    nodes = materialize(base.groupBy("print").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    linked = components(links(nodes, bits, cap))
    inner = nodes.join(linked.withColumnRenamed("node", "print"), "print")
    # a root has no row of its own in linked
    roots = linked.select(F.col("root").alias("print")).distinct()
    members = materialize(inner.unionByName(nodes.join(roots, "print").withColumn("root", F.col("print"))), "members")
    names = members.groupBy("root").agg(F.min("first").alias("name"), F.count(F.lit(1)).alias("w"))
    named = lookup(members, names, "root", "w").select("print", "name")
    named = materialize(nodes.join(named, "print", "left").select("print", "n", F.coalesce("name", "first").alias("component_id")), "named")
    out = lookup(base, named, "print", "n")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_simhash_near_dedup": op6_simhash_near_dedup}
ORACLE: dict[str, str] = {}
