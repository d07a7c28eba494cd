"""Benchmark decontamination by winnowing.

Of every ``span`` consecutive words, the smallest hash of ``span - width + 1``
consecutive words in a window of ``width`` such k-grams is a fingerprint. A window
of the same words picks the same k-gram in a document and in a test item, so each
shared span of ``span`` words or more has a fingerprint in common. Fingerprints
are joined and each hit is extended word by word, by comparison of the words
themselves; runs of ``span`` equal words count. Items of fewer words are looked
for whole, through k-grams of just their length.

A bit map over the hashes of the items' windows, of fixed size however many items
there are, lets a document give up only fingerprints of windows that items
probably have, so nearly nothing is joined for clean text; it never hides a hit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bit_map, materialize, slices
from .words import grams, whole, winnow, words_of

SPAN, WIDTH = 10, 6
MAP_BITS = 24
#: Fingerprints of items up to this many rows (some 200 bytes each) are broadcast; more are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16

HITS = "array<struct<size:int,print:bigint,left:int,at:int,words:string>>"


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def prints(w, spans: list[int], span: int, width: int, marked: np.ndarray | None, bits: int) -> list[list[tuple]]:
    """Per text, its fingerprints with the words around them: (size, hash, words before it, place, words).

    spans: the lengths of short items, looked for whole. marked: the bit map, or None to keep all."""
    out: list[list[tuple]] = [[] for _ in range(len(w.first) - 1)]
    seen = (lambda h: marked[h >> np.uint64(64 - bits)]) if marked is not None else (lambda h: np.ones(len(h), bool))
    k = span - width + 1
    keep = whole(w, span)
    keep = keep & seen(grams(w, span)) if len(keep) else keep
    if keep.any():
        hashes = grams(w, k)
        window, place = winnow(hashes, width)
        place = np.unique(place[keep[window]])
        for p, h in zip(place.tolist(), signed(hashes[place]).tolist(), strict=True):
            d = int(w.doc[p])
            a, b = max(int(w.first[d]), p - width + 1), min(int(w.first[d + 1]), p + span)
            out[d].append((k, h, p - a, a - int(w.first[d]), w.text(a, b)))
    for n in spans:
        keep = whole(w, n)
        if len(keep):
            hashes = grams(w, n)
            for p in np.flatnonzero(keep & seen(hashes)).tolist():
                out[int(w.doc[p])].append((n, int(signed(hashes[p : p + 1])[0]), 0, p - int(w.first[w.doc[p]]), w.text(p, p + n)))
    return out


def item_prints(items: DataFrame, span: int, width: int) -> DataFrame:
    """Per item: its fingerprints and the hashes of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                sizes = np.diff(w.first)
                found, windows = [], []
                for d, n in enumerate(sizes.tolist()):
                    one = words_of(part.column("text").slice(d, 1))
                    short = [n] if 0 < n < span else []
                    found.append([dict(zip(("size", "print", "left", "at", "words"), x, strict=True)) for x in prints(one, short, span, width, None, 0)[0]])
                    windows.append(signed(grams(one, min(n, span))).tolist() if n else [])
                yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(np.where(sizes < span, sizes, 0), pa.int32()), pa.array(found, HIT_TYPE), pa.array(windows, pa.list_(pa.int64()))], ["item", "short", "found", "windows"])

    return items.mapInArrow(run, f"item string, short int, found {HITS}, windows array<bigint>")


HIT_TYPE = pa.list_(pa.struct([("size", pa.int32()), ("print", pa.int64()), ("left", pa.int32()), ("at", pa.int32()), ("words", pa.string())]))


def extended(size, left, mine, left_there, theirs, span: int) -> np.ndarray:
    """Per pair of fingerprints: words before and after the fingerprint's start that agree, as (from, to) in the document's words; empty where too short."""
    out = []
    for k, a, x, b, y in zip(size, left, mine, left_there, theirs, strict=True):
        x, y = x.split(" "), y.split(" ")
        need = span if len(y) > k else k  # an item of less than a whole span comes as just its words
        i = 0
        while i < min(a, b) and x[a - 1 - i] == y[b - 1 - i]:
            i += 1
        j = 0
        while j < min(len(x) - a, len(y) - b) and x[a + j] == y[b + j]:
            j += 1
        out.append((a - i, a + j) if j >= k and i + j >= need else (0, 0))
    return np.array(out, np.int64).reshape(-1, 2)


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, width: int = WIDTH, bits: int = MAP_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_hit, items (sorted ids, as strings), spans (of hit words).

    Null texts and texts without words have no words and are never hit; such items
    are never found. Rows with the same id and text are each returned, with equal
    results. Extra columns are ignored, whatever their names. No items: nothing is hit."""
    spark = docs.sparkSession
    k = span - width + 1
    if not 1 <= k <= span:
        raise ValueError("width must be between 1 and span")
    there = materialize(item_prints(items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text")).where("item is not null"), span, width), "benchmark-prints")
    shorts = sorted(r[0] for r in there.where("short > 0").select("short").distinct().collect())  # fewer than span numbers
    marked = spark.sparkContext.broadcast(bit_map(there.select(F.explode("windows").alias("h")), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = words_of(part.column("text"))
                found = prints(w, shorts, span, width, marked.value, bits)
                rows = [[dict(zip(("size", "print", "left", "at", "words"), x, strict=True)) for x in d] or None for d in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("hash"), pa.array(np.diff(w.first), pa.int64()), pa.array(rows, HIT_TYPE)], ["id", "hash", "n_words", "found"])

    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    base = materialize(base.mapInArrow(run, f"id {kind}, hash bigint, n_words bigint, found {HITS}"), "document-prints")

    mine = base.where("found is not null").select("id", "hash", F.explode("found").alias("m")).select("id", "hash", "m.*")
    theirs = there.select("item", F.explode("found").alias("m")).select("item", "m.*")
    theirs = theirs.groupBy("size", "print", F.col("left").alias("left_there"), F.col("words").alias("theirs")).agg(F.collect_set("item").alias("items"))
    if (there.select(F.sum(F.size("found"))).first()[0] or 0) <= broadcast_rows:
        pairs = mine.join(F.broadcast(theirs), ["size", "print"])
    else:
        salted = theirs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = mine.withColumn("salt", F.pmod(F.xxhash64("id", "hash", "at"), F.lit(SALTS)).cast("int")).join(salted, ["size", "print", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            run = extended(c["size"].to_pylist(), c["left"].to_pylist(), c["words"].to_pylist(), c["left_there"].to_pylist(), c["theirs"].to_pylist(), span)
            keep = run[:, 1] > run[:, 0]
            at = np.asarray(c["at"], dtype=np.int64)
            rows = pa.RecordBatch.from_arrays([c["id"], c["hash"], c["items"], pa.array(at + run[:, 0]), pa.array(at + run[:, 1])], ["id", "hash", "items", "a", "b"])
            yield rows.filter(pa.array(keep))

    runs = pairs.mapInArrow(compare, f"id {kind}, hash bigint, items array<string>, a bigint, b bigint")
    hits = runs.groupBy("id", "hash").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    # the spans in order: each adds the words that lie beyond all before it
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end")), lambda x, y: F.struct((x["n"] + F.greatest(F.lit(0).cast("bigint"), y["b"] - F.greatest(x["end"], y["a"]))).alias("n"), F.greatest(x["end"], y["b"]).alias("end")), lambda x: x["n"])
    hits = hits.select(F.col("id").alias("__i"), F.col("hash").alias("__h"), "spans", "items", covered.alias("n_hit"))
    out = base.select("id", "hash", "n_words").join(hits, F.col("id").eqNullSafe(F.col("__i")) & (F.col("hash") == F.col("__h")), "left")
    return out.select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast("array<struct<a:bigint,b:bigint>>")).alias("spans"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
UPPER, WORD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SQL = f"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from documents),
iw as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') as w from benchmark),
ix as (select item, w, least(len(w), {SPAN}) as n from iw where len(w) > 0),
sizes as (select distinct n from ix),
iwin as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as g from (select item, w, n, unnest(range(1, len(w) - n + 2)) as i from ix)),
dwin as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from dw, sizes where len(w) >= n)),
hits as (select d.doc_id, d.i, d.n, t.item from dwin d join iwin t on d.n = t.n and d.g = t.g),
places as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from hits)) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct doc_id, item from hits) group by doc_id)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join places using (doc_id) left join items using (doc_id)
"""
ORACLE = {"op2_benchmark_decontamination": SQL}
