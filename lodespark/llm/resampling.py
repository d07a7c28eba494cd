"""Importance resampling towards a target distribution, over hashed word n-grams.

The words of a whole batch are found at once: every byte of the Arrow buffer is
classified by a lookup table, and a word begins or ends where the class changes.
CRC32 is a byte automaton too, so its table-driven step is taken for all n-grams
of a length at the same time: first for the first bytes of all words, then for the
second bytes of those that have one, and so on; an n-gram goes on from the state
of the one a word shorter. A bucket is a CRC modulo the number of buckets.

Both distributions are exact sums over all texts, added up per task and then by
Spark; each has at most as many rows as there are buckets, however large the
corpus is. A document's weight is the sum of its features' gains, and a Gumbel
number from a hash of its id makes the highest scores a draw without replacement."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, slices, unused
from .words import ALNUM, LOWER, Words, byte_view

BUCKETS, ORDER, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Below this many words that still go on, the bytes left of each are taken one word at a time.
FEW = 64
SPACE = np.uint8(0x20)


@lru_cache(maxsize=1)
def crc_table() -> np.ndarray:
    """The automaton's step for each byte, from the reflected polynomial of CRC32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


def boundaries(texts: pa.Array, member: np.ndarray = ALNUM) -> Words:
    """Words of all texts, without hashes: where the class of bytes changes, or a text begins or ends."""
    data, ends = byte_view(texts)
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = member[data]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    # a word that runs over the end of a text is two
    cuts = np.unique(ends[(ends > 0) & (ends < len(data))])
    cuts = cuts[(inside[cuts] & inside[cuts + 1]).astype(bool)] if len(cuts) else cuts
    start, end = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([end, cuts]))
    first = np.searchsorted(start, ends)
    return Words(data, np.repeat(np.arange(len(texts)), np.diff(first)), start, end, np.zeros(0, np.uint64), first)


def advanced(state: np.ndarray, w: Words, words: np.ndarray) -> np.ndarray:
    """The automaton's states after the bytes of a word each, taken for all words at once."""
    table, state = crc_table(), state.copy()
    start, length = w.start[words], (w.end - w.start)[words]
    longest_first = np.argsort(-length, kind="stable")
    lengths, done = length[longest_first], 0
    while len(lengths):
        go = int(np.searchsorted(-lengths, -done, "left"))  # words that have more than ``done`` bytes
        if go <= FEW:
            for i in longest_first[:go].tolist():
                rest = w.data[start[i] + done : start[i] + length[i]]
                state[i] = zlib.crc32(rest, int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        at = longest_first[:go]
        state[at] = table[(state[at] ^ w.data[start[at] + done]) & np.uint32(255)] ^ (state[at] >> np.uint32(8))
        done += 1
    return state


def features(w: Words, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams, the texts they are of and their buckets."""
    table, n = crc_table(), len(w.start)
    state = np.full(n, 0xFFFFFFFF, np.uint32)
    for length in range(1, order + 1):
        heads = np.arange(max(0, n - length + 1))
        heads = heads[w.doc[heads] == w.doc[heads + length - 1]]
        if length > 1:
            state[heads] = table[(state[heads] ^ SPACE) & np.uint32(255)] ^ (state[heads] >> np.uint32(8))
        state[heads] = advanced(state[heads], w, heads + length - 1)
        yield w.doc[heads], ((state[heads] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, repeats counted. A task gives at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for _, found in features(boundaries(part.column("text")), order, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    own = texts.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def collected(counts: DataFrame, buckets: int) -> np.ndarray:
    """At most one number a bucket."""
    out = np.zeros(buckets, np.int64)
    found = counts.toArrow()
    out[np.asarray(found.column("bucket"))] = np.asarray(found.column("n"))
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each bucket, 1000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    s, t, size = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(id, n_words, n_features, weight), one row for each row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w, size = boundaries(part.column("text")), len(part)
                count, total = np.zeros(size, np.int64), np.zeros(size, np.int64)
                for doc, found in features(w, order, buckets):
                    count += np.bincount(doc, minlength=size)
                    sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(gain[found])])  # whole numbers, so that no order of adding matters
                    first = np.searchsorted(doc, np.arange(size + 1))
                    total += sums[first[1:]] - sums[first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(w.first)), pa.array(count), pa.array(total)], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def ranked(rows: DataFrame, score: str, id_col: str, name: str) -> DataFrame:
    """``rows`` with their place by score, highest first, then by id; counted from 1.

    Rows are sorted over all partitions by both columns, so many equal scores are spread
    too; a row's place is its place in its partition after the sizes of those before."""
    (own,) = unused(rows, "place")
    parts = rows.repartitionByRange(F.col(score).desc(), F.col(id_col).asc_nulls_last())
    parts = parts.sortWithinPartitions(F.col(score).desc(), F.col(id_col).asc_nulls_last())
    placed = materialize(parts.withColumn(own, F.monotonically_increasing_id()), "ranked")
    sizes = placed.groupBy(F.shiftright(own, 33).alias("part")).count().collect()  # a row for each partition
    before, total = {}, 0
    for part, n in sorted((r["part"], r["count"]) for r in sizes):
        before[part], total = total, total + n
    if not before:
        return placed.drop(own).withColumn(name, F.lit(None).cast("bigint"))
    starts = rows.sparkSession.createDataFrame(list(before.items()), "part bigint, begin bigint")
    joined = placed.join(F.broadcast(starts), F.shiftright(own, 33) == starts["part"])
    return joined.withColumn(name, (F.col("begin") + F.expr(f"{own} & {(1 << 33) - 1}L") + 1).cast("bigint")).drop("part", "begin", own)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score and rank, null for rows that are not drawn.

    Of the rows with at least ``least_words`` words, ``percent`` in a hundred (rounded down) are
    drawn, highest scores first, ties to the smaller id. Null and empty texts have no features
    and weight 0. Rows that share an id share their random number too, and each may be drawn;
    a null id counts as an empty one in that number and comes last among ties. An empty target or
    corpus leaves just the smoothing. Other columns are ignored, whatever their names."""
    gain = gains(collected(bucket_counts(docs, text_col, order, buckets), buckets), collected(bucket_counts(target, target_col, order, buckets), buckets))
    rows = weights(docs, gain, id_col, text_col, order)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    rows = materialize(rows.withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))), "weights")
    asked = rows.where(F.col("n_words") >= least_words)
    drawn = asked.count() * percent // 100
    placed = ranked(asked, "score", "id", "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    out = placed.unionByName(rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, with all their columns."""
    drawn = resample(docs, target, id_col, **options).where("rank is not null").select(F.col(id_col))
    return docs.join(drawn.distinct(), id_col, "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: The automaton's step for each byte, from the polynomial: step and automaton(t).
CRC_SQL = """step(b, k, v) AS (
  SELECT b, 0, b::BIGINT FROM range(256) t(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8
),
automaton AS (SELECT list(v ORDER BY b) AS t FROM step WHERE k = 8)"""

#: CRC32 of each distinct word by folding the step over its bytes.
SQL = rf"""
WITH RECURSIVE {CRC_SQL},
doc_words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
),
item_words AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM item_words)),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                            lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM vocabulary, automaton
),
dn AS (SELECT bucket, count(*)::DOUBLE AS n FROM doc_words JOIN bucketed USING (w) GROUP BY bucket),
tn AS (SELECT bucket, count(*)::DOUBLE AS n FROM item_words JOIN bucketed USING (w) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(n), 0) FROM dn) AS s, (SELECT coalesce(sum(n), 0) FROM tn) AS t),
gain AS (
  SELECT b.bucket, floor(1000 * ln((coalesce(tn.n, 0) + 1) * (total.s + 10000) / ((coalesce(dn.n, 0) + 1) * (total.t + 10000))))::BIGINT AS g
  FROM (SELECT DISTINCT bucket FROM bucketed) b LEFT JOIN dn USING (bucket) LEFT JOIN tn USING (bucket), total
),
weighed AS (SELECT doc_id, count(*)::BIGINT AS n_features, sum(g)::BIGINT AS weight FROM doc_words JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weighed USING (doc_id)
),
placed AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END::BIGINT AS rank
FROM placed
"""

QUERIES = {"op13_importance_resampling": op13_importance_resampling}
ORACLE = {"op13_importance_resampling": SQL}
