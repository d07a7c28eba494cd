"""Dense search: hashed trigram vectors or given ones, brute force over blocks.

Queries that fit one matrix of bounded size are sent to all tasks; each task multiplies
it with blocks of its documents, keeps the best k of each query and gives those up at
its end, so what is shuffled is k rows a query and task, however many documents there are.
More queries are dealt out too: a cell of a grid has a block of queries, which its
task holds as a matrix, and a part of the documents, which it reads past it. Neither
side goes through the driver then."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from ..functions import vectors as V
from .arrow import map_in_arrow
from .lexical import ranked

#: Numbers of a query matrix, whether sent to all tasks or held by one; and documents multiplied at once.
MATRIX, ROWS = 4_000_000, 512


def bucket_counts(docs: DataFrame, id_col: str, text_col: str = "text", dim: int = V.DIM) -> DataFrame:
    """(id, bucket, n) of the hashed trigrams."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [V.counts(t.as_py(), dim) for t in batch.column("text")]
            at = [np.flatnonzero(c) for c in made]
            of = pa.array(np.repeat(np.arange(len(at)), [len(x) for x in at]), pa.int64())
            flat = np.concatenate(at) if at else np.zeros(0, np.int64)
            n = np.concatenate([c[x] for c, x in zip(made, at, strict=True)]) if at else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(of), pa.array(flat, pa.int32()), pa.array(n, pa.int64())], ["id", "bucket", "n"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, bucket int, n bigint").withColumnRenamed("id", id_col)


def norms(docs: DataFrame, id_col: str, text_col: str = "text", dim: int = V.DIM) -> DataFrame:
    """(id, norm2): the squared length of each text's bucket counts, 0 for an empty text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = (V.counts(t.as_py(), dim) for t in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([int((c * c).sum()) for c in made], pa.int64())], ["id", "norm2"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, norm2 bigint").withColumnRenamed("id", id_col)


def embed(docs: DataFrame, text_col: str = "text", dim: int = V.DIM, out: str = "embedding") -> DataFrame:
    """``docs`` with the vector of unit length of each text; that of an empty text is zero."""
    keep = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                made = np.stack([V.counts(t.as_py(), dim) for t in part.column(text_at)])
                norms = np.sqrt((made * made).sum(axis=1).astype(np.float64))
                made = (made / np.where(norms == 0, 1.0, norms)[:, None]).astype(np.float32)
                ends = pa.array(np.arange(len(part) + 1) * dim, pa.int32())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], [*keep, out])

    text_at = keep.index(text_col)
    rows = docs.select(*(F.col(f"`{c}`") for c in keep))
    return map_in_arrow(rows, run, StructType([*rows.schema.fields, StructField(out, ArrayType(FloatType()))]))


class _Best:
    """The best ``k`` documents of each query so far. whole: vectors are counts, still to be divided by their lengths."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray, k: int, whole: bool):
        self.ids, self.k, self.whole = ids, k, whole
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        self.asked = matrix / np.where(lengths == 0, 1.0, lengths)[:, None] if whole else matrix
        self.top, self.at = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def add(self, ords: np.ndarray, block: np.ndarray) -> None:
        """Only similarities that reach a query's k-th best so far are sorted."""
        sims = self.asked @ block.T
        if self.whole:
            own = np.sqrt((block * block).sum(axis=1))
            sims /= np.where(own == 0, 1.0, own)[None, :]
        q, d = np.nonzero(sims >= self.top[:, -1:] - 1e-6)
        own = np.unique(q)
        of = np.concatenate([np.repeat(own, self.k), q])
        top, at = np.concatenate([self.top[own].ravel(), sims[q, d]]), np.concatenate([self.at[own].ravel(), ords[d]])
        order = np.lexsort((at, -np.round(top, 9), of))
        of, top, at = of[order], top[order], at[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        some = rank < self.k
        self.top[of[some], rank[some]], self.at[of[some], rank[some]] = top[some], at[some]

    def rows(self) -> pa.RecordBatch:
        of, col = np.nonzero(self.top > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[of]), pa.array(self.at[of, col]), pa.array(self.top[of, col])], ["qid", "ord", "score"])


FOUND = "qid bigint, ord bigint, score double"


def in_cells(docs: DataFrame, queries: DataFrame, cell: list[str], k: int, vector: Callable = np.array, whole: bool = False) -> DataFrame:
    """(qid, ord, score): in each cell, the best ``k`` of its documents for each of its queries.

    docs (cell.., ord, x), queries (cell.., qid, x). A task holds one cell's queries, and reads its documents block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best, asked, rest = None, None, [], []

        def flush() -> None:
            if rest and best is not None:
                best.add(np.array([i for i, _ in rest], np.int64), np.stack([v for _, v in rest]).astype(np.float64))
            rest.clear()

        for batch in batches:
            cells = list(zip(*(batch.column(c).to_pylist() for c in cell), strict=True))
            for at, kind, i, x in zip(cells, batch.column("kind").to_pylist(), batch.column("id").to_pylist(), batch.column("x"), strict=True):
                if at != last:
                    flush()
                    if best is not None:
                        yield best.rows()
                    last, best, asked = at, None, []
                if kind == 0:
                    asked.append((i, vector(x.as_py())))
                    continue
                if best is None and asked:
                    best, asked = _Best(np.array([q for q, _ in asked], np.int64), np.stack([v for _, v in asked]).astype(np.float64), k, whole), []
                rest.append((i, vector(x.as_py())))
                if len(rest) >= ROWS:
                    flush()
        flush()
        if best is not None:
            yield best.rows()

    rows = queries.select(*cell, F.lit(0).alias("kind"), F.col("qid").alias("id"), "x").unionByName(docs.select(*cell, F.lit(1).alias("kind"), F.col("ord").alias("id"), "x"))
    return rows.repartition(*cell).sortWithinPartitions(*cell, "kind").mapInArrow(run, FOUND)


def matrix_of(column: pa.Array, vector: Callable) -> np.ndarray:
    """The vectors of a column as a matrix; lists of numbers, all of one length, are taken from its buffer."""
    if vector is not np.array:
        return np.stack([vector(x.as_py()) for x in column]).astype(np.float64)
    lengths = pc.list_value_length(column)
    if column.null_count or len(pc.unique(lengths)) > 1 or (flat := column.flatten()).null_count:
        raise ValueError("vectors must have one length and no nulls")
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _sent(docs: DataFrame, queries: list[tuple[int, np.ndarray]], k: int, vector: Callable, whole: bool) -> DataFrame:
    """The same for a query matrix sent to all tasks."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries], np.int64), np.stack([v for _, v in queries]).astype(np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(*sent.value, k, whole)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                part = batch.slice(start, ROWS)
                best.add(np.asarray(part.column("ord"), np.int64), matrix_of(part.column("x"), vector))
        yield best.rows()

    return docs.mapInArrow(run, FOUND)


def nearest(docs: DataFrame, queries: DataFrame, k: int, width: int, vector: Callable = np.array, whole: bool = False) -> DataFrame:
    """(qid, ord, score, rank) by inner product or cosine. docs (ord, x), queries (qid, x), vectors of ``width`` numbers."""
    most = max(1, MATRIX // max(width, 1))
    some = queries.select("qid", "x").limit(most + 1).collect()  # MATRIX numbers at most
    if not some:
        return ranked(docs.sparkSession.createDataFrame([], FOUND), k)
    if len(some) <= most:
        return ranked(_sent(docs.select("ord", "x"), [(r.qid, vector(r.x)) for r in some], k, vector, whole), k)
    blocks = -(-queries.count() // most)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    at = lambda column, n: F.pmod(F.xxhash64(column), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    grid = in_cells(docs.withColumn("part", at("ord", parts)).withColumn("block", every(blocks)), queries.withColumn("block", at("qid", blocks)).withColumn("part", every(parts)), ["block", "part"], k, vector, whole)
    return ranked(grid, k)


def dense_hash(corpus: DataFrame, queries: DataFrame, k: int, dim: int = V.DIM) -> DataFrame:
    """(qid, ord, score, rank) of the ``k`` nearest documents by hashed trigrams. corpus (ord, text), queries (qid, text).

    There is no threshold; of equal similarities (to 9 digits) the smaller ord is first."""
    return nearest(corpus.select("ord", F.col("text").alias("x")), queries.select("qid", F.col("text").alias("x")), k, dim, lambda t: V.counts(t, dim), True)


def dense_vectors(corpus: DataFrame, queries: DataFrame, k: int, column: str = "embedding") -> DataFrame:
    """The same over given vectors of one length, by their inner product. corpus (ord, embedding), queries (qid, embedding)."""
    asked = queries.select("qid", F.col(column).alias("x"))
    width = asked.select(F.size("x")).limit(1).collect()
    return nearest(corpus.select("ord", F.col(column).alias("x")), asked, k, width[0][0] if width else 1)
