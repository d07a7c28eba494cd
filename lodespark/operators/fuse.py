"""Reciprocal rank fusion of any number of rankings, and hybrid search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..workspace import materialize
from .dense import dense_hash
from .lexical import bm25
from .sizes import small

RRF_K, DEPTH = 60, 4


def rrf(rankings: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, ord, score): the sum of 1 / (k + rank) over the rankings (qid, ord, rank)."""
    rows = reduce(DataFrame.unionByName, (r.select("qid", "ord", "rank") for r in rankings))
    return rows.groupBy("qid", "ord").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"))


def fused(runs: dict, k: int, mode: str = "hybrid", rrf_k: int = RRF_K, with_ranks: bool = True) -> DataFrame:
    """(qid, ord, score, dense_rank, bm25_rank, rank), the ``k`` best of each query.

    runs: a function from depth to ranking for each of dense and bm25. mode: one of
    them, or anything else for both; the score is that of rank fusion in all modes.
    Each ranking goes to DEPTH * k. Both ranks are given in all modes; without
    ``with_ranks`` a single mode runs one ranking only."""
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = [mode] if mode in runs else list(runs)
    made = {name: runs[name](DEPTH * k) for name in (runs if with_ranks else wanted)}
    rows = reduce(DataFrame.unionByName, (r.select("qid", "ord", "rank", F.lit(name).alias("ranker")) for name, r in made.items()))
    rank = lambda name: F.max(F.when(F.col("ranker") == name, F.col("rank"))).alias(f"{name}_rank")
    part = F.when(F.col("ranker").isin(wanted), F.lit(1.0) / (F.lit(rrf_k) + F.col("rank")))
    both = rows.groupBy("qid", "ord").agg(F.sum(part).alias("score"), rank("dense"), rank("bm25")).where("score is not null")
    order = Window.partitionBy("qid").orderBy(F.round("score", 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("bm25_rank").asc_nulls_last())
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 5, mode: str = "hybrid", rrf_k: int = RRF_K, dim: int = V.DIM, tokens=T.words, with_ranks: bool = True) -> DataFrame:
    """:func:`fused` over a corpus (ord, text) for queries (qid, text), without an index. An empty corpus gives no rows."""
    return fused({"dense": lambda d: dense_hash(corpus, queries, d, dim), "bm25": lambda d: bm25(corpus, queries, d, tokens=tokens)}, k, mode, rrf_k, with_ranks)


def with_payload(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Results with the other columns of the corpus, joined last, when only the best are left; few of them are sent to the corpus, which is not shuffled then."""
    return corpus.join(small(materialize(results, "best")), "ord")
