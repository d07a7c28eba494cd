"""Retrieval quality: hit@k and mean reciprocal rank over cases with a gold text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from . import dense, fuse, lexical

CUTS, MRR_DEPTH = (1, 3, 5), 10


def first_hits(cases: DataFrame, results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(qid, rank): the first rank whose text holds the case's gold, null for a miss. cases (qid, gold), results (qid, rank, text); both and the hits may have more keys, ``by``."""
    met = cases.join(results.select(*by, "qid", "rank", "text"), [*by, "qid"], "left")
    return met.groupBy(*by, "qid").agg(F.min(F.when(F.contains("text", "gold"), F.col("rank"))).alias("rank"))


def metrics(hits: DataFrame, cuts: tuple[int, ...] = CUTS, depth: int = MRR_DEPTH, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each of the keys ``by``: n_cases, hit@k for each cut, and mrr; all cases count, misses as zero."""
    rate = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    inside = F.when(F.col("rank") <= depth, F.lit(1.0) / F.col("rank"))
    return (hits.groupBy(*by) if by else hits).agg(F.count(F.lit(1)).alias("n_cases"), *[rate(F.col("rank") <= k).alias(f"hit_{k}") for k in cuts], F.avg(F.coalesce(inside, F.lit(0.0))).alias("mrr"))


def by_mode(corpus: DataFrame, queries: DataFrame, cases: DataFrame, modes: tuple[str, ...] = ("hybrid", "dense", "bm25"), texts: DataFrame | None = None) -> DataFrame:
    """A row for each search mode with all metrics. corpus (ord, text), queries (qid, text), cases (qid, gold).
    texts: the corpus as it is stored, where ``corpus`` is dealt out anew.

    Each ranking is made once, whatever modes it serves, and texts are read once, for the best of all modes."""
    runs = {"dense": lambda d: dense.dense_hash(corpus, queries, d), "bm25": lambda d: lexical.bm25(corpus, queries, d)}
    used = [name for name in runs if set(modes) - (set(runs) - {name})]
    made = {name: materialize(runs[name](fuse.DEPTH * MRR_DEPTH), f"{name}-ranking") for name in used}
    best = [fuse.fused({name: lambda d, name=name: made[name] for name in runs}, MRR_DEPTH, m, with_ranks=False).select(F.lit(m).alias("mode"), "qid", "ord", "rank") for m in modes]
    found = fuse.with_payload(reduce(DataFrame.unionByName, best), corpus if texts is None else texts)
    every = cases.crossJoin(F.broadcast(cases.sparkSession.createDataFrame([(m,) for m in modes], "mode string")))
    return metrics(first_hits(every, found, ("mode",)), by=("mode",))


def table(rows: list[dict], columns: list[str]) -> str:
    """A markdown table of a few result rows; - for what is missing."""
    cell = lambda v: "-" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [columns, ["---"] * len(columns), *[[cell(r.get(c)) for c in columns] for r in rows]]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)
