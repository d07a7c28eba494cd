"""Exact vector search that passes over whole clusters.

Vectors are dealt to the nearest of some centres, which are fitted on a bounded sample;
every vector is kept, and every cluster has the largest distance of a vector from its
centre, its radius. For a query q, no vector of a cluster has a larger inner product
than q.c + |q| radius. A first pass searches, for each query, the clusters with
the largest such bounds until they have k vectors; a second one those clusters
whose bound reaches the k-th best found, so the result is that of brute force."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import materialize
from . import dense
from .lexical import ranked

#: Vectors that centres are fitted on, rounds of that, and vectors of a cluster that one task reads past its queries.
SAMPLE, ROUNDS, PART = 10_000, 8, 50_000
#: Bounds are computed in another order than products, so they count as so much larger.
MARGIN = 1e-6


@dataclass
class Clusters:
    """vectors (cluster, part, ord, x); clusters (cluster, n, radius, parts); the centres, a row each."""

    vectors: DataFrame
    clusters: DataFrame
    centres: np.ndarray


def centres(sample: np.ndarray, count: int, rounds: int = ROUNDS, seed: int = 42) -> np.ndarray:
    """Centres of up to ``count`` clusters of the rows of ``sample``: spread out at first, then moved to their rows' means."""
    rnd = np.random.default_rng(seed)
    out = sample[rnd.integers(len(sample))][None, :]
    gap = ((sample - out[0]) ** 2).sum(axis=1)
    while len(out) < count and gap.sum() > 0:
        out = np.concatenate([out, sample[rnd.choice(len(sample), p=gap / gap.sum())][None, :]])
        gap = np.minimum(gap, ((sample - out[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = nearest_centre(sample, out)[0]
        sums, n = np.zeros_like(out), np.bincount(near, minlength=len(out))
        np.add.at(sums, near, sample)
        out = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], out)
    return out


def nearest_centre(rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of some points for each row, and its distance, computed anew for that pair alone."""
    near = ((points * points).sum(axis=1)[None, :] - 2 * rows @ points.T).argmin(axis=1)
    return near, np.sqrt(((rows - points[near]) ** 2).sum(axis=1))


def clustered(docs: DataFrame, count: int | None = None, column: str = "embedding", sample: int = SAMPLE, part: int = PART) -> Clusters:
    """Clusters of all vectors of ``docs`` (ord, embedding); some 2 sqrt(n) of them for n rows if ``count`` is not given, but at most a tenth of the sample."""
    rows = docs.select("ord", F.col(column).alias("x"))
    some = rows.orderBy(F.xxhash64("ord"), "ord").limit(sample).select("x").collect()
    if not some:
        empty = rows.withColumn("cluster", F.lit(0)).withColumn("part", F.lit(0))
        return Clusters(empty, docs.sparkSession.createDataFrame([], "cluster int, n bigint, radius double, parts int"), np.zeros((0, 1)))
    fitted = centres(np.array([r.x for r in some], np.float64), count or max(1, min(int(2 * rows.count() ** 0.5), sample // 10)))
    sent = docs.sparkSession.sparkContext.broadcast(fitted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), dense.ROWS):
                own = batch.slice(start, dense.ROWS)
                near, gap = nearest_centre(np.array(own.column("x").to_pylist(), np.float64).reshape(len(own), -1), sent.value)
                yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *own.columns, pa.array(gap)], ["cluster", "ord", "x", "gap"])

    dealt = materialize(rows.mapInArrow(deal, "cluster int, ord bigint, x array<float>, gap double"), "dealt-vectors")
    clusters = dealt.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")).withColumn("parts", F.ceil(F.col("n") / part).cast("int"))
    clusters = materialize(clusters, "clusters")  # a row a centre
    vectors = dealt.join(F.broadcast(clusters.select("cluster", "parts")), "cluster").withColumn("part", F.pmod(F.xxhash64("ord"), "parts").cast("int"))
    return Clusters(vectors.select("cluster", "part", "ord", "x"), clusters, fitted)


def bounded(found: Clusters, queries: DataFrame) -> DataFrame:
    """(qid, x, cluster, bound, n, parts, before): for each query all clusters, with the number of vectors in those of larger bounds."""
    facts = {r.cluster: (r.n, r.radius, r.parts) for r in found.clusters.collect()}  # a row a centre
    ids = np.array(sorted(facts), np.int64)
    n, radius, parts = (np.array([facts[i][k] for i in ids.tolist()]) for k in range(3))
    sent = queries.sparkSession.sparkContext.broadcast((ids, n, radius, parts, found.centres[ids]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, radius, parts, points = sent.value
        for batch in batches:
            for start in range(0, len(batch), dense.ROWS):
                own = batch.slice(start, dense.ROWS)
                x = np.array(own.column("x").to_pylist(), np.float64).reshape(len(own), -1)
                bound = x @ points.T + np.sqrt((x * x).sum(axis=1))[:, None] * radius[None, :]
                order = np.argsort(-bound, axis=1, kind="stable")
                sizes = n[order]
                flat = [ids[order], np.take_along_axis(bound, order, 1), sizes, parts[order], np.cumsum(sizes, axis=1) - sizes]
                take = pa.array(np.repeat(np.arange(len(own)), len(ids)))
                types = (pa.int32(), pa.float64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([own.column("qid").take(take), *(pa.array(f.ravel()).cast(t) for f, t in zip(flat, types, strict=True))], ["qid", "cluster", "bound", "n", "parts", "before"])

    return queries.select("qid", "x").mapInArrow(run, "qid bigint, cluster int, bound double, n bigint, parts int, before bigint")


def pruned_search(found: Clusters, queries: DataFrame, k: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(qid, ord, score, rank) of the ``k`` vectors of the largest inner product, and (qid, compared, of) of what was looked at.

    queries (qid, embedding). Of equal products (to 9 digits) the smaller ord is first. A query meets each cluster
    once at most; those of a cluster are held in blocks, and a large cluster is read in parts."""
    asked = queries.select("qid", F.col(column).alias("x"))
    if not len(found.centres) or asked.isEmpty():
        empty = found.clusters.sparkSession
        return ranked(empty.createDataFrame([], dense.FOUND), k), empty.createDataFrame([], "qid bigint, compared bigint, of bigint")
    plan = materialize(bounded(found, asked), "bounds")
    width = found.centres.shape[1]
    most = max(1, dense.MATRIX // width)

    def search(some: DataFrame) -> DataFrame:
        load = some.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("blocks"))  # a row a centre
        own = some.join(F.broadcast(load), "cluster").withColumn("block", F.pmod(F.xxhash64("qid"), "blocks").cast("int"))
        own = own.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).join(asked, "qid")
        docs = found.vectors.join(F.broadcast(load), "cluster").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
        return dense.in_cells(docs, own, ["cluster", "part", "block"], k)

    first = materialize(ranked(search(plan.where(F.col("before") < k)), k), "first-found")
    least = first.where(F.col("rank") == k).select("qid", F.col("score").alias("least"))
    again = plan.where(F.col("before") >= k).join(least, "qid", "left").where(f"least is null or bound >= least - {MARGIN}").drop("least")
    again = materialize(again, "second-pass")
    out = ranked(first.drop("rank").unionByName(search(again)), k)
    seen = plan.where(F.col("before") < k).select("qid", "n").unionByName(again.select("qid", "n")).groupBy("qid").agg(F.sum("n").alias("compared"))
    total = plan.groupBy("qid").agg(F.sum("n").alias("of"))
    return out, total.join(seen, "qid", "left").select("qid", F.coalesce("compared", F.lit(0)).alias("compared"), "of")
