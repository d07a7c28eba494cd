"""Serving measurements: per request from its deltas, and per level of concurrency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import FEW, quantiles


def tpot(ttft: Column, latency: Column, n: Column) -> Column:
    """Seconds per token after the first, 0 where there is no second."""
    return F.when(n > 1, (latency - ttft) / (n - 1)).otherwise(F.lit(0.0))


def measured(deltas: DataFrame) -> DataFrame:
    """(req_id, ttft, latency, num_tokens) of delta rows (req_id, t, delta, usage_tokens), t being seconds since the request.

    The first non-empty delta is the first token, 0 where there is none; tokens are as
    the server says, or else the number of non-empty deltas."""
    said = F.coalesce(F.col("delta"), F.lit("")) != ""
    return deltas.groupBy("req_id").agg(F.coalesce(F.min(F.when(said, F.col("t"))), F.lit(0.0)).alias("ttft"), F.max("t").alias("latency"), F.coalesce(F.max("usage_tokens"), F.count_if(said)).cast("bigint").alias("num_tokens"))


#: (name, column, quantile, scale, digits) of a summary.
QUANTILES = (("ttft_p50_ms", "ttft", 0.5, 1000, 1), ("ttft_p95_ms", "ttft", 0.95, 1000, 1), ("tpot_p50_ms", "tpot", 0.5, 1000, 2), ("latency_p50_s", "latency", 0.5, 1, 3), ("latency_p95_s", "latency", 0.95, 1, 3))


def summary(requests: DataFrame, by: str = "concurrency", wall: str = "wall", few: int = FEW) -> DataFrame:
    """Per level: counts, throughput and percentiles with linear interpolation, of the requests that went well.

    requests (by, ok, ttft, latency, num_tokens, wall); wall: the seconds the whole level took. The
    percentiles are exact; a level of any number of requests is cut into ranges for them, see :mod:`quantiles`."""
    ok, seconds = F.col("ok"), F.max(wall)
    totals = requests.groupBy(by).agg(
        F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.bround(seconds, 3).alias("wall_s"),
        F.bround(F.count_if(ok) / seconds, 3).alias("req_per_s"), F.bround(F.coalesce(F.sum(F.when(ok, F.col("num_tokens"))), F.lit(0)) / seconds, 1).alias("tok_per_s"),
    )
    each = tpot(F.col("ttft"), F.col("latency"), F.col("num_tokens"))
    columns = {"ttft": F.col("ttft"), "tpot": F.when(each > 0, each), "latency": F.col("latency")}
    found = quantiles(requests.where(ok), [by], columns, sorted({q for _, _, q, _, _ in QUANTILES}), few)
    pick = lambda c, q: F.max(F.when((F.col("name") == c) & (F.col("q") == q), F.col("value")))
    found = found.groupBy(F.col(by).alias("__by")).agg(*[F.bround(pick(c, q) * scale, digits).alias(name) for name, c, q, scale, digits in QUANTILES])
    return totals.join(found, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def prompts_for(requests: DataFrame, prompts: DataFrame, m: int) -> DataFrame:
    """Requests (i) with their prompt (n, prompt), taken in turn."""
    return requests.withColumn("n", F.pmod("i", F.lit(m))).join(prompts, "n")
