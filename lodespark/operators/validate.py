"""Validation of search and ask requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = "^(hybrid|dense|bm25)$"


def problem(query: Column, top_k: Column, mode: Column, most: int = 50) -> Column:
    """What is wrong with a request, or null. A missing top_k or mode is none, as both have defaults."""
    return F.when(F.length(F.coalesce(query, F.lit(""))) < 1, "query").when(top_k.isNotNull() & ~top_k.between(1, most), "top_k").when(mode.isNotNull() & ~mode.rlike(MODES), "mode")


def top_k_or_default(top_k: Column, default: int) -> Column:
    """0 and null mean the default."""
    return F.coalesce(F.nullif(top_k, F.lit(0)), F.lit(default))


def parted(requests: DataFrame, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) requests (query, top_k, mode); the latter with a column problem."""
    rows = requests.withColumn("problem", problem(F.col("query"), F.col("top_k"), F.col("mode"), most))
    return rows.where("problem is null").drop("problem"), rows.where("problem is not null")
