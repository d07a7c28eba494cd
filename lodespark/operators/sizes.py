"""Joins that broadcast a side, and tables that are dealt out, only after their sizes are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; the rows joined here have a few dozen bytes.
SMALL = 200_000


def is_small(df: DataFrame, most: int = SMALL) -> bool:
    return df.limit(most + 1).count() <= most


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, and else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if is_small(df, most) else df


#: Rows of a part that :func:`dealt` makes, where that is more parts than tasks run at once.
PART = 20_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt out by ``key``, which should have many values, if their parts are fewer than the tasks that run at once or one has over twice its share.

    A file is cut into parts by its bytes, but a row group goes whole to one of them: of a file with a single one all other parts are
    empty, so that the number of parts alone says nothing. No column is read to count the rows of each; Parquet has that in its footers."""
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    filled, most, n = parts.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    if not filled or filled >= tasks and most * tasks <= 2 * n:
        return rows
    return rows.repartition(max(tasks, n // PART), key)
