"""Dense row numbers without any task seeing all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 12


def numbered(rows: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, counting from 0 by bucket and then ``order``.

    Each bucket counts its own rows and starts where the buckets before it end; a bucket
    is one task's work, so there should be many, of which a few thousand fit one task."""
    rows = rows.withColumn("__b", bucket)
    starts = rows.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    starts = starts.select("__b", (F.sum("n").over(Window.orderBy("__b")) - F.col("n")).alias("__s"))
    own = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return rows.withColumn("__n", own).join(F.broadcast(starts), "__b").withColumn(name, (F.col("__s") + F.col("__n") - 1).cast("bigint")).drop("__b", "__s", "__n")


def numbered_by(rows: DataFrame, key: str, more: list[str], name: str, bits: int = BITS) -> DataFrame:
    """``rows`` numbered by the number ``key`` and then ``more``, whatever numbers the keys are.

    Buckets are equal parts of the range that the keys really have, from the least to the greatest.
    Rows without a key come first. Of keys that lie unevenly, as hashes and row ids do not, a part may have many."""
    ends = rows.agg(F.min(key).cast("double").alias("__lo"), F.max(key).cast("double").alias("__hi"))
    width = F.greatest(F.col("__hi") - F.col("__lo"), F.lit(1.0))
    part = F.least(F.floor((F.col(key).cast("double") - F.col("__lo")) / width * (1 << bits)), F.lit((1 << bits) - 1))
    return numbered(rows.crossJoin(F.broadcast(ends)), F.when(F.col(key).isNotNull(), part).otherwise(F.lit(-1)), [key, *more], name).drop("__lo", "__hi")
