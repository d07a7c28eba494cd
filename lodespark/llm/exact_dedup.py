"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Equal texts are combined three times, each time by digest and full content:
within a map task (the partial aggregation), within one of ``salts`` salted
groups, and over the winners of the salts. A text that a third of all rows share
therefore reaches any task at most once per map task divided by ``salts``, and
the final task at most ``salts`` times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lookup, materialize

WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; empty texts form a group like any other. Of equal
    texts the smallest non-null id stays; a group without ids keeps its null ids.
    Rows that repeat the kept id with the same text are all marked kept, as they
    can't be told apart. Other columns are ignored, whatever their names.
    ``digest`` is exchangeable: texts that share a digest but differ are told apart
    by content."""
    rows = docs.select(F.col(id_col).alias("__id"), normalized(F.col(text_col)).alias("__t")).withColumn("__d", digest(F.col("__t")))
    salted = rows.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy("__s", "__d", "__t").agg(F.min("__id").alias("__k"), F.count(F.lit(1)).alias("__n"))
    groups = materialize(salted.groupBy("__d", "__t").agg(F.min("__k").alias("__k"), F.sum("__n").alias("__n")).select("__d", "__k", "__n"), "exact-groups")
    shared = groups.groupBy("__d").count().where("count > 1").select("__d")
    clash = not shared.isEmpty()
    single = groups.join(shared, "__d", "left_anti") if clash else groups
    out = lookup(rows.select("__id", "__d", sha256(F.col("__t")).alias("__h")), single, "__d", "__n")
    if clash:
        again = rows.join(shared, "__d", "left_semi")
        per_text = again.groupBy("__d", "__t").agg(F.min("__id").alias("__k"), F.count(F.lit(1)).alias("__n"))
        exact = again.join(per_text, ["__d", "__t"]).select("__d", "__id", sha256(F.col("__t")).alias("__h"), "__k", "__n")
        out = out.where("__n is not null").unionByName(exact)
    return out.select(
        F.col("__id").alias(id_col), F.col("__k").alias("keep_id"), F.col("__n").alias("group_size"),
        F.col("__id").eqNullSafe(F.col("__k")).alias("kept"), F.col("__h").alias("text_sha256"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as x from documents
)
select doc_id, min(doc_id) over (partition by x) as keep_id,
       cast(count(*) over (partition by x) as bigint) as group_size,
       doc_id is not distinct from min(doc_id) over (partition by x) as kept,
       sha256(x) as text_sha256
from t
"""

QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLE = {"op8_exact_dedup": SQL}
