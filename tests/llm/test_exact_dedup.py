"""Exact duplicates against a plain grouping, with honest and with clashing digests."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodespark.llm import exact_dedup as E

TEXTS = [(5, "a  b"), (3, "a b"), (9, "a\tb"), (1, "c"), (2, None), (4, ""), (8, " "), (7, "\n\n"), (None, "c"), (None, "only"), (6, "a b"), (5, "a  b"), (10, "x y " * 40_000), (11, "x  y " * 40_000), (12, "A b")]


def plain(rows):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    out = []
    for i, t in rows:
        own = [j for j, u in rows if norm(u) == norm(t)]
        keep = min((j for j in own if j is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [E.sha256, lambda t: F.length(t) % 2, lambda t: F.lit(1)])
def test_equals_plain_grouping(spark, digest):
    docs = spark.createDataFrame([(*r, "k", 1) for r in TEXTS], "doc_id bigint, text string, keep_id string, kept int").repartition(4)
    assert sorted(map(tuple, E.exact_dedup(docs, digest=digest).collect()), key=repr) == plain(TEXTS)


def test_a_hot_text_and_string_ids(spark):
    docs = spark.range(3000).select(F.concat(F.lit("d"), F.lpad("id", 5, "0")).alias("name"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("body"))
    out = E.exact_dedup(docs, "name", "body").groupBy("keep_id", "group_size").count().orderBy(F.desc("count")).first()
    assert tuple(out) == ("d00001", 2000, 2000)


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    plan = E.exact_dedup(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
