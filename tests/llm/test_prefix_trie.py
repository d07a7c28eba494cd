"""The trie against a plain one, with fingerprints that clash and conversations over several partitions."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodespark.llm import prefix_trie as T


def plain(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - (abs(c) % 5) * (1 if c >= 0 else -1), [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {n: [] for n in members}
    for n in members:
        if n:
            children[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[x] for x in children[n]) or 1
        saved[n] = (len(members[n]) - 1) * len(n[-1][1].encode() if n else b"") + sum(saved[x] for x in children[n])
    digest = lambda n: hashlib.sha256(",".join(str(c) for c in sorted(members[n]) if built[c] == n).encode()).hexdigest()
    return sorted(((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(children[n]), leaves[n], saved[n], digest(n)) for n in members), key=str)


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def conversations(seed, n=60):
    rnd = random.Random(seed)
    rows = []
    for c in range(-7, n):
        if rnd.random() < 0.1:
            continue
        for t in range(rnd.choice([1, 2, 5, 8, 9, 12, 20])):
            rows.append((c, t, rnd.choice(["user", "assistant", None]) if t else "user", rnd.choice(["hi", "é", "", None, "hi"])))
    rows += [(3, None, "user", "first"), (3, None, "a", "first"), (4, 1, "user", "hi"), (4, 1, "user", "hi"), (4, 1, None, "twice"), (None, 1, "user", "lost"), (10**12, 0, None, None)]
    rnd.shuffle(rows)
    return rows


def made(spark, rows, **options):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit(1)).withColumn("conv", F.lit("x")).withColumn("a.b", F.lit(0))
    return sorted((tuple(r) for r in T.prefix_trie(frame, **options).collect()), key=str)


def test_against_a_plain_trie(spark):
    rows = conversations(1)
    assert made(spark, rows) == plain(rows)


@pytest.mark.parametrize("weak", ["named_struct('f1', {0}.f1 % 3, 'f2', 0L)", "named_struct('f1', 0L, 'f2', 0L)"])
def test_clashing_fingerprints_are_split(spark, weak):
    rows = conversations(2, 25)
    assert made(spark, rows, fingerprint=weak) == plain(rows)


def test_a_long_conversation_in_several_parts(spark, monkeypatch):
    """One conversation has most rows, its part before another's and after; blocks of depths are small."""
    monkeypatch.setattr(T, "BLOCK", 16)
    monkeypatch.setattr(T, "PIECE", 8)
    rnd = random.Random(3)
    rows = [(c, t, "user", f"{t % 7}") for c in (10, 12, 14) for t in range(rnd.choice([700, 400]))] + [(c, t, "user", f"{t % 7}") for c in range(20, 60) for t in range(3)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = T.scanned(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("conv_id", "conv")).where("conv = 10").select("part").distinct().count()
        assert parts > 1
        assert made(spark, rows) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_long_texts_and_empty_table(spark):
    rows = [(0, 0, "user", "x" * 500_000), (1, 0, "user", "x" * 500_000), (1, 1, "r" * 70 + "b", "y"), (1, 1, "r" * 70 + "a", "z"), (2, 0, "user", "x" * 499_999 + "y")]
    want = plain(rows)
    assert made(spark, rows) == want
    assert made(spark, []) == []


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in T.op12_prefix_trie(spark, data).collect()), key=str) == plain(rows)
