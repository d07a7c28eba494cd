"""The index's log, its compaction, and what a search reads."""

import json
import os
import subprocess
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from lodespark.operators import lexical
from lodespark.plans.engine import Engine
from lodespark.settings import load
from lodespark.sources.index import Index

from .conftest import ROOT


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in texts], "doc_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


def hits(rows):
    return sorted((r.qid, r["rank"], r.key, round(r.score, 9)) for r in rows.collect())


TEXTS = [(0, "heat pump heat"), (1, "water pump"), (2, "the pump"), (3, "the water, the heat"), (4, "cold water")]


def batches(spark, path, **options):
    one = Index(spark, path, **options)
    for part in (TEXTS[:2], TEXTS[2:4], TEXTS[4:]):
        one.add(docs(spark, *part))
    return one


def test_statistics_by_batch_equal_a_rebuild(spark, tmp_path):
    parts, whole = batches(spark, str(tmp_path / "a")), Index(spark, str(tmp_path / "b"))
    whole.add(docs(spark, *TEXTS))
    queries = asked(spark, "heat", "water pump", "the", "unknown")
    score = lambda one: sorted((r.qid, r.key, r.score) for r in one.bm25(queries, 9).join(one.chunks().select("ord", "key"), "ord").collect())
    assert score(parts) == score(whole)
    files = parts.bm25(queries, 9).inputFiles()
    assert any("/terms/" in f for f in files) and not any("/chunks/" in f for f in files)


def test_compaction_under_a_reader(spark, tmp_path):
    one, queries = batches(spark, str(tmp_path / "i")), asked(spark, "heat", "water pump")
    before, open_ = hits(one.search(queries, 3)), one.search(queries, 3)
    assert one.compact() and not one.compact()
    assert one.meta() == {"embedder": "hash", "dim": 512, "tokenizer": "words", "n": 5, "batches": 1}
    assert hits(open_) == before == hits(one.search(queries, 3))
    one.add(docs(spark, (7, "heat of the sun")))
    assert one.meta()["batches"] == 2 and [r.ord for r in one.chunks().orderBy("ord").collect()] == list(range(6))
    assert one.vacuum() == 0 and one.vacuum(0) == 3  # the three old batches
    assert one.compact(3) is False and one.compact() and one.chunks().count() == 6


def test_of_two_compactions_one_counts(spark, tmp_path):
    one = batches(spark, str(tmp_path / "i"))
    old = one.batches()
    assert one.compact()
    assert one.commit(5, 1, "late", replaces=old) is False


def test_a_token_is_known_after_compaction(spark, tmp_path):
    one = Index(spark, str(tmp_path / "i"))
    assert [one.add(docs(spark, (i, "some words")), f"t{i}") for i in range(2)] == [1, 1]
    assert one.compact() and one.add(docs(spark, (0, "some words")), "t0") == 0 and one.meta()["n"] == 2


def test_failed_adds_leave_nothing_that_is_read(spark, tmp_path):
    one = batches(spark, str(tmp_path / "i"))
    os.makedirs(tmp_path / "i/chunks/batch=lost")
    os.makedirs(tmp_path / "i/terms/batch=lost")
    assert one.chunks().count() == 5 and one.vacuum() == 0 and one.vacuum(0) == 1 and not (tmp_path / "i/chunks/batch=lost").exists()
    assert one.add(docs(spark, (9, ""))) == 0 and len(os.listdir(tmp_path / "i/chunks")) == 3


def test_twenty_tokens_read_their_parts_only(spark, tmp_path):
    one = Index(spark, str(tmp_path / "i"))
    one.add(docs(spark, *((i, " ".join(f"w{i}x{k}" for k in range(40))) for i in range(50))))
    read = one.wanted_postings(lexical.query_terms(asked(spark, " ".join(f"w{i}x3" for i in range(20)))))
    plan = read._jdf.queryExecution().executedPlan().toString()
    line = next(x for x in plan.splitlines() if "FileScan" in x)
    assert "PartitionFilters" in line and "part#" in line.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert read.select("tok").distinct().count() == 20
    every, some = (len(set(x.inputFiles())) for x in (one.postings(), read))
    names = {r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(names) <= 20 < every and some <= every


def test_another_tokenizer_is_refused(spark, tmp_path):
    path = str(tmp_path / "i")
    spaced = lambda c: F.split(F.lower(c), " ")
    one = Index(spark, path, tokenizer="spaced", tokens=spaced)
    one.add(docs(spark, (0, "semi-detached house"), (1, "house")))
    assert [r.key for r in one.search(asked(spark, "semi-detached"), 5, "bm25").collect()] == ["d0#0"]
    with pytest.raises(ValueError, match="tokenizer spaced, not words"):
        Index(spark, path)
    conf = load({"LODESPARK_TOKENIZER": "words", "LODESPARK_INDEX_DIR": path})
    with pytest.raises(ValueError, match="tokenizer"):
        Engine(spark, conf)
    with pytest.raises(ValueError, match="unknown tokenizer"):
        Index(spark, str(tmp_path / "j"), tokenizer="none such")


WRITER = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from lodespark.sources.index import Index
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "1").getOrCreate()
one = Index.__new__(Index)
one.spark, one.path, one.embedder, one.dim, one.tokenizer = spark, sys.argv[2], "hash", 512, "words"
for i in range(15):
    assert one.commit(1, 1, f"{sys.argv[3]}-{i}")
"""


def test_two_processes_commit_to_one_log(tmp_path):
    path, script = tmp_path / "i", tmp_path / "writer.py"
    (path / "meta").mkdir(parents=True)
    script.write_text(textwrap.dedent(WRITER))
    running = [subprocess.Popen([sys.executable, str(script), ROOT, str(path), name], stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL) for name in "ab"]
    assert [p.wait(240) for p in running] == [0, 0]
    rows = [json.loads((path / "meta" / f).read_text()) for f in sorted(os.listdir(path / "meta")) if f.endswith(".json")]
    assert [r["version"] for r in rows] == [r["start"] for r in rows] == list(range(30)) and rows[-1]["n"] == 30
    assert sorted(r["batch"] for r in rows) == sorted(f"{name}-{i}" for name in "ab" for i in range(15))
