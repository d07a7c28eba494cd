"""BM25, dense search, fusion and evaluation against the formulas written out in Python."""

import math
import random
import re
from collections import Counter

import pytest

from lodespark.functions import vectors as V
from lodespark.operators import dense, evaluate, fuse, lexical
from lodespark.plans import queries


def frame(spark, rows, key="ord"):
    return spark.createDataFrame(rows, f"{key} bigint, text string")


def bm25(docs, query):
    toks = {i: [w.lower() for w in re.findall("[0-9A-Za-z가-힣]+", t or "")] for i, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    out = {}
    for w in re.findall("[0-9A-Za-z가-힣]+", query):
        df = sum(w.lower() in t for t in toks.values())
        for i, t in toks.items():
            tf = t.count(w.lower())
            if tf:
                out[i] = out.get(i, 0) + math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda x: (-x[0], x[1]))


DOCS = [(0, "heat pump heat"), (1, "water pump"), (2, "the pump"), (3, "the water, the heat"), (4, ""), (5, None), (6, "the water, the heat")]


def test_bm25_equals_formula(spark):
    asked = [(0, "heat"), (1, "water water the"), (2, "unknown"), (3, ""), (4, "Pump HEAT")]
    out = lexical.bm25(frame(spark, DOCS), frame(spark, asked, "qid"), 10).collect()
    for q, text in asked:
        assert [(r.score, r.ord) for r in sorted((r for r in out if r.qid == q), key=lambda r: r["rank"])] == bm25(DOCS, text)


def test_common_terms_keep_a_positive_weight(spark):
    out = lexical.bm25(frame(spark, [(i, "same word") for i in range(4)]), frame(spark, [(0, "same")], "qid"), 2).collect()
    assert [(r.ord, r["rank"]) for r in out] == [(0, 1), (1, 2)] and all(r.score > 0 for r in out)


def test_idf_anchor(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(lexical.idf(F.lit(4), F.lit(2))).first()[0] == pytest.approx(0.6931471805599453, abs=1e-15)


def test_dense_equals_formula(spark):
    rnd = random.Random(1)
    docs = [(i, "".join(rnd.choice("abcd 가") for _ in range(rnd.randrange(0, 30)))) for i in range(60)]
    out = dense.dense_hash(frame(spark, docs).repartition(5), frame(spark, [(0, "abca"), (1, "")], "qid"), 7).collect()

    def sim(a, b):
        a, b = V.counts(a), V.counts(b)
        return round(float(a @ b) / ((math.sqrt(a @ a) or 1.0) * (math.sqrt(b @ b) or 1.0)), 9)

    for q, text in ((0, "abca"), (1, "")):
        want = sorted(((-sim(text, t), i) for i, t in docs))[:7]
        assert [(-r.score, r.ord) for r in sorted((r for r in out if r.qid == q), key=lambda r: r["rank"])] == [(s + 0.0, i) for s, i in want]


def test_more_queries_than_one_pass_holds(spark, monkeypatch):
    monkeypatch.setattr(dense, "MATRIX", 1024)
    asked = frame(spark, [(i, t) for i, t in enumerate(["abc", "abd", "xyz", "abca", "q"])], "qid")
    docs = frame(spark, [(0, "abc"), (1, "xyz abd")])
    assert dense.dense_hash(docs, asked, 1).count() == 5


def test_rrf(spark):
    a = spark.createDataFrame([(0, 10, 1), (0, 20, 2)], "qid bigint, ord bigint, rank int")
    b = spark.createDataFrame([(0, 20, 1), (0, 10, 2)], "qid bigint, ord bigint, rank int")
    assert {r.ord: r.score for r in fuse.rrf([a, b]).collect()} == {10: pytest.approx(1 / 61 + 1 / 62, abs=1e-12), 20: pytest.approx(0.03252247488101534, abs=1e-12)}


def test_modes(spark):
    docs, asked = frame(spark, DOCS), frame(spark, [(0, "heat pump"), (1, "zzz")], "qid")
    rows = {m: fuse.search(docs, asked, 3, m).collect() for m in ("hybrid", "dense", "bm25")}
    assert not [r for r in rows["bm25"] if r.qid == 1] and len([r for r in rows["hybrid"] if r.qid == 1]) == 3
    best = next(r for r in rows["hybrid"] if r.qid == 0 and r["rank"] == 1)
    assert best.ord == 0 and best.score == pytest.approx(2 / 61)
    assert all(r.score == pytest.approx(1 / (60 + r.dense_rank)) for r in rows["dense"]) and any(r.bm25_rank for r in rows["dense"])
    assert {r.ord for r in fuse.search(docs, asked, 100).where("qid = 0").collect()} == {i for i, _ in DOCS}
    with pytest.raises(ValueError):
        fuse.search(docs, asked, 0)
    assert fuse.search(frame(spark, DOCS).limit(0), asked, 3).count() == 0


def test_metrics(spark):
    cases = spark.createDataFrame([(0, "gold"), (1, "missing"), (2, "late")], "qid bigint, gold string")
    found = spark.createDataFrame([(0, 1, "a"), (0, 2, "the gold bar"), (2, 4, "too late"), (2, 5, "late")], "qid bigint, rank int, text string")
    m = evaluate.metrics(evaluate.first_hits(cases, found)).first()
    assert (m.n_cases, m.hit_1, m.hit_3, m.hit_5) == (3, 0.0, pytest.approx(1 / 3), pytest.approx(2 / 3)) and m.mrr == pytest.approx((1 / 2 + 1 / 4) / 3)
    assert evaluate.table([{"a": 0.5, "b": None}], ["a", "b"]) == "| a | b |\n| --- | --- |\n| 0.500 | - |"


def test_evaluation_asks_by_the_first_words_in_all_modes(spark, tmp_path):
    """each case asked by its whole gold text, by BM25 alone."""
    head = "alpha beta gamma delta one two three four"
    docs = [(0, f"{head} rare tail and much else that makes this one long"), (1, head), (2, "old waterworks stand here"), (3, "rare tail"), (4, "")]
    cases = [(0, f"{head} rare tail"), (1, "terwor"), (2, ""), (3, None), (4, "no such text")]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(cases, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    # case 0: the document of the first words alone comes before that of the passage, which the whole passage would find first;
    # case 1: no word is found, but trigrams are; case 2: all documents hold an empty gold text, and only dense search has no threshold
    want = {("bm25", 5, 0.0, 0.2, 0.2, 0.1), ("dense", 5, 0.4, 0.6, 0.6, 0.5), ("hybrid", 5, 0.4, 0.6, 0.6, 0.5)}
    made = queries.retrieval_eval(spark, str(tmp_path))
    assert made.columns == ["mode", "n_cases", "hit_1", "hit_3", "hit_5", "mrr"] and {tuple(r) for r in made.collect()} == want
