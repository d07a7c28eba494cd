"""Operators that must not depend on how many rows one key, level, word or query set has."""

import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodespark import workspace
from lodespark.operators import clusters, dense, lexical, number, serving
from lodespark.operators.quantiles import quantiles


def exact(values, q):
    values = sorted(values)
    at = (len(values) - 1) * q
    low = int(at)
    return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low)


@pytest.mark.parametrize("few", [20_000, 40])
def test_quantiles_of_one_large_level(spark, few):
    """Heavy values, several magnitudes and few rows; with ``few`` at 40, ranges are cut again and again."""
    rnd = random.Random(1)
    rows = [("all", rnd.choice([rnd.random(), 10 ** rnd.uniform(-9, 9), 3.0, 3.0, -rnd.random()])) for _ in range(6000)]
    rows += [(None, float(i)) for i in range(5)] + [("one", 7.5), ("none", None)]
    made = quantiles(spark.createDataFrame(rows, "level string, x double").repartition(5), ["level"], {"x": F.col("x"), "y": F.col("x") * 2}, [0, 0.5, 0.95, 0.999, 1], few)
    got = {(r.level, r.name, r.q): r.value for r in made.collect()}
    assert len(got) == 3 * 2 * 5
    for level in ("all", None, "one"):
        own = [x for at, x in rows if at == level]
        for q in (0, 0.5, 0.95, 0.999, 1):
            assert got[level, "x", q] == pytest.approx(exact(own, q), rel=1e-12)
            assert got[level, "y", q] == pytest.approx(2 * exact(own, q), rel=1e-12)


def test_quantiles_of_nothing(spark):
    assert quantiles(spark.createDataFrame([], "level string, x double"), ["level"], {"x": F.col("x")}, [0.5]).collect() == []


def test_summary_by_ranges(spark):
    rows = spark.range(3000).selectExpr("'all' as concurrency", "id % 7 <> 0 as ok", "id * 37 % 1000 / 1000D as ttft", "id * 91 % 2000 / 100D as latency", "id % 5 as num_tokens", "10D as wall")
    plain, cut = (serving.summary(rows, few=few).first() for few in (20_000, 30))
    assert plain == cut
    fine = rows.where("ok").agg(F.expr("percentile(ttft, 0.95)")).first()[0]
    assert plain.ttft_p95_ms == pytest.approx(fine * 1000, abs=0.051)


def test_rows_with_small_keys_are_in_many_buckets(spark):
    rows = spark.range(2000).selectExpr("id * 7919 % 1000003 as key", "id", "'x' as `a.b`")
    made = number.numbered_by(rows, "key", ["id"], "n")
    assert [r.n for r in made.orderBy("key", "id").collect()] == list(range(2000))
    ends = rows.agg(F.min("key"), F.max("key")).first()
    buckets = rows.select(F.floor((F.col("key") - ends[0]) / (ends[1] - ends[0]) * 4096)).distinct().count()
    assert buckets > 1000
    odd = number.numbered_by(spark.createDataFrame([(None, 1), (-(2**63), 2), (2**63 - 1, 3), (0, 4), (0, 0)], "key bigint, id bigint"), "key", ["id"], "n")
    assert [r.id for r in odd.orderBy("n").collect()] == [1, 2, 0, 4, 3]
    assert number.numbered_by(rows.limit(0), "key", ["id"], "n").count() == 0


def test_threads_do_not_delete_each_others_tables(spark):
    inside, go_on, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait(60)
        kept.append(workspace.materialize(spark.range(7), "other"))
        with workspace.temporary_tables(spark):
            kept.append(workspace.materialize(spark.range(3), "gone"))
        go_on.set()

    thread = threading.Thread(target=other)
    thread.start()
    with workspace.temporary_tables(spark):
        own = workspace.materialize(spark.range(5), "own")
        with workspace.kept_tables():
            stays = workspace.materialize(spark.range(4), "stays")
        inside.set()
        assert go_on.wait(120)
        assert own.count() == 5
    thread.join(60)
    spark.catalog.clearCache()
    assert kept[0].count() == 7 and stays.count() == 4
    for gone in (own, kept[1]):
        assert not any(workspace.exists(spark, f) for f in gone.inputFiles())
    assert spark.conf.get(workspace.CLEANUP, None) in (None, "false")


def nearest(docs, asked, k):
    out = {}
    for q, x in asked:
        scores = sorted(((-round(float(np.dot(np.array(x, np.float32).astype(float), np.array(y, np.float32).astype(float))), 9), i) for i, y in docs))
        out[q] = [(-s + 0.0, i) for s, i in scores[:k]]
    return out


def found(made):
    out = {}
    for r in made.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.score, r.ord))
    return out


def vectors(rnd, n, groups, dim=8):
    points = [[rnd.gauss(0, 1) for _ in range(dim)] for _ in range(groups)]
    rows = [(i, [x + rnd.gauss(0, 0.05) for x in rnd.choice(points)]) for i in range(n)]
    return [*rows, *((n + i, rows[i][1]) for i in range(5))]  # ties


SCHEMA = "{} bigint, embedding array<float>"


@pytest.mark.parametrize("most", [4_000_000, 64])
def test_grid_of_queries_and_documents(spark, monkeypatch, most):
    rnd = random.Random(2)
    docs, asked = vectors(rnd, 300, 12), vectors(rnd, 60, 6)
    monkeypatch.setattr(dense, "MATRIX", most)
    monkeypatch.setattr(dense, "ROWS", 16)
    made = dense.dense_vectors(spark.createDataFrame(docs, SCHEMA.format("ord")), spark.createDataFrame(asked, SCHEMA.format("qid")), 4)
    assert found(made) == nearest(docs, asked, 4)


def test_clusters_give_the_exact_best_and_pass_over_most(spark, monkeypatch):
    rnd = random.Random(3)
    docs, asked = vectors(rnd, 1500, 25), vectors(rnd, 40, 25)
    monkeypatch.setattr(dense, "MATRIX", 100)  # blocks of 12 queries
    own = clusters.clustered(spark.createDataFrame(docs, SCHEMA.format("ord")), 25, part=40)
    made, seen = clusters.pruned_search(own, spark.createDataFrame(asked, SCHEMA.format("qid")), 6)
    assert found(made) == nearest(docs, asked, 6)
    share = seen.agg(F.sum("compared") / F.sum("of")).first()[0]
    assert share < 0.5
    more, _ = clusters.pruned_search(own, spark.createDataFrame(asked[:2], SCHEMA.format("qid")), 2000)
    assert found(more) == nearest(docs, asked[:2], 2000)
    none = clusters.clustered(spark.createDataFrame([], SCHEMA.format("ord")))
    assert clusters.pruned_search(none, spark.createDataFrame(asked, SCHEMA.format("qid")), 3)[0].count() == 0


def test_a_query_passes_over_runs_it_can_not_gain_from():
    best = lexical._Best([(1, "rare", 5.0), (1, "common", 0.1), (2, "common", 0.1)], 2)
    best.add({i: [("rare", 1.0), ("common", 1.0)] for i in range(3)})
    before = best.score.copy()
    best.add({i: [("common", 1.0)] for i in range(10, 20)})
    assert (best.met, best.passed) == (4, 1) and (best.score[0] == before[0]).all() and best.at[1].tolist() == [0, 1]


@pytest.mark.parametrize(("queries", "run"), [(2048, 256), (3, 2)])
def test_blocks_and_runs_give_the_same(spark, monkeypatch, queries, run):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(words, weights=range(1, 31), k=rnd.randrange(1, 20)))) for i in range(200)], "ord bigint, text string")
    asked = spark.createDataFrame([(i, " ".join(rnd.choices(words, k=4))) for i in range(11)], "qid bigint, text string")
    terms = lexical.query_terms(asked)
    posts, stats = lexical.postings(lexical.tokenized(docs)), lexical.corpus_stats(lexical.tokenized(docs))
    pairs = terms.join(lexical.terms(posts, stats), "tok").join(lexical.weighted(posts, stats), "tok").groupBy("qid", "ord").agg(F.sum(F.col("qtf") * F.col("idf") * F.col("weight")).alias("score"))
    want = found(lexical.ranked(pairs, 5))
    monkeypatch.setattr(lexical, "QUERIES", queries)
    monkeypatch.setattr(lexical, "RUN", run)
    assert found(lexical.bm25(docs, asked, 5)) == want
