"""The quality classifier on held-out rows, and its score on odd rows."""

import random

from pyspark.sql import functions as F

from lodespark.llm import quality as Q


def corpus(rnd, n):
    good = lambda: " ".join("".join(rnd.choice(["ther", "ing", "an", "ed", "on", "re"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(20, 200))) + "."
    bad = lambda: " ".join("".join(rnd.choice("QZXJ") for _ in range(5)) + "!!" for _ in range(rnd.randrange(20, 200)))
    return [(i, bad() if i % 4 == 0 else good(), int(i % 4 != 0)) for i in range(n)]


def test_held_out_rows(spark):
    rows = corpus(random.Random(1), 600)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows] + [(None, 1), (10**6, 0), (3, 0)], "doc_id bigint, quality int")
    model = Q.train(docs, labels)
    out = {r.doc_id: r.score for r in Q.score(docs, model).where(Q.fold(F.col("doc_id")) == 0).collect()}
    assert len(out) > 60 and all((out[i] >= Q.THRESHOLD) == bool(q) for i, _, q in rows if i in out)
    assert Q.train(docs, labels) == model


def test_held_out_labels_are_never_used(spark):
    rows = corpus(random.Random(2), 200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int")
    flipped = labels.withColumn("quality", F.when(Q.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert Q.train(docs, labels) == Q.train(docs, flipped)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "x" * 300_000, 5), (3, "x" * 300_000, 5), (None, "thing", 5)], "doc_id bigint, text string, score int")
    none = Q.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    one = Q.train(docs, spark.createDataFrame([(2, 1), (3, 1), (1, 1)], "doc_id bigint, quality int"))
    out = Q.with_score(docs, one)
    assert out.columns == ["doc_id", "text", "score"] and all(0 <= r.score <= 1 for r in out.collect()) and out.count() == 5
    assert Q.score(docs.limit(0), one).count() == 0


def test_real_rows(spark, data):
    out = Q.op1_quality_classifier(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert out.count() == docs.count() and out.where("score between 0 and 1 and predicted = cast(score >= 0.3 as int)").count() == docs.count()


def test_scores_are_those_of_plain_compression(spark):
    """Each score worked out anew from the model's two dictionaries, with an unshared compressor for each block."""
    import math

    import zstandard

    rows = corpus(random.Random(3), 150) + [(900, None, 0), (901, "", 1), (902, "é" * 5000, 1), (902, "é" * 5000, 1)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    m = Q.train(docs, spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id bigint, quality int"))

    def plain(text):
        raw, size = (text or "").encode(), [0, 0]
        for k, d in enumerate((m.good, m.bad)):
            for i in range(0, len(raw), Q.BLOCK):
                c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=m.level, write_checksum=False, write_content_size=False, write_dict_id=False)
                size[k] += len(c.compress(raw[i : i + Q.BLOCK]))
        x = ((size[1] - size[0]) / (len(raw) + Q.SMOOTH), min(size) / len(raw)) if raw else (0.0, 0.0)
        return 1 / (1 + math.exp(-(m.weights[0] * x[0] + m.weights[1] * x[1] + m.weights[2])))

    out = sorted((r.doc_id, round(r.score, 9)) for r in Q.score(docs, m).collect())
    assert out == sorted((i, round(plain(t), 9)) for i, t, _ in rows)


def test_rows_that_share_an_id_count_once(spark):
    docs = spark.createDataFrame([(1, "b" * 50), (1, "a" * 50), (2, "c" * 9000)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    assert sorted((v, t) for v, _, t in Q.sampled(docs, labels, "doc_id", "text", "quality", 10)) == [(0, "c" * 9000), (1, "a" * 50)]
