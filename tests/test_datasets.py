"""Grading, validation, splits, chat rows, masks and padding."""

import pytest
from pyspark.sql import functions as F

from lodespark.operators import grade as G
from lodespark.operators import sft as S


def graded(spark, rows):
    return G.grade(spark.createDataFrame(rows, "answer string, n_chunks int, gold array<string>, kind string")).collect()


def test_grades(spark):
    out = graded(spark, [("18 [1]", 2, ["18"], "answerable"), ("18 [3]", 2, ["19"], None), ("none", 2, [], "answerable"), ("찾을 수 없습니다", 2, None, "unanswerable"), ("찾을 수 없습니다 [1]", 2, ["1"], "answerable"), (None, 1, None, "unanswerable"), ("[99999999999999999999]", 1, None, None)])
    cols = ("refused", "has_cite", "cite_valid", "refusal_correct", "false_refusal", "grounded")
    assert [tuple(r[c] for c in cols) for r in out] == [
        (False, True, True, None, False, True), (False, True, False, None, False, False), (False, False, False, None, False, None), (True, False, False, True, None, None),
        (True, True, True, None, True, True), (False, False, False, False, None, None), (False, True, False, None, False, None),
    ]


def test_gold_as_prediction_is_perfect(spark):
    rows = [("the value is 18 [1]", 1, ["18"], "answerable"), ("yes [1]", 1, [], "answerable"), (G.REFUSALS[0], 1, None, "unanswerable")]
    s = G.summarize(G.grade(spark.createDataFrame(rows, "answer string, n_chunks int, gold array<string>, kind string"))).first()
    assert tuple(s) == (2, 1, 1, 1.0, 1.0, 1.0, 0.0, 1.0)


def test_published_counts_give_published_rates(spark):
    """Counts of the published before and after grading and the rates they must give."""
    rows = spark.createDataFrame([("cite_rate", 6, 36, 0.1667), ("valid", 5, 6, 0.8333), ("grounded", 14, 24, 0.5833), ("after", 20, 24, 0.8333), ("recall", 4, 9, 0.4444), ("false", 2, 38, 0.0526), ("false after", 1, 38, 0.0263)], "name string, hit int, n int, want double")
    each = rows.select("name", "want", F.explode(F.sequence(F.lit(1), "n")).alias("i"), "hit").select("name", "want", (F.col("i") <= F.col("hit")).cast("double").alias("x"))
    assert all(r.got == r.want for r in each.groupBy("name", "want").agg(F.bround(F.avg("x"), 4).alias("got")).collect())


def test_empty_rates_are_null(spark):
    s = G.summarize(G.grade(spark.createDataFrame([], "answer string, n_chunks int, gold array<string>, kind string"))).first()
    assert tuple(s) == (0, 0, 0, None, None, None, None, None)


def test_excerpts_and_predictions(spark):
    p = spark.createDataFrame([("[1] a\n\n[2] b\n\n질문: [9]?",), ("질문: x",)], "p string")
    assert [r[0] for r in p.select(G.excerpts(F.col("p"))).collect()] == [2, 1] and p.select(G.question_of(F.col("p"))).first()[0] == "[9]?"
    chat = spark.createDataFrame([(0, [("system", "s"), ("user", "[1] a\n질문: q"), ("assistant", "x")], "answerable", ["a"])], "row_id bigint, messages array<struct<role:string,content:string>>, kind string, gold array<string>")
    assert G.graded_predictions(chat, spark.createDataFrame([(0, "a [1]")], "row_id bigint, answer string")).first().grounded
    with pytest.raises(ValueError):
        G.graded_predictions(chat, spark.createDataFrame([(1, "a")], "row_id bigint, answer string"))


def test_reject_reasons_in_order(spark):
    ok = "it is 24 [1]"
    rows = [("", ok, "empty"), ("what is", " ", "empty"), ("why", ok, "question length"), ("w" * 121, ok, "question length"), ("what is it", "x" * 401, "answer too long"), ("what is it", "24", "no citation"), ("what is it", "24 [1] [2]", "citation of no excerpt"), ("what is it", S.REFUSAL + " [1]", "refusal"), ("what is it", "25 [1]", "number not in chunk(25)"), ("what is it", "2 [1]", None), ("what is it", ok, None)]
    df = spark.createDataFrame([(q, a, w, "Keep 18 to 24") for q, a, w in rows], "q string, a string, w string, c string")
    out = df.select("w", S.reject_reason(F.col("q"), F.col("a"), F.col("c")).alias("reason"))
    assert all(r.reason == r.w for r in out.collect())
    assert {r.reason: r.n for r in S.reject_tally(out).collect()}["number not in chunk"] == 1


def test_split_keeps_units_whole_and_apart(spark):
    rows = S.split(spark.range(2000).withColumn("unit", F.col("id") % 400), "unit")
    assert rows.groupBy("unit").agg(F.countDistinct("is_eval").alias("n")).where("n > 1").count() == 0
    assert 0.1 < rows.select(F.avg(F.col("is_eval").cast("double"))).first()[0] < 0.3


def test_unanswerable(spark):
    assert S.unanswerable_count(38) == 9 and S.unanswerable_count(0) == 0
    chunks = spark.createDataFrame([(d, i, f"Topic {d}{i}\nbody") for d in "abcde" for i in range(3)], "doc_id string, chunk_id int, text string")
    rows = S.unanswerable(chunks, 4).collect()
    assert len(rows) == 4 and all(r.doc_id != r.context_doc and r.doc_id in r.question and all(r.context_doc in c for c in r.context) and len(r.context) == 2 for r in rows)
    assert S.unanswerable(chunks.where("doc_id = 'a'"), 4).count() == 0


def test_unanswerable_goes_round_until_enough(spark):
    chunks = spark.createDataFrame([(d, 0, f"Topic {d}") for d in "abc"] + [("d", 0, " ")], "doc_id string, chunk_id int, text string")
    rows = [(r.doc_id, r.context_doc) for r in S.unanswerable(chunks, 8).collect()]
    assert len(rows) == 8 and len(set(rows)) == 8 and all(a != b and a != "d" for a, b in rows)
    assert S.unanswerable(chunks, 0).count() == 0 and S.unanswerable(chunks.limit(0), 3).count() == 0


def test_build(spark, tmp_path):
    """Against a plain count: each chunk's valid pairs in one set only, and a fifth of each set unanswerable from its own chunks."""
    reply = '[{"question": "what is it", "answer": "it is %d [1]"}, {"question": "why", "answer": "x [1]"}, {"question": "and what now", "answer": "it is 5555 [1]"}]'
    rows = [(f"doc{i % 10}", i, f"Topic {i}\nkeep {i}", None if i == 3 else "no array" if i == 4 else reply % i) for i in range(60)]
    replies = spark.createDataFrame(rows, "doc_id string, chunk_id int, text string, reply string")
    out = S.build(replies).collect()
    good = [r for r in out if r.kind == "answerable"]
    assert sorted(r.chunk_id for r in good) == [i for i in range(60) if i not in (3, 4)]
    assert all(r.gold == [str(r.chunk_id)] and r.context == [f"Topic {r.chunk_id}\nkeep {r.chunk_id}"] for r in good)
    held = {r.chunk_id for r in S.held_out(replies).collect()}
    assert len(held) == 12 and {r.chunk_id for r in good if r.is_eval} == held - {3, 4}
    of = {f"Topic {i}\nkeep {i}": i for i in range(60)}
    for is_eval in (False, True):
        n = sum(r.is_eval == is_eval for r in good)
        none = [r for r in out if r.kind == "unanswerable" and r.is_eval == is_eval]
        assert len(none) == S.unanswerable_count(n) and all((of[c] in held) == is_eval for r in none for c in r.context) and all(r.answer == S.REFUSAL for r in none)
    tally = {r.reason: r.n for r in S.reject_tally(S.pairs(replies)).collect()}
    assert tally == {"question length": 58, "number not in chunk": 58}
    S.write_sets(S.build(replies), f"{tmp_path}/train", f"{tmp_path}/eval")
    train, test = spark.read.json(f"{tmp_path}/train"), spark.read.json(f"{tmp_path}/eval")
    kinds = {r.is_eval: r for r in S.by_kind(S.build(replies)).collect()}
    assert train.count() == kinds[False].n and test.where("gold is not null").count() == kinds[True].n_answerable and "gold" not in train.columns


def test_build_of_nothing_and_of_one(spark):
    kind = "doc_id string, chunk_id int, text string, reply string"
    assert S.build(spark.createDataFrame([], kind)).count() == 0
    one = S.build(spark.createDataFrame([("a", 0, "x", '[{"question": "what is it", "answer": "so [1]"}]')], kind)).collect()
    assert [(r.kind, r.is_eval, r.gold) for r in one] == [("answerable", True, [])]


def test_taught_by_a_generator(spark):
    chunks = spark.createDataFrame([("a", 0, "keep 24"), ("a", 1, None)], "doc_id string, chunk_id int, text string")
    echo = lambda rows: rows.withColumn("answer", F.substring_index(F.col("messages")[0]["content"], "\n", -1))
    assert [r.reply for r in S.taught(chunks, echo).orderBy("chunk_id").collect()] == ["keep 24", ""]


def test_token_ids_and_batches(spark):
    import numpy as np

    assert all(S.token_ids(x) == [1, 2] for x in ([1, 2], [[1, 2]], {"input_ids": [1, 2]}, {"input_ids": [[1, 2]]}, np.array([1, 2]), np.array([[1, 2]]))) and S.token_ids([]) == []
    rows = S.batched(spark.range(100).select((F.col("id") * 1000).alias("id")), 16, "id").collect()
    assert all(r.batch == r.id // 16000 for r in rows) and S.batched(spark.range(0), 16, "id").count() == 0


def test_results_as_json(spark, tmp_path):
    import json

    from lodespark.sources import results

    chat = spark.createDataFrame([(0, [("system", "s"), ("user", "[1] a\n질문: q?"), ("assistant", "x")], None, ["a"])], "row_id bigint, messages array<struct<role:string,content:string>>, kind string, gold array<string>")
    results.write_grades(G.graded_predictions(chat, spark.createDataFrame([(0, "a [1]")], "row_id bigint, answer string")), f"{tmp_path}/g", "base")
    head, sample = (json.loads(spark.read.text(f"{tmp_path}/g/{x}").first()[0]) for x in ("summary", "samples"))
    assert head["label"] == "base" and head["model"] is None and head["summary"]["cite_rate"] == 1.0 and head["summary"]["refusal_recall"] is None
    assert sample["question"] == "q?" and sample["kind"] == "answerable" and sample["grounded"] is True
    levels = spark.createDataFrame([(1.0, 4, None), (2.0, 1, 3)], "wall_s double, concurrency int, ttft_p50_ms int")
    text = results.bench_result(levels, {"api_key": "sk-1", "model": "m"}, {"gpu": None}).first().value
    made = json.loads(text)
    assert "sk-1" not in text and made["config"] == {"model": "m"} and made["environment"] == {"gpu": None} and [r["concurrency"] for r in made["results"]] == [1, 4] and made["results"][1]["ttft_p50_ms"] is None


def test_chat_rows(spark):
    df = spark.createDataFrame([("q?", ["x", "y"], "a [1]", "answerable", []), ("q?", ["x"], "a", "k", ["1"])], "question string, context array<string>, answer string, kind string, gold array<string>")
    a, b = S.chat_rows(df, with_gold=True).collect()
    assert [m.role for m in a.messages] == ["system", "user", "assistant"] and "[1] x\n\n[2] y\n\n질문: q?" in a.messages[1].content and a.gold is None and b.gold == ["1"]
    assert S.chat_rows(df).where("gold is not null").count() == 0


def test_labels_truncation_and_padding(spark):
    df = spark.createDataFrame([(0, list(range(1, 31)), [7, 8, 0]), (0, [1], [2, 0])], "batch int, p array<int>, a array<int>")
    rows = df.select("batch", S.labelled(F.col("p"), F.col("a"), 20).alias("x")).select("batch", "x.*")
    long, short = sorted(rows.collect(), key=lambda r: -len(r.input_ids))
    assert len(long.input_ids) == 20 and long.input_ids[-3:] == long.labels[-3:] == [7, 8, 0] and set(long.labels[:-3]) == {-100} and short.labels == [-100, 2, 0]
    made = {len([x for x in r.attention if x]): r for r in S.collate(rows).collect()}
    assert made[3].input_ids == [1, 2, 0] + [0] * 17 and made[3].labels[3:] == [-100] * 17 and made[3].attention == [1] * 3 + [0] * 17


def test_counts_of_what_truncation_leaves_out(spark):
    rows = spark.createDataFrame([([1, 2, 3], [4, 5]), ([1], [2, 3]), ([1, 2, 3, 4, 5], []), ([], [1, 2, 3, 4, 5, 6])], "prompt array<int>, answer array<int>")
    assert tuple(S.encoding_counts(rows, 4).first()) == (4, 3, 1, 2 + 2 + 0 + 4)
    assert tuple(S.encoding_counts(rows.limit(0), 4).first()) == (0, 0, 0, 0)
