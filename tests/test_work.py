"""How often searches read the corpus, and what of it they shuffle."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodespark.functions import text as T
from lodespark.functions import words
from lodespark.operators import chunk, dense, evaluate, fuse, lexical
from lodespark.plans import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corpus(spark, n=40):
    return spark.createDataFrame([(i, f"the pump {i} heats {i % 7} rooms") for i in range(n)], "ord bigint, text string")


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


def test_postings_are_not_shuffled(spark):
    """F8: only the best of each task are dealt out, by query."""
    made = lexical.bm25(corpus(spark), asked(spark, "pump 3", "rooms"), 5)
    assert plan(made).count("Exchange") == 1 and "hashpartitioning(qid" in plan(made)
    assert [r.ord for r in made.where("qid = 0").orderBy("rank").collect()][:2] == [3, 10]


def test_words_of_a_task_are_those_of_the_expression(spark):
    rnd = random.Random(1)
    parts = ["Abc", "x9", "가나", "힣", "K", "İ", "ſ", "é", "\x00", " ", "\n", "_", "-", "ﬁ", "𝒜", "ㄱ"]
    rows = spark.createDataFrame([("".join(rnd.choices(parts, k=30)),) for _ in range(200)] + [("",)], "text string")
    for r in rows.select(F.col("text").cast("binary").alias("b"), T.words(F.col("text")).alias("w")).collect():
        assert T.word_list(bytes(r.b)) == r.w
    odd = spark.range(1).select(F.unhex(F.lit("41FF62E0")).alias("b"))
    assert T.word_list(bytes(odd.first().b)) == odd.select(T.words(F.col("b").cast("string"))).first()[0] == ["a", "b"]


def test_texts_of_the_best_are_read_without_a_shuffle(spark):
    """a few results are sent to the corpus."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        best = lexical.bm25(corpus(spark), asked(spark, "pump 3"), 5)
        made = fuse.with_payload(best, corpus(spark))
        assert "BroadcastHashJoin" in plan(made) and "SortMergeJoin" not in plan(made)
        assert made.count() == 5
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_vectors_are_taken_from_the_buffer():
    """F7"""
    import numpy as np

    column = pa.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], pa.list_(pa.float32()))
    assert dense.matrix_of(column.slice(1), np.array).tolist() == [[3, 4], [5, 6]]
    for odd in ([[1.0], [2.0, 3.0]], [[1.0], None], [[1.0, None], [2.0, 3.0]]):
        with pytest.raises(ValueError, match="one length"):
            dense.matrix_of(pa.array(odd, pa.list_(pa.float32())), np.array)


def test_each_ranking_is_made_once_for_all_modes(spark, monkeypatch):
    """F4"""
    calls = []
    for module, name in ((lexical, "query_terms"), (dense, "nearest")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name), name=name, **b: calls.append(name) or f(*a, **b))
    cases = spark.createDataFrame([(0, "pump 3 "), (1, "pump 99")], "qid bigint, gold string")
    made = evaluate.by_mode(corpus(spark), asked(spark, "pump 3", "rooms"), cases)
    assert sorted(calls) == ["nearest", "query_terms"]
    got = {r.mode: r for r in made.collect()}
    assert set(got) == {"hybrid", "dense", "bm25"} and got["bm25"].n_cases == 2
    for mode, row in got.items():
        one = evaluate.metrics(evaluate.first_hits(cases, fuse.with_payload(fuse.search(corpus(spark), asked(spark, "pump 3", "rooms"), evaluate.MRR_DEPTH, mode, with_ranks=False), corpus(spark)))).first()
        assert tuple(row)[1:] == tuple(one)


def test_all_postings_without_a_shuffle(spark):
    """F3"""
    made = lexical.all_postings(corpus(spark))
    assert "Exchange" not in plan(made)
    assert sorted(made.collect()) == sorted(lexical.postings(lexical.tokenized(corpus(spark))).select(made.columns).collect())
    spaced = lambda c: F.split(F.lower(c), " ")
    assert sorted(lexical.all_postings(corpus(spark), spaced).collect()) == sorted(lexical.postings(lexical.tokenized(corpus(spark), tokens=spaced)).select(made.columns).collect())
    assert sorted(lexical.lengths(corpus(spark)).collect()) == sorted(lexical.tokenized(corpus(spark)).select("ord", F.size("tokens").alias("dl")).collect())


@pytest.mark.parametrize("tables", [2, 9])
def test_a_file_of_one_row_group_is_dealt_out(spark, tmp_path, tables):
    """one of the parts that the file was cut into had all rows, so that one task did the whole search."""
    rnd = random.Random(6)
    rows = [(i, " ".join(f"{rnd.random():.9f}" for _ in range(20))) for i in range(3000)]
    os.mkdir(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}), tmp_path / "documents.parquet/one.parquet", use_dictionary=False)
    even = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(tables)
    even.write.parquet(f"{tmp_path}/even/documents.parquet")
    per = lambda d: [r["count"] for r in queries.corpus(spark, d).groupBy(F.spark_partition_id()).count().collect()]
    conf = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.maxPartitionBytes": "64k"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        assert queries.stored(spark, str(tmp_path)).rdd.getNumPartitions() > 4
        assert sum(per(str(tmp_path))) == 3000 and max(per(str(tmp_path))) < 1000
        assert sorted(map(tuple, queries.corpus(spark, str(tmp_path)).collect())) == rows
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
        assert ("Exchange" in plan(queries.corpus(spark, f"{tmp_path}/even"))) == (tables < 4)
        assert queries.corpus(spark, f"{tmp_path}/even").count() == 3000
    finally:
        for name in conf:
            spark.conf.unset(name)


def test_texts_of_the_best_are_not_dealt_out_with_the_corpus(spark, data, monkeypatch):
    """the stored documents are joined, which need no shuffle for that."""
    seen, payload = [], fuse.with_payload
    monkeypatch.setattr(fuse, "with_payload", lambda best, docs: seen.append(docs) or payload(best, docs))
    queries.retrieval_eval(spark, data), queries.retrieval_modes(spark, data), queries.rag_context(spark, data)
    assert len(seen) == 3 and not any("Exchange" in plan(docs) for docs in seen)


def test_words_of_many_texts_at_once_are_those_of_each(spark, monkeypatch):
    """each token was made as an object to be counted."""
    rnd = random.Random(7)
    parts = ["Abc", "x9", "가나", "힣", "K", "ſ", "é", "\x00", " ", "\n", "_", "ㄱ", "\ud7ff", "abcdefgh", "q", "一"]
    odd = [b"\x41\xff\x62\xe0", b"\xea", b"\xb0\x80a", b"\xea\xb0", b"\xed\x9e\xa4", b"\xed\xa0\x80x", b"\xf0\xea\xb0\x80", b"", b"A"]
    for _ in range(200):
        texts = pa.array([rnd.choice(odd) if rnd.random() < 0.3 else "".join(rnd.choices(parts, k=rnd.randrange(9))).encode() for _ in range(rnd.randrange(1, 12))], pa.binary())
        for column in (texts, texts.slice(2), texts.slice(0, 0)):
            w, own = words.Words(column), [T.word_list(x) for x in column.to_pylist()]
            toks = [tok for x in own for tok in x]
            assert np.diff(w.first).tolist() == [len(x) for x in own]
            assert [w.data[a:z].tobytes().decode() for a, z in zip(w.start, w.end, strict=True)] == toks
            known = [tok for tok in dict.fromkeys(toks) if rnd.random() < 0.5]
            assert words.Vocabulary(known).places(w).tolist() == [known.index(tok) if tok in known else -1 for tok in toks]
    docs, known = corpus(spark).unionByName(spark.createDataFrame([(90, None), (91, ""), (92, "Pump pump PUMP heats")], "ord bigint, text string")), ["heats", "pump", "none"]
    made = {}
    for name, tokens, cells in (("table", T.words, 4_000_000), ("sorted", T.words, 1), ("plain", lambda x: T.words(x), 1)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        made[name] = {r.ord: (r.dl, dict(zip(r.code, r.tf, strict=True))) for r in lexical.counted(docs, known, tokens).collect()}
    assert made["table"] == made["sorted"] == made["plain"] and len(made["plain"]) == 43
    assert made["table"][92] == (4, {0: 1, 1: 3}) and made["table"][90] == (0, {})


PARTS = ("a", "Bc d", ".", "!", "…", "。", " ", "\n", "\r\n", "\x85", "\x1c", "\x1f", "\u3000", "\u2028", "# ", "## T", "#", "\t", "가나", "x" * 40)


def test_a_task_holds_few_chunks_and_finds_those_of_the_expressions(spark, monkeypatch):
    """chunks are given up as they come, and only texts are sent to the function."""
    rnd = random.Random(5)
    texts = [None, "", "# only", *("".join(rnd.choices(PARTS, k=rnd.randrange(80))) for _ in range(300))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    want = []
    for r in docs.select("doc_id", F.transform(T.sections(F.coalesce("text", F.lit(""))), lambda s: F.struct(s["title"].alias("title"), T.sentences(s["body"]).alias("s"))).alias("parts")).collect():
        bodies = [(p.title, f"[{p.title}] " if p.title else "", p.s) for p in r.parts]
        made = [(t, pre + b) for t, pre, s in bodies for b in chunk.packed(s, max(50 - len(pre), chunk.LEAST_BODY), 20)]
        want += [(r.doc_id, i, t, x) for i, (t, x) in enumerate(made)]
    for held in (1 << 19, 1):
        monkeypatch.setattr(chunk, "HELD", held)
        assert sorted(map(tuple, chunk.chunk(docs, 50, 20).collect())) == sorted(want)
    assert "split" not in plan(chunk.chunk(docs))


def test_pairs_are_in_as_many_files_as_the_input_has_parts(spark, tmp_path, monkeypatch):
    """four files held a quarter of all answers each, whatever the size."""
    spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id bigint, text string").repartition(9).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        seen, write = [], queries.files.write_jsonl
        monkeypatch.setattr(queries.files, "write_jsonl", lambda df, path, **b: seen.append(df.rdd.getNumPartitions()) or write(df, path, **b))
        rows = queries.paired_predictions(spark, str(tmp_path)).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert seen == [9, 9] and [(r.row_id, r.doc_id) for r in rows] == [(i, i) for i in range(200)]


def test_an_index_makes_its_rows_once(spark, tmp_path, monkeypatch):
    """texts are chunked and tokenised once for each table, not again to count or to sample them."""
    from lodespark.sources import index

    seen = spark.sparkContext.accumulator(0)

    def chunked(docs, *more, f=index.C.chunk):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch

        made = f(docs, *more)
        return made.mapInArrow(run, made.schema)

    monkeypatch.setattr(index.C, "chunk", chunked)
    one = index.Index(spark, str(tmp_path / "i"))
    assert one.add(corpus(spark).select(F.col("ord").alias("doc_id"), "text")) == 40 == seen.value
    assert [r.dl for r in one.chunks().collect()] == [6] * 40 and one.batches()[0]["n_tokens"] == 240
    assert [r.ord for r in one.search(asked(spark, "pump 3"), 3, "bm25").select(F.col("doc_id").cast("int").alias("ord"), "rank").orderBy("rank").collect()][:1] == [3]
