"""Columns of any name pass through."""

from pyspark.sql import functions as F

from lodespark.llm import line_dedup, quality, token_counts


def frame(spark):
    return spark.createDataFrame([(1, "some text. and more.\nlines", 5), (2, None, 6)], "doc_id bigint, text string, `a.b` int").withColumn("`x", F.lit("y")).withColumnRenamed("`x", "c.d.e")


def test_dotted_columns_stay(spark):
    docs = frame(spark)
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, quality int")
    made = {
        "quality": quality.with_score(docs, quality.train(docs, labels)),
        "tokens": token_counts.count_tokens(docs, *token_counts.gpt_like(), keep_text=True),
        "lines": line_dedup.deduplicate_lines(docs, passages=True),
    }
    for name, out in made.items():
        rows = out.collect()
        assert {"a.b", "c.d.e"} <= set(out.columns), name
        assert sorted(r["a.b"] for r in rows) == [5, 6], name


def test_dictionaries_hold_whole_texts_or_choose_from_all():
    few = [bytes([65 + i]) * 900 for i in range(20)]
    assert quality.dictionary(few) == b"".join(few)
    import random

    rnd = random.Random(1)
    words = [bytes(rnd.choices(b"abcdefgh", k=6)) for _ in range(400)]
    middle = [b" ".join(rnd.choices(words, k=120)) for _ in range(280)]  # more than a dictionary, less than four
    total = sum(map(len, middle))
    assert quality.DICT_BYTES < total < 4 * quality.DICT_BYTES
    made = quality.dictionary(middle)
    assert 0 < len(made) <= quality.DICT_BYTES and made != b"".join(middle)[-quality.DICT_BYTES :]
