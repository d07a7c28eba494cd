"""Chunks: sizes, overlap, forced splits, numbering; packing against the rules spelt out."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodespark.functions import tables
from lodespark.operators import chunk as C


def chunks(spark, text, size=600, overlap=120):
    return C.chunk(spark.createDataFrame([("d", text)], "doc_id string, text string"), size, overlap).orderBy("chunk_id").collect()


def test_sections_prefix_and_numbers(spark):
    found = chunks(spark, "intro\n# Heat\nKeep 18 to 24. Vent above 30!\n\n## Water\nTarget 1.8.")
    assert [(c.chunk_id, c.section, c.text) for c in found] == [(0, "", "intro"), (1, "Heat", "[Heat] Keep 18 to 24. Vent above 30!"), (2, "Water", "[Water] Target 1.8.")]


@pytest.mark.parametrize("text", ["", "\n\n \n", None, "# only\n## headings"])
def test_nothing(spark, text):
    assert chunks(spark, text) == []


def test_forced_split(spark):
    assert [len(c.text) for c in chunks(spark, "x" * 500, 100, 20)] == [100] * 5


def test_cap_and_overlap(spark):
    found = chunks(spark, "# " + "T" * 30 + "\n" + " ".join(f"This is sentence {i}." for i in range(100)), 100, 30)
    assert all(len(c.text) <= 100 for c in found) and [c.chunk_id for c in found] == list(range(len(found)))
    bodies = [c.text.split("] ", 1)[1] for c in found]
    assert all(b.split(". ")[0].rstrip(".") in a for a, b in zip(bodies, bodies[1:], strict=False))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=50), max_size=30), st.integers(16, 80), st.integers(0, 60))
def test_packing(sentences, budget, overlap):
    bodies = C.packed(sentences, budget, overlap)
    assert all(0 < len(b) <= budget for b in bodies)
    words = [w for b in bodies for w in b.split(" ")]
    flat = [s[i : i + budget] for s in sentences for i in range(0, len(s), budget)]
    at = 0
    for f in flat:  # all sentences, in order
        at = words.index(f, at)
    if overlap == 0:
        assert words == flat


def test_key(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(C.chunk_key(F.lit("a.md"), F.lit(3))).first()[0] == "a.md#3"


def test_many_documents_need_no_shuffle(spark):
    rnd = random.Random(1)
    docs = spark.createDataFrame([(str(i), " ".join(rnd.choices(["a.", "bb", "c!"], k=50))) for i in range(20)], "doc_id string, text string")
    plan = C.chunk(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


PARTS = ("a", "Bc d", ".", "!", "…", "。", " ", "\n", "\r\n", "\x85", "\x1c", "\x1f", "\u3000", "\u2028", "# ", "## T", "#", "#######", "\t", "가나", "x" * 40)


def test_table_function_equals_the_operator(spark):
    """chunk_text in SQL, on texts of odd white space, breaks and headings, null and empty ones too."""
    tables.register(spark)
    rnd = random.Random(3)
    texts = [None, "", "\n", "# only", *("".join(rnd.choices(PARTS, k=rnd.randrange(60))) for _ in range(400))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    made = spark.sql("select d.doc_id, c.* from {docs} d, lateral chunk_text(d.text, 50, 20) c", docs=docs)
    assert made.columns == ["doc_id", "chunk_id", "section", "text"]
    assert sorted(made.collect()) == sorted(C.chunk(docs, 50, 20).collect())
    assert spark.sql("select * from chunk_text('one. two.', null, null)").collect() == [(0, "", "one. two.")]
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_pages_by_lateral(spark):
    tables.register(spark, lambda b: b.split(b"|") if b else [])
    docs = spark.createDataFrame([("x", b"one|two"), ("y", b""), ("z", None)], "name string, content binary")
    rows = spark.sql("select d.name, p.page, p.content, p.media from {docs} d, lateral document_pages(d.content) p order by name, page", docs=docs).collect()
    assert [(r.name, r.page, bytes(r.content)) for r in rows] == [("x", 0, b"one"), ("x", 1, b"two")]  # no pages, no row
