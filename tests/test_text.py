"""Text functions on edge cases: other scripts, all line breaks, odd white space."""

import re

import pytest
from pyspark.sql import functions as F

from lodespark.functions import text as T
from lodespark.functions import vectors as V
from lodespark.functions import wire


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("text", ["", "a", "a\n", "a\r\nb\x0bc\x0cd\x1ce\x85f g ", "\n\n", "x\n\ny"])
def test_lines(spark, text):
    assert one(spark, T.lines, text) == text.splitlines()


@pytest.mark.parametrize("text", ["", "  a b  　", " x\x1f\x1c", "\t\n", "😀 "])
def test_strip(spark, text):
    assert one(spark, T.strip, text) == text.strip()


@pytest.mark.parametrize("text", ["Keep 1.8 to 2.2. Vent! Log… daily。　다음 문장. end", "one\ntwo", "", "a.b.c", "No end", "a?  b"])
def test_sentences(spark, text):
    want = [s.strip() for line in text.splitlines() for s in re.split(r"(?<=[.!?…。])\s+", line.strip()) if s.strip()]
    assert one(spark, T.sentences, text) == want


def test_words(spark):
    assert one(spark, T.words, "PLC-3 온도를 Ünder, 28도!") == ["plc", "3", "온도를", "nder", "28도"]
    assert one(spark, T.words, "…!") == []


def test_sections(spark):
    text = "before\n# One\nbody a\nbody b\n#no heading\n\n## Empty\n### Deep  \nx\n####### seven\n"
    assert [tuple(s) for s in one(spark, T.sections, text)] == [("", "before"), ("One", "body a\nbody b\n#no heading"), ("Deep", "x\n####### seven")]
    assert one(spark, T.sections, "") == one(spark, T.sections, "\n \n") == [] and [tuple(s) for s in one(spark, T.sections, "# T\nb")] == [("T", "b")]


def test_citations_and_numbers(spark):
    assert one(spark, T.citations, "a [1] b [22] [x] [99999999999999999999]") == [1, 22, None]
    assert one(spark, T.numbers, "18 to 24.5 [1] and 1,000") == ["18", "24.5", "1,000"]


def test_slices_preview_first_line(spark):
    assert one(spark, lambda x: T.slices(x, 3), "abcdefg") == ["abc", "def", "g"] and one(spark, lambda x: T.slices(x, 3), "") == []
    assert one(spark, T.preview, "a\n" + "b" * 200) == "a " + "b" * 118 + "…" and one(spark, T.preview, "short") == "short"
    assert one(spark, T.first_line, "\n  Title here  \nrest") == "Title here" and one(spark, T.blank_to_null, " \t") is None


def test_json_objects(spark):
    assert one(spark, wire.json_objects, 'noise [{"a": 1}, 3, {"b": "한"}] more') == ['{"a":1}', '{"b":"한"}']
    assert one(spark, wire.json_objects, "[broken") == one(spark, wire.json_objects, "] [") == one(spark, wire.json_objects, "[{]") == []


def test_sse(spark):
    body = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\n: ping\ndata: {"choices":[]}\ndata:{"choices":[{"delta":{"content":"b"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"c"}}]}\n\n'
    assert one(spark, wire.sse_deltas, body) == ["a", "b"] and one(spark, wire.sse_deltas, "") == []
    assert spark.range(1).select(wire.sse(F.lit("done"), F.lit("{}"))).first()[0] == "event: done\ndata: {}\n\n"


def test_media_types_and_uploads(spark):
    rows = spark.createDataFrame([("a.PNG", b"x"), ("b.jpeg", b"x"), ("c.bmp", b"x")], "n string, c binary")
    assert [r[0] for r in rows.select(wire.media_type(F.col("n"), strict=False)).collect()] == ["image/png", "image/jpeg", None]
    with pytest.raises(Exception, match="unsupported image"):
        rows.select(wire.media_type(F.col("n"))).collect()
    ups = spark.createDataFrame([("a.md", b"ok"), ("A.TXT", "é".encode()), ("a.pdf", b"x"), ("b.md", b"\xff\xfe")], "n string, c binary")
    assert [r[0] for r in ups.select(wire.upload_status(F.col("n"), F.col("c"))).collect()] == [200, 200, 415, 422]
    long = spark.createDataFrame([(b"x" * 100,)], "c binary").select(wire.data_url(F.col("c"), F.lit("image/png"))).first()[0]
    assert "\n" not in long and len(long) == len("data:image/png;base64,") + 136


def test_hash_vectors():
    assert V.buckets("온도를")[0] == 463 and V.buckets("abc")[0] == 267 and V.buckets("ABC")[0] == 267
    assert [len(V.buckets(t)) for t in ("", "a", "ab", "abc", "abcd", "😀가나다")] == [0, 1, 2, 1, 2, 2]
