"""Index, engine, prompts, event rows, serving figures, sources, streaming ingest, settings and the command line."""

import json
import os
from base64 import b64decode
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from lodespark import cli, schemas
from lodespark.functions import registry
from lodespark.operators import chunk as C
from lodespark.operators import lexical, prompt, serving, validate
from lodespark.plans.engine import Engine
from lodespark.settings import Settings, load
from lodespark.sources import chat, files
from lodespark.sources.index import Index, health, source_json
from lodespark.streaming.ingest import ingest_files

CONF = Settings(chunk_size=200, chunk_overlap=50, top_k=3)
GUIDE = "# Guide\nIntro line.\n\n## Heat\nKeep 18 to 24 degrees. Vent above 30! Log daily.\n\n## Water\nTarget 1.8 to 2.2."


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "qid bigint, text string")


def test_engine_ingests_searches_and_asks(spark, tmp_path):
    e = Engine(spark, CONF, str(tmp_path / "i"), chat.echo)
    assert e.ask(asked(spark, "early")).first().answer == prompt.NOTHING
    assert e.ingest_text("", "empty.md") == 0 and e.ingest_text(GUIDE, "guide.md") == 3
    with pytest.raises(ValueError, match="blank.md"):
        e.ingest_document(" \n", "blank.md")
    best = e.search(asked(spark, "when do I vent above 30?")).orderBy("rank").first()
    assert best.key == "guide.md#1" and best.section == "Heat" and best.dense_rank and best.bm25_rank == 1
    a = e.ask(asked(spark, "vent?")).first()
    assert a.answer == "vent? [1]" and a.messages[0].role == "system" and "[1] (source: guide.md#" in a.messages[1].content and a.messages[1].content.endswith("질문: vent?")
    rows = e.ask_events(asked(spark, "vent?", "water target"))
    assert rows.orderBy("req_id", "seq").first().event == "sources" and all(r.ok for r in prompt.well_formed(rows).collect())
    again = Engine(spark, CONF, str(tmp_path / "i"))
    assert health(again.index) == {"status": "ok", "chunks": 3}
    assert [r.key for r in again.search(asked(spark, "vent")).orderBy("rank").collect()] == [r.key for r in e.search(asked(spark, "vent")).orderBy("rank").collect()]


def test_index_appends_and_guards(spark, tmp_path):
    path = str(tmp_path / "i")
    one = Index(spark, path, size=60, overlap=0)
    docs = spark.createDataFrame([(f"d{i}", f"Sentence number {i} about pumps. Another one on valve {i}.") for i in range(7)], "doc_id string, text string")
    assert one.add(docs) == one.meta()["n"] == 7 and one.add(docs.where("doc_id = 'd3'")) == 1
    ords = sorted(r.ord for r in one.chunks().collect())
    assert ords == list(range(8)) and one.chunks().where("doc_id = 'd3'").count() == 2
    assert {r.doc_id for r in one.search(asked(spark, "valve 3"), 2, "bm25").collect()} == {"d3"}
    assert one.search(asked(spark, "zzz"), 3, "bm25").count() == 0 and one.search(asked(spark, "zzz"), 100).count() == 8
    with pytest.raises(ValueError, match="embedder"):
        Index(spark, path, embedder="bge-m3")
    row = one.search(asked(spark, "valve 3"), 1, "bm25", with_ranks=False).select(source_json(F.struct("key", "dense_rank"))).first()[0]
    assert json.loads(row) == {"key": json.loads(row)["key"], "dense_rank": None}


def test_a_batch_without_meta_is_not_read(spark, tmp_path):
    one = Index(spark, str(tmp_path / "i"))
    one.add(spark.createDataFrame([("a", "text one")], "doc_id string, text string"))
    os.makedirs(tmp_path / "i/chunks/batch=1")
    (tmp_path / "i/meta/_1").write_text("half of a r")
    assert one.chunks().count() == 1 and one.add(spark.createDataFrame([("b", "text two")], "doc_id string, text string")) == 1 and one.chunks().count() == 2


def test_streaming_ingest_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A\nalpha text")
    (tmp_path / "in/skip.bin").write_text("x")
    one = Index(spark, str(tmp_path / "i"))
    for name, n in ((None, 1), ("b.md", 2), (None, 2)):
        if name:
            (tmp_path / "in" / name).write_text("beta text")
        ingest_files(spark, str(tmp_path / "in"), one, str(tmp_path / "cp")).awaitTermination(120)
        assert one.meta()["n"] == n


def test_writers_at_once_keep_all(spark, tmp_path):
    """Four writers of two batches of three documents: no error, 24 chunks, each numbered once and found by its own words."""
    one = Index(spark, str(tmp_path / "i"))

    def write(w: int) -> None:
        for b in range(2):
            one.add(spark.createDataFrame([(f"w{w}b{b}d{d}", f"word{w}x{b}x{d} text") for d in range(3)], "doc_id string, text string"))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    found = one.chunks().collect()
    assert sorted(r.ord for r in found) == list(range(24)) and len({r.doc_id for r in found}) == 24 and one.meta() == {"embedder": "hash", "dim": 512, "tokenizer": "words", "n": 24, "batches": 8}
    out = one.search(asked(spark, "word3x1x2", "word0x0x1"), 1, "bm25").collect()
    assert {r.qid: r.doc_id for r in out} == {0: "w3b1d2", 1: "w0b0d1"}


def test_a_batch_of_the_stream_run_again_is_not_added(spark, tmp_path):
    one = Index(spark, str(tmp_path / "i"))
    docs = spark.createDataFrame([("a", "text one")], "doc_id string, text string")
    assert [one.add(docs, "s#0"), one.add(docs, "s#0"), one.add(docs, "s#1")] == [1, 0, 1] and one.meta()["n"] == 2


def test_a_search_by_few_words_filters_the_postings(spark, tmp_path):
    one = Index(spark, str(tmp_path / "i"))
    one.add(spark.createDataFrame([("a", "alpha beta gamma")], "doc_id string, text string"))
    plan = one.wanted_postings(lexical.query_terms(asked(spark, "beta")))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tok,beta)" in plan or "In(tok" in plan


def test_failed_stream_has_an_error_and_no_done(spark):
    rows = spark.createDataFrame([(1, ["a", "b"], ["k"], None), (2, ["a"], ["k"], "lost")], "req_id bigint, deltas array<string>, sources array<string>, error string")
    out = prompt.events(rows)
    assert [r.event for r in out.where("req_id = 2").orderBy("seq").collect()] == ["sources", "token", "error"] and all(r.ok for r in prompt.well_formed(out).collect())
    assert not prompt.well_formed(out.where("event <> 'done'")).where("req_id = 1").first().ok
    assert prompt.framed(out).where("req_id = 1 and seq = 1").first().frame == 'event: token\ndata: {"text":"a"}\n\n'


def test_serving_figures(spark):
    rows = spark.createDataFrame([(1, True, 0.1, 1.0, 10, None, 10.0), (1, True, 0.0, 2.0, 0, None, 10.0), (1, False, 0.0, 0.0, 0, "x", 10.0), (4, False, 0.0, 0.0, 0, "x", 2.0), (8, True, 0.2, 0.4, 1, None, 1.0)], schemas.REQUEST_RESULT.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", wall double")
    out = {r.concurrency: r for r in serving.summary(rows).collect()}
    assert (out[1].n_ok, out[1].n_failed, out[1].req_per_s, out[1].tok_per_s, out[1].ttft_p50_ms, out[1].ttft_p95_ms, out[1].tpot_p50_ms) == (2, 1, 0.2, 1.0, 50.0, 95.0, 100.0)
    assert out[4].latency_p50_s is None and out[4].tok_per_s == 0 and out[8].tpot_p50_ms is None and out[8].latency_p95_s == 0.4
    assert spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 10.0)], "x double").select(F.percentile("x", 0.95)).first()[0] == pytest.approx(9.1)
    deltas = spark.createDataFrame([(1, 0.12, "", None), (1, 0.15, "ep", None), (1, 0.3, "x", None), (2, 0.5, None, 7), (3, 0.4, None, None)], "req_id bigint, t double, delta string, usage_tokens bigint")
    assert [tuple(r) for r in serving.measured(deltas).orderBy("req_id").collect()] == [(1, 0.15, 0.3, 2), (2, 0.0, 0.5, 7), (3, 0.0, 0.4, 0)]
    turn = serving.prompts_for(spark.range(5).withColumnRenamed("id", "i"), spark.createDataFrame([(0, "a"), (1, "b")], "n bigint, prompt string"), 2)
    assert [r.prompt for r in turn.orderBy("i").collect()] == list("ababa")


def test_requests(spark):
    rows = spark.createDataFrame([("q", 5, "dense"), ("", 5, "dense"), (None, 5, None), ("q", 0, "dense"), ("q", 51, None), ("q", None, "fuzzy"), ("q", None, None)], "query string, top_k int, mode string")
    good, bad = validate.parted(rows)
    assert good.count() == 2 and sorted(r.problem for r in bad.collect()) == ["mode", "query", "query", "top_k", "top_k"]
    assert [r[0] for r in spark.createDataFrame([(0,), (None,), (7,)], "k int").select(validate.top_k_or_default(F.col("k"), 5)).collect()] == [5, 5, 7]


def test_file_sources(spark, tmp_path):
    for name, data in (("b.md", b"beta"), ("a.md", "알파\n둘".encode()), ("c.txt", b"gamma"), ("d.md", b"\xff\xfe"), ("e.png", b"png")):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/x.md").write_text("inner")
    assert [(r.doc_id, r.text) for r in files.text_files(spark, str(tmp_path), "[ab].md", stem=True).collect()] == [("a", "알파\n둘"), ("b", "beta")]
    assert {r.filename: r.status for r in files.uploads(spark, str(tmp_path)).collect()} == {"a.md": 200, "b.md": 200, "c.txt": 200, "d.md": 422, "e.png": 415}
    image = files.image_requests(files.image_files(spark, str(tmp_path / "e.png"))).first()
    assert image.messages[0].content[0].image_url.url == "data:image/png;base64,cG5n" and image.messages[0].content[1].text == files.PARSE_PROMPT
    docs = spark.createDataFrame([("x.pdf", b"one|two|three")], "filename string, content binary")
    made = files.pages(docs, lambda b: b.split(b"|")).withColumn("answer", F.upper(F.col("content").cast("string")))
    assert files.joined_pages(made).first().text == "ONE\n\n---\n\nTWO\n\n---\n\nTHREE"
    assert files.write_text(files.joined_pages(made), str(tmp_path / "out")).first().name == "x_parsed.md"


def test_images_become_markdown(spark, tmp_path, capsys):
    docs = spark.createDataFrame([("x.pdf", bytearray(b"one|two")), ("empty.pdf", bytearray(b""))], "filename string, content binary")
    pages = files.pages(docs, lambda b: b.split(b"|") if b else [])
    read = lambda b: f"{b.get('temperature')} {b['max_tokens']} {b64decode(b['messages'][0]['content'][0]['image_url']['url'].partition(',')[2]).decode()}"
    made = files.parsed(pages, chat.generator(Settings(vlm_temperature=None, vlm_max_tokens=7), read, vision=True)).collect()
    assert [(r.filename, r.text) for r in made] == [("x.pdf", "None 7 one\n\n---\n\nNone 7 two")]  # a document without pages gives none
    (tmp_path / "scan.png").write_bytes(b"three")
    assert cli.main(["parse", str(tmp_path / "scan.png")], spark, chat.generator(Settings(), read, vision=True)) == 0
    assert (tmp_path / "scan_parsed.md").read_text() == "0.0 4096 three"
    assert cli.main(["parse", str(tmp_path / "none.png")], spark) == 1


def test_jsonl(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"question": "q", "gold": "g"}\n\n{"question": "한", "gold": null}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "e.jsonl"), schemas.EVAL_CASE)
    assert [tuple(r) for r in rows.collect()] == [("q", "g"), ("한", None)]
    files.write_jsonl(rows.coalesce(1), str(tmp_path / "o"))
    text = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "o").glob("part-*"))
    assert text.splitlines() == ['{"question":"q","gold":"g"}', '{"question":"한"}']
    with pytest.raises(Exception):
        (tmp_path / "bad.jsonl").write_text("{broken\n")
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), schemas.EVAL_CASE, strict=True).collect()


def test_chat_connector(spark):
    body = chat.payload([{"role": "user", "content": "x"}], Settings(llm_temperature=None, llm_model="m"))
    assert body == {"model": "m", "messages": [{"role": "user", "content": "x"}], "max_tokens": 1024}
    rows = asked(spark, "x").select("qid", prompt.messages(F.col("text")).alias("messages"))
    out = chat.generator(Settings(llm_model="m"), lambda b: b["model"] + b["messages"][-1]["content"])(rows).first()
    assert out.answer == "mx" and out.messages[1].content == "x"


def test_plugged_in_tokenizer_and_model(spark):
    toks = registry.morphemes(lambda: lambda t: [(w, "NNG" if w[0] != "-" else "JX") for w in t.split()])
    df = asked(spark, "Heat -pump", None)
    assert [r[0] for r in df.select(toks(F.col("text"))).collect()] == [["heat"], []]
    vectors = registry.model_embedder(lambda: lambda texts: [[len(t), 0.0] for t in texts])(df).collect()
    assert [r.embedding for r in vectors] == [[1.0, 0.0], [0.0, 0.0]]
    assert registry.tokenizer("words") and registry.embedder("hash")
    with pytest.raises(ValueError):
        registry.tokenizer("odd")


def test_settings(tmp_path):
    assert load({}).chunk_size == 600 and load({"LODESPARK_LLM_TEMPERATURE": "  "}).llm_temperature is None and load({"LODESPARK_LLM_TEMPERATURE": "0"}).llm_temperature == 0.0
    (tmp_path / ".env").write_text("# c\nLODESPARK_TOP_K=7\nOTHER=1\nLODESPARK_EMBEDDER='bge-m3'\n")
    s = load({"LODESPARK_TOP_K": "8"}, str(tmp_path / ".env"))
    assert (s.top_k, s.embedder) == (8, "bge-m3")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "guide.md").write_text(GUIDE)
    assert cli.main(["ingest", str(tmp_path / "none.md")], spark) == 1
    assert cli.main(["ingest", str(tmp_path / "guide.md"), "--index-dir", str(tmp_path / "i")], spark) == 0
    assert cli.main(["search", "vent above", "--index-dir", str(tmp_path / "i"), "--top-k", "1"], spark) == 0
    out = capsys.readouterr().out
    assert "3 chunks" in out and "1. guide.md#1 score=0.0328" in out


def test_chunks_keep_their_meta_in_json_lines(spark, tmp_path):
    made = C.chunk(spark.createDataFrame([("g.md", GUIDE)], "doc_id string, text string")).withColumn("meta", F.create_map(F.lit("lang"), F.lit("en"), F.lit("쪽"), F.col("chunk_id").cast("string")))
    made = made.select(*schemas.CHUNK.names).union(spark.createDataFrame([("e", 0, "no meta\n\"x\"", "", {})], schemas.CHUNK))
    files.write_jsonl(made, str(tmp_path / "chunks"))
    back = files.read_jsonl(spark, str(tmp_path / "chunks"), schemas.CHUNK, strict=True)
    order = lambda df: sorted(df.collect(), key=lambda r: (r.doc_id, r.chunk_id))
    assert back.schema == schemas.CHUNK and order(back) == order(made)


def test_evaluate_command(spark, tmp_path, capsys):
    (tmp_path / "guide.md").write_text(GUIDE)
    (tmp_path / "cases.jsonl").write_text('{"question": "vent above", "gold": "Vent above"}\n\n{"question": "nothing", "gold": "no such text"}\n')
    assert cli.main(["evaluate", str(tmp_path / "guide.md"), str(tmp_path / "none")], spark) == 1
    assert cli.main(["evaluate", str(tmp_path / "guide.md"), str(tmp_path / "cases.jsonl")], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0] == "| mode | hit_1 | hit_3 | hit_5 | mrr |" and [x.split("|")[1].strip() for x in out[2:]] == ["bm25", "dense", "hybrid"] and out[2] == "| bm25 | 0.500 | 0.500 | 0.500 | 0.500 |"


def test_parse_command_reads_a_pdf(spark, tmp_path):
    (tmp_path / "report.pdf").write_bytes(b"one|two")
    answered = lambda rows: rows.select("filename", "page", F.concat(F.lit("page "), "page").alias("answer"))
    assert cli.main(["parse", str(tmp_path / "report.pdf"), "--out", str(tmp_path / "r.md")], spark, answered, lambda b: b.split(b"|")) == 0
    assert (tmp_path / "r.md").read_text() == "page 0\n\n---\n\npage 1"
    with pytest.raises(ValueError, match="needs"):
        cli.main(["parse", str(tmp_path / "report.pdf")], spark, answered)


def test_entry_registers_all_queries(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0


def test_library_does_not_need_llm():
    """Nothing outside the subpackage imports it."""
    import pathlib

    root = pathlib.Path(cli.__file__).parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.relative_to(root).parts and ("lodespark.llm" in p.read_text() or "from .llm" in p.read_text() or "from ..llm" in p.read_text())]


def test_index_embeds_by_the_name_it_has(spark, tmp_path, monkeypatch):
    own = registry.model_embedder(lambda: lambda texts: [[1.0, 0.0] if "x" in t else [0.0, 1.0] for t in texts])
    monkeypatch.setattr(registry, "embedder", lambda name: {"two": own}[name])
    docs = spark.createDataFrame([("a", "x x x"), ("b", "y y y")], "doc_id string, text string")
    index = Index(spark, str(tmp_path / "two"), embedder="two", dim=2)
    assert index.add(docs) == 2
    assert sorted(r.embedding for r in index.embeddings().collect()) == [[0.0, 1.0], [1.0, 0.0]]
    queries = spark.createDataFrame([(1, "about x")], "qid bigint, text string")
    assert index.search(queries, 1, "dense").first().doc_id == "a"
    with pytest.raises(Exception, match="gave 2 numbers"):
        Index(spark, str(tmp_path / "three"), embedder="two", dim=3).add(docs)
