"""Line numbers of files, pairing by place, a server that streams, and measurements over micro-batches."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodespark.operators import grade, prompt, serving
from lodespark.plans.engine import Engine
from lodespark.settings import Settings, load
from lodespark.sources import chat, files
from lodespark.streaming.measure import measured_stream


def test_lines_are_numbered_over_parts_and_files(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i * 37 % 50) for i in range(500)]
    folder = tmp_path / "f"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.txt").write_text("\n".join(x if i % 7 else f"\n{x}\n   " for i, x in enumerate(lines[k * 200 : k * 200 + 200])) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    try:
        made = files.numbered_lines(spark, str(folder))
        assert spark.read.text(str(folder)).select(F.col("_metadata.file_block_start")).distinct().count() > 5
        assert [(r.n, r.line) for r in made.orderBy("n").collect()] == list(enumerate(lines))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_predictions_are_paired_by_place(spark, tmp_path):
    row = lambda i: {"messages": [{"role": "user", "content": f"[1] text {i}\n\n질문: q{i}"}], "kind": "answerable", "gold": [str(i)]}
    (tmp_path / "rows.jsonl").write_text("\n".join(json.dumps(row(i), ensure_ascii=False) for i in range(4)) + "\n\n")
    (tmp_path / "answers.jsonl").write_text("\n".join(json.dumps({"answer": f"It is {i} [1]"}) for i in range(4)))
    (tmp_path / "fewer.jsonl").write_text('{"answer": "x"}\n')
    rows, answers, fewer = (files.numbered_lines(spark, str(tmp_path / f"{n}.jsonl")) for n in ("rows", "answers", "fewer"))
    made = grade.graded_files(rows, answers).orderBy("row_id").collect()
    assert [r.row_id for r in made] == list(range(4)) and all(r.grounded and r.cite_valid for r in made)
    with pytest.raises(ValueError, match="1 predictions for 4 rows"):
        grade.paired(rows, fewer)


class Server(BaseHTTPRequestHandler):
    bodies: list = []

    def log_message(self, *_):
        pass

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.bodies.append(body)
        last = body["messages"][-1]["content"]
        if "refuse" in last:
            self.send_error(503, "busy")
            return
        self.send_response(200)
        self.send_header("Content-Type", "text/event-stream")
        self.end_headers()
        say = lambda x: (self.wfile.write(b"data: " + (x if isinstance(x, bytes) else json.dumps(x).encode()) + b"\n\n"), self.wfile.flush())
        self.wfile.write(b": ping\n\n")
        say({"choices": []})
        for piece in ("One ", "two é", "\n[1]"):
            say({"choices": [{"delta": {"content": piece}}]})
            time.sleep(0.05)
            if "break" in last:
                say(b"{broken")
                return
        say({"choices": [{"delta": {}}], "usage": {"completion_tokens": 9}})
        say(b"[DONE]")


@pytest.fixture(scope="module")
def server():
    one = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=one.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{one.server_port}/v1"
    one.shutdown()


def test_deltas_as_the_server_sends_them(spark, server):
    ask = chat.streamer(Settings(llm_base_url=server, llm_model="m"))
    rows = spark.createDataFrame([(i, [{"role": "user", "content": t}]) for i, t in enumerate(["hello", "refuse this", "break off"])], "req_id bigint, messages array<struct<role:string,content:string>>")
    found = {}
    for r in ask(rows).orderBy("req_id", "seq").collect():
        found.setdefault(r.req_id, []).append(r)
    assert [r.delta for r in found[0]] == ["One ", "two é", "\n[1]", "", None] and found[0][3].usage_tokens == 9 and found[0][-1].error is None
    times = [r.t for r in found[0]]
    assert times == sorted(times) and times[2] - times[0] > 0.08  # not all at once
    assert len(found[1]) == 1 and "503" in found[1][0].error
    assert [r.delta for r in found[2]] == ["One ", None] and found[2][-1].error
    assert Server.bodies[0]["stream"] is True and Server.bodies[0]["model"] == "m"
    measured = {r.req_id: r for r in serving.measured(ask(rows).drop("error")).collect()}
    assert measured[0].num_tokens == 9 and 0 < measured[0].ttft < measured[0].latency


def test_ask_streams_real_deltas(spark, server, tmp_path):
    conf = load({"LODESPARK_INDEX_DIR": str(tmp_path / "i"), "LODESPARK_LLM_BASE_URL": server})
    engine = Engine(spark, conf, stream=chat.streamer(conf))
    engine.ingest_text("# Pumps\nA heat pump moves heat.", "pumps")
    out = engine.ask_events(spark.createDataFrame([(1, "heat pump"), (2, "refuse")], "qid bigint, text string")).collect()
    own = sorted((r.seq, r.event, r.data) for r in out if r.req_id == 1)
    assert [e for _, e, _ in own] == ["sources", "token", "token", "token", "done"] and json.loads(own[2][2]) == {"text": "two é"}
    assert json.loads(own[0][2])[0]["doc_id"] == "pumps"
    other = sorted((r.seq, r.event) for r in out if r.req_id == 2)
    assert [e for _, e in other] == ["sources", "error"]
    rows = spark.createDataFrame(out)
    assert all(r.ok for r in prompt.well_formed(rows).collect())
    empty = Engine(spark, load({"LODESPARK_INDEX_DIR": str(tmp_path / "none")}), stream=chat.streamer(conf))
    none = sorted((r.seq, r.event) for r in empty.ask_events(spark.createDataFrame([(1, "heat")], "qid bigint, text string")).collect())
    assert [e for _, e in none] == ["sources", "token", "done"]


def test_requests_are_measured_across_micro_batches(spark, tmp_path):
    """Deltas of four requests, cut into batches within requests; one breaks off, one never ends, one goes on after its end."""
    deltas = []
    for i in range(3):
        deltas += [(i, 0.1 * k + i, f"d{k}" if k else "", None, None) for k in range(5)]
        deltas.append((i, 0.6 + i, None, 7 if i == 1 else None, "lost" if i == 2 else None))
    deltas += [(3, 0.5, "x", None, None), (0, 9.0, "late", None, None), (0, 9.5, None, None, None)]
    schema = "req_id bigint, t double, delta string, usage_tokens bigint, error string"
    folder = tmp_path / "in"
    for at in range(0, len(deltas), 4):
        spark.createDataFrame(deltas[at : at + 4], schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = measured_stream(stream).writeStream.format("memory").queryName("measured").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(240)
    got = {r.req_id: r for r in spark.table("measured").collect()}
    want = {r.req_id: r for r in serving.measured(spark.createDataFrame(deltas[:18], schema).drop("error")).collect()}
    assert spark.table("measured").count() == 3 and sorted(got) == [0, 1, 2]
    for i in range(3):
        assert (got[i].ttft, got[i].latency, got[i].num_tokens) == (want[i].ttft, want[i].latency, want[i].num_tokens)
    assert [got[i].event for i in range(3)] == ["done", "done", "error"] and got[2].message == "lost"
