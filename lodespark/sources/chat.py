"""Chat completion servers as generators: functions from rows with messages to rows with an answer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import Settings


def payload(messages: list[dict], conf: Settings, temperature: float | None = None, stream: bool = False, vision: bool = False) -> dict:
    """The request's body; what isn't set is left out. vision: with the limits for images."""
    heat, most = (conf.vlm_temperature, conf.vlm_max_tokens) if vision else (conf.llm_temperature, conf.llm_max_tokens)
    heat = heat if temperature is None else temperature
    body = {"model": conf.llm_model or None, "messages": messages, "temperature": heat, "max_tokens": most, "stream": stream or None}
    return {k: v for k, v in body.items() if v is not None}


def http_send(conf: Settings) -> Callable[[dict], str]:
    """Sends a body and gives the answer's text; anything but 200 is an error with the start of what came back."""

    def send(body: dict) -> str:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        request = Request(f"{conf.llm_base_url.rstrip('/')}/chat/completions", json.dumps(body, ensure_ascii=False).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {conf.llm_api_key}"})
        try:
            with urlopen(request, timeout=conf.llm_timeout) as reply:
                return json.load(reply)["choices"][0]["message"].get("content") or ""
        except HTTPError as e:
            raise RuntimeError(f"chat server: {e.code} {e.read().decode(errors='replace')[:500]}") from e

    return send


def generator(conf: Settings, send: Callable[[dict], str] | None = None, vision: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A generator that sends each row's messages from the executors. ``send``: in place of HTTP, for tests; vision: the messages hold images."""

    def generate(rows: DataFrame) -> DataFrame:
        kept = [c for c in rows.columns if c != "answer"]
        coded = rows.select(*kept).withColumn("__body", F.to_json("messages"))
        kinds = ", ".join(f"`{n}` {k}" for n, k in coded.drop("__body").dtypes if n != "messages")

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            call = send or http_send(conf)
            for part in parts:
                part["answer"] = [call(payload(json.loads(m), conf, vision=vision)) for m in part["__body"]]
                yield part[[c for c in kept if c != "messages"] + ["__body", "answer"]]

        made = coded.drop("messages").mapInPandas(run, f"{kinds}, __body string, answer string")
        kind = rows.schema["messages"].dataType
        return made.withColumn("messages", F.from_json("__body", kind)).select(*kept, "answer")

    return generate


def http_stream(conf: Settings) -> Callable[[dict], Iterator[tuple[str, int | None]]]:
    """Sends a body and gives the answer's pieces as the server sends them, with the number of tokens where it says so."""

    def stream(body: dict) -> Iterator[tuple[str, int | None]]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        request = Request(f"{conf.llm_base_url.rstrip('/')}/chat/completions", json.dumps(body | {"stream": True}, ensure_ascii=False).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {conf.llm_api_key}"})
        try:
            with urlopen(request, timeout=conf.llm_timeout) as reply:
                for line in reply:
                    if not line.startswith(b"data:"):
                        continue
                    data = line[5:].strip()
                    if data == b"[DONE]":
                        return
                    found = json.loads(data)
                    delta = (found.get("choices") or [{}])[0].get("delta", {}).get("content")
                    usage = (found.get("usage") or {}).get("completion_tokens")
                    if delta or usage is not None:
                        yield delta or "", usage
        except HTTPError as e:
            raise RuntimeError(f"chat server: {e.code} {e.read().decode(errors='replace')[:500]}") from e

    return stream


DELTAS = "seq int, t double, delta string, usage_tokens bigint, error string"


def streamer(conf: Settings, stream: Callable[[dict], Iterator[tuple[str, int | None]]] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A generator of delta rows (req_id, seq, t, delta, usage_tokens, error) from rows (req_id, messages), sent from the executors.

    A row is given up as its piece arrives, t seconds after the request. The last row of a request has no
    delta; its error says what went wrong, if anything did, be it after some pieces."""

    def generate(rows: DataFrame) -> DataFrame:
        kind = rows.schema["req_id"].dataType.simpleString()

        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            call = stream or http_stream(conf)
            types = (pa.int32(), pa.float64(), pa.string(), pa.int64(), pa.string())
            for part in parts:
                for i in range(len(part)):
                    began, seq, error = time.perf_counter(), 0, None

                    def row(*values, own=part.column("req_id").slice(i, 1)) -> pa.RecordBatch:
                        return pa.RecordBatch.from_arrays([own, *(pa.array([v], t) for v, t in zip(values, types, strict=True))], ["req_id", "seq", "t", "delta", "usage_tokens", "error"])

                    try:
                        for delta, usage in call(payload(json.loads(part.column("body")[i].as_py()), conf, stream=True)):
                            yield row(seq, time.perf_counter() - began, delta, usage, None)
                            seq += 1
                    except Exception as e:  # any failure of the server or the network ends this request only
                        error = str(e) or type(e).__name__
                    yield row(seq, time.perf_counter() - began, None, None, error)

        return rows.select("req_id", F.to_json("messages").alias("body")).mapInArrow(run, f"req_id {kind}, {DELTAS}")

    return generate


def echo(rows: DataFrame) -> DataFrame:
    """A generator for tests: the last message's question, with a citation."""
    last = F.element_at("messages", -1)["content"]
    return rows.withColumn("answer", F.concat(F.trim(F.substring_index(last, "질문:", -1)), F.lit(" [1]")))
