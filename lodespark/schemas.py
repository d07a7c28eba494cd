"""Schemas of the engine's tables; readers are always given one of these."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


STR, INT, LONG, DBL, BOOL = StringType(), IntegerType(), LongType(), DoubleType(), BooleanType()
DOCUMENT = _struct(doc_id=STR, text=STR)
CHUNK = _struct(doc_id=STR, chunk_id=INT, text=STR, section=STR, meta=MapType(STR, STR))
EVAL_CASE = _struct(question=STR, gold=STR)
MESSAGE = _struct(role=STR, content=STR)
CHAT_ROW = _struct(messages=ArrayType(MESSAGE), kind=STR, gold=ArrayType(STR))
PREDICTION = _struct(row_id=LONG, answer=STR)
RESULT = _struct(ord=LONG, key=STR, doc_id=STR, section=STR, text=STR, score=DBL, dense_rank=INT, bm25_rank=INT)
REQUEST_RESULT = _struct(concurrency=INT, ok=BOOL, ttft=DBL, latency=DBL, num_tokens=LONG, error=STR)
DELTA = _struct(req_id=LONG, t=DBL, delta=STR, usage_tokens=LONG)
EVENT = _struct(req_id=LONG, seq=INT, event=STR, data=STR)
INDEX_META = _struct(embedder=STR, dim=INT, n=LONG)
