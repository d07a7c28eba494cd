"""Results of gradings and of load measurements as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import grade
from .files import write_jsonl

GRADES = ("refused", "has_cite", "cite_valid", "refusal_correct", "false_refusal", "grounded")
#: What a measurement's settings are written without.
SECRET = "api_key"


def write_grades(graded: DataFrame, path: str, label: str, model: str | None = None) -> None:
    """``graded`` (messages, kind and GRADES): one row (label, model, summary) in ``path``/summary, and a row for each sample in ``path``/samples."""
    summary = grade.summarize(graded)
    of = F.struct(*summary.columns)
    write_jsonl(summary.select(F.lit(label).alias("label"), F.lit(model).cast("string").alias("model"), of.alias("summary")), f"{path}/summary", nulls=True)
    question = grade.question_of(grade.last_prompt(F.col("messages"))).alias("question")
    write_jsonl(graded.select(question, F.coalesce("kind", F.lit("answerable")).alias("kind"), *GRADES), f"{path}/samples", nulls=True)


def bench_result(levels: DataFrame, config: dict, environment: dict | None = None, by: str = "concurrency") -> DataFrame:
    """One row, value: the settings without their key, the environment, and a result for each level in order (a few rows)."""
    kept = json.dumps({k: v for k, v in config.items() if k != SECRET}, ensure_ascii=False)
    rows = F.array_sort(F.collect_list(F.struct(by, *[c for c in levels.columns if c != by])))
    head = f'{{"config": {kept}, "environment": {json.dumps(environment, ensure_ascii=False)}, "results": '
    return levels.agg(F.concat(F.lit(head), F.to_json(rows, {"ignoreNullFields": "false"}), F.lit("}")).alias("value"))
