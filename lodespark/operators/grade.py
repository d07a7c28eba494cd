"""Rule-based grading of answers: refusals, citations and grounding in given values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..workspace import materialize
from .prompt import QUESTION

#: What a refusal says. Fixed values.
REFUSALS = ("찾을 수 없습니다", "찾을수 없습니다", "확인할 수 없습니다")


def is_refusal(answer: Column, markers: tuple[str, ...] = REFUSALS) -> Column:
    return F.array_contains(F.array(*[F.contains(answer, F.lit(m)) for m in markers]), True)


def excerpts(prompt: Column) -> Column:
    """Numbers in brackets before the first question mark-word, one at least."""
    return F.greatest(F.size(F.regexp_extract_all(F.substring_index(prompt, QUESTION, 1), F.lit(T.CITATION), F.lit(1))), F.lit(1))


def last_prompt(messages: Column) -> Column:
    return F.element_at(F.filter(messages, lambda m: m["role"] != "assistant"), -1)["content"]


def question_of(prompt: Column) -> Column:
    return T.strip(F.substring_index(prompt, QUESTION, -1))


def grade(rows: DataFrame, markers: tuple[str, ...] = REFUSALS) -> DataFrame:
    """``rows`` (answer, n_chunks, gold, kind) with refused, has_cite, cite_valid, refusal_correct, false_refusal and grounded.

    A column is null where it doesn't apply: refusal_correct is of unanswerable rows,
    the last two of all others, and grounded only where there is gold. A null kind
    counts as answerable, a null answer as empty."""
    answer, cites = F.coalesce("answer", F.lit("")), T.citations(F.coalesce("answer", F.lit("")))
    refused, none = is_refusal(answer, markers), F.coalesce(F.col("kind") == "unanswerable", F.lit(False))
    valid = (F.size(cites) > 0) & F.forall(cites, lambda c: F.coalesce(c.between(1, F.col("n_chunks")), F.lit(False)))
    return rows.withColumns({
        "refused": refused, "has_cite": F.size(cites) > 0, "cite_valid": valid,
        "refusal_correct": F.when(none, refused), "false_refusal": F.when(~none, refused),
        "grounded": F.when(~none & (F.size(F.coalesce("gold", F.array().cast("array<string>"))) > 0), F.forall("gold", lambda g: F.contains(answer, g))),
    })


def summarize(graded: DataFrame) -> DataFrame:
    """One row of counts and rates to 4 places; a rate over nothing is null."""
    none = F.coalesce(F.col("kind") == "unanswerable", F.lit(False))
    rate = lambda when, c: F.bround(F.avg(F.when(when, F.col(c).cast("double"))), 4).alias
    return graded.agg(
        F.count_if(~none).alias("n_answerable"), F.count_if(none).alias("n_unanswerable"), F.count("grounded").alias("n_grounded_scored"),
        rate(~none & ~F.col("refused"), "has_cite")("cite_rate"), rate(~none & F.col("has_cite"), "cite_valid")("cite_valid_rate"),
        rate(~none, "grounded")("grounded_rate"), rate(~none, "false_refusal")("false_refusal_rate"), rate(none, "refusal_correct")("refusal_recall"),
    )


def graded_predictions(chat: DataFrame, predictions: DataFrame) -> DataFrame:
    """Chat rows (row_id, messages, kind, gold) graded with predictions (row_id, answer), which must be one each."""
    joined = chat.join(predictions, "row_id", "full_outer")
    odd = chat.count() != predictions.count() or joined.where("messages is null or answer is null").limit(1).count()
    if odd:
        raise ValueError("predictions and rows do not match one to one")
    return grade(joined.withColumn("n_chunks", excerpts(last_prompt(F.col("messages")))))


def paired(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """(row_id, row, prediction): lines (n, line) of two files side by side, by their place. Unequal numbers of lines are an error."""
    counts = [x.count() for x in (rows, predictions)]
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[1]} predictions for {counts[0]} rows: were they made for the same file?")
    return rows.select(F.col("n").alias("row_id"), F.col("line").alias("row")).join(predictions.select(F.col("n").alias("row_id"), F.col("line").alias("prediction")), "row_id")


def graded_files(rows: DataFrame, predictions: DataFrame) -> DataFrame:
    """Chat rows of one JSON lines file graded with the answers of another, line by line; both as of files.numbered_lines."""
    both = paired(rows, predictions)
    chat = F.from_json("row", "messages array<struct<role:string,content:string>>, kind string, gold array<string>")
    made = both.select("row_id", chat.alias("c"), F.get_json_object("prediction", "$.answer").alias("answer"))
    made = materialize(made.select("row_id", "c.messages", "c.kind", "c.gold", "answer"), "paired")
    return graded_predictions(made.drop("answer"), made.select("row_id", "answer"))
