"""Contexts with numbered citations, chat messages and event rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wire

#: Marks the question in a prompt; graders look for it. Fixed value.
QUESTION = "질문:"
SYSTEM = "Answer only from the numbered excerpts below. Cite the number of each excerpt you use, like [1]. If they do not hold the answer, say so."
INTRO = "Excerpts found:"
NOTHING = "No documents are indexed yet."


def context(results: DataFrame, with_source: bool = True) -> DataFrame:
    """(qid, context): the texts in rank order, each after its number and, if wanted, its key."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "))
    head = F.concat(head, F.lit("(source: "), F.col("key"), F.lit(")\n")) if with_source else head
    rows = results.select("qid", F.struct("rank", F.concat(head, F.col("text")).alias("block")).alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["block"]), "\n\n")
    return rows.groupBy("qid").agg(joined.alias("context"))


def user_message(context_: Column, question: Column) -> Column:
    return F.concat(F.lit(INTRO + "\n\n"), context_, F.lit(f"\n\n{QUESTION} "), question)


def messages(user: Column, system: str = SYSTEM, answer: Column | None = None) -> Column:
    rows = [("system", F.lit(system)), ("user", user)] + ([("assistant", answer)] if answer is not None else [])
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in rows])


def ask(queries: DataFrame, results: DataFrame, generate=None) -> DataFrame:
    """(qid, messages, answer) of all queries (qid, text); one without results gets a notice and is not sent to the generator.

    ``generate``: a function from a DataFrame with messages to one with answer."""
    joined = queries.select("qid", F.col("text").alias("question")).join(context(results), "qid", "left")
    asked = joined.where("context is not null").select("qid", messages(user_message(F.col("context"), F.col("question"))).alias("messages"))
    answered = generate(asked) if generate else asked.withColumn("answer", F.lit(None).cast("string"))
    rest = joined.where("context is null").select("qid", F.lit(None).cast(asked.schema["messages"].dataType).alias("messages"), F.lit(NOTHING).alias("answer"))
    return answered.select("qid", "messages", "answer").unionByName(rest)


def events(answers: DataFrame, deltas_col: str = "deltas", sources_col: str = "sources", error_col: str = "error") -> DataFrame:
    """(req_id, seq, event, data): the sources, then the tokens, then done, or an error in its place."""
    token = lambda d: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(d.alias("text"))).alias("data"))
    first = F.array(F.struct(F.lit("sources").alias("event"), F.to_json(F.col(sources_col), {"ignoreNullFields": "false"}).alias("data")))
    last = F.when(F.col(error_col).isNull(), F.array(F.struct(F.lit("done").alias("event"), F.lit("{}").alias("data")))).otherwise(F.array(F.struct(F.lit("error").alias("event"), F.to_json(F.struct(F.col(error_col).alias("message"))).alias("data"))))
    return answers.select("req_id", F.posexplode(F.concat(first, F.transform(deltas_col, token), last)).alias("seq", "e")).select("req_id", "seq", F.col("e.event").alias("event"), F.col("e.data").alias("data"))


def streamed_events(sources: DataFrame, deltas: DataFrame) -> DataFrame:
    """(req_id, seq, event, data) of sources (req_id, sources) and delta rows (req_id, seq, delta, error), of which the last of a request has no delta.

    No event waits for another, so they can be framed as they come."""
    first = sources.select("req_id", F.lit(0).alias("seq"), F.lit("sources").alias("event"), F.to_json("sources", {"ignoreNullFields": "false"}).alias("data"))
    event = F.when(F.col("delta").isNotNull(), "token").when(F.col("error").isNotNull(), "error").otherwise("done")
    data = F.when(F.col("delta").isNotNull(), F.to_json(F.struct(F.col("delta").alias("text")))).when(F.col("error").isNotNull(), F.to_json(F.struct(F.col("error").alias("message")))).otherwise("{}")
    rows = deltas.where("delta is null or delta <> ''")
    return first.unionByName(rows.select("req_id", (F.col("seq") + 1).alias("seq"), event.alias("event"), data.alias("data")))


def framed(rows: DataFrame) -> DataFrame:
    return rows.select("req_id", "seq", wire.sse(F.col("event"), F.col("data")).alias("frame"))


def well_formed(rows: DataFrame) -> DataFrame:
    """(req_id, ok): sources first and once, then tokens, and exactly one of done and error, at the end."""
    ends = F.col("event").isin("done", "error")
    per = rows.groupBy("req_id").agg(F.max("seq").alias("last"), F.count_if(ends).alias("ends"), F.max(F.when(ends, F.col("seq"))).alias("end"), F.count_if(F.col("event") == "sources").alias("n"), F.max(F.when(F.col("event") == "sources", F.col("seq"))).alias("s"))
    return per.select("req_id", ((F.col("ends") == 1) & (F.col("end") == F.col("last")) & (F.col("n") == 1) & (F.col("s") == 0)).alias("ok"))
