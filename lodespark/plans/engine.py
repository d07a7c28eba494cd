"""Ingest, search and ask over an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prompt
from ..settings import Settings, settings
from ..sources.index import Index


class Engine:
    def __init__(self, spark: SparkSession, conf: Settings | None = None, path: str | None = None, generate=None, stream=None):
        """``generate``: from rows with messages to rows with an answer; ``stream``: to delta rows, as of sources.chat.streamer."""
        self.spark, self.conf, self.generate, self.stream = spark, conf or settings(), generate, stream
        self.index = Index(spark, path or self.conf.index_dir, self.conf.embedder, self.conf.embed_dim, self.conf.chunk_size, self.conf.chunk_overlap, self.conf.tokenizer)

    def ingest(self, docs: DataFrame) -> int:
        return self.index.add(docs)

    def ingest_text(self, text: str, doc_id: str) -> int:
        return self.ingest(self.spark.createDataFrame([(doc_id, text)], "doc_id string, text string"))

    def ingest_document(self, text: str, doc_id: str) -> int:
        """As ingest_text, but a document without chunks is an error."""
        n = self.ingest_text(text, doc_id)
        if not n:
            raise ValueError(f"{doc_id} has no text to index")
        return n

    def search(self, queries: DataFrame, top_k: int | None = None, mode: str = "hybrid", with_ranks: bool = True) -> DataFrame:
        """Without ``with_ranks`` a single mode leaves out the other ranking."""
        return self.index.search(queries, top_k or self.conf.top_k, mode, self.conf.rrf_k, with_ranks)

    def ask(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """(qid, messages, answer) of queries (qid, text)."""
        return prompt.ask(queries, self.search(queries, top_k), self.generate)

    def ask_events(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Event rows of each answer: its sources first, then its pieces as the stream gives them, then done or an error.

        Without a stream the pieces are the words of the finished answer."""
        found = self.search(queries, top_k)
        fields = ("key", "doc_id", "section", "text", "score", "dense_rank", "bm25_rank")
        sources = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("sources"))
        if self.stream:
            return self.streamed(queries, found, sources)
        answers = prompt.ask(queries, found, self.generate).join(sources, "qid", "left")
        deltas = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit("\\S+\\s*"), F.lit(0))
        return prompt.events(answers.select(F.col("qid").alias("req_id"), deltas.alias("deltas"), F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"), F.lit(None).cast("string").alias("error")))

    def streamed(self, queries: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
        """A query without hits gets the notice, and nothing is asked."""
        asked = prompt.ask(queries, found, None)
        deltas = self.stream(asked.where("messages is not null").select(F.col("qid").alias("req_id"), "messages")).select("req_id", "seq", "delta", "error")
        notice = asked.where("messages is null").select(F.col("qid").alias("req_id"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.col("answer").alias("delta")), F.struct(F.lit(1).alias("seq"), F.lit(None).cast("string").alias("delta")))).alias("d"))
        deltas = deltas.unionByName(notice.select("req_id", "d.seq", "d.delta", F.lit(None).cast("string").alias("error")))
        every = queries.select("qid").join(sources, "qid", "left").select(F.col("qid").alias("req_id"), F.coalesce("sources", F.array().cast(sources.schema["sources"].dataType)).alias("sources"))
        return prompt.streamed_events(every, deltas)
