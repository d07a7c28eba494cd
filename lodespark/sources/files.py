"""Text, uploads, images and pages of documents from files, and JSON lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import wire
from ..workspace import materialize

PARSE_PROMPT = "Convert this page to Markdown. Keep all text and the structure of headings and tables, add nothing, and mark what can't be read as [unreadable]."
PAGE_BREAK = "\n\n---\n\n"


def text_files(spark: SparkSession, path: str, glob: str | None = None, stem: bool = False) -> DataFrame:
    """(doc_id, text), a document for each file in name order, folders within not included. doc_id: the file's name, or its stem."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    name = F.regexp_replace("name", "\\.[^.]*$", "") if stem else F.col("name")
    return rows.select(F.url_decode(name).alias("doc_id"), "text").orderBy("doc_id")


def uploads(spark: SparkSession, path: str) -> DataFrame:
    """(filename, status, text) of uploaded files: 200 with the text, 415 for other suffixes, 422 for what isn't UTF-8."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("filename"), "content")
    status = wire.upload_status(F.col("filename"), F.col("content"))
    return rows.select("filename", status.alias("status"), F.when(status == 200, F.col("content").cast("string")).alias("text"))


def image_requests(images: DataFrame, prompt: str = PARSE_PROMPT) -> DataFrame:
    """``images`` (content, media) as chat messages with the image in a data URL and the instruction."""
    part = "struct<type:string,text:string,image_url:struct<url:string>>"
    picture = F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(wire.data_url(F.col("content"), F.col("media")).alias("url")).alias("image_url")).cast(part)
    words = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url")).cast(part)
    return images.withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), F.array(picture, words).alias("content")))).drop("content")


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(filename, page, content, media), one page each; a file that is no known image is an error."""
    rows = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("filename"), "content")
    return rows.select("filename", F.lit(0).alias("page"), "content", wire.media_type(F.col("filename")).alias("media"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content) of a file or a folder's files."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("filename"), "content")


def pages(files: DataFrame, render: Callable[[bytes], list[bytes]]) -> DataFrame:
    """(filename, page, content, media) of documents (filename, content), by a renderer that gives a document's pages as PNG. One without pages gives no row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["filename"], part["content"], strict=True):
                made = render(bytes(content))
                if made:
                    yield pd.DataFrame({"filename": [name] * len(made), "page": range(len(made)), "content": made, "media": ["image/png"] * len(made)})

    return files.select("filename", "content").mapInPandas(run, "filename string, page int, content binary, media string")


def joined_pages(parsed: DataFrame) -> DataFrame:
    """(filename, text) of parsed pages (filename, page, answer), in order."""
    return parsed.groupBy("filename").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "answer"))), lambda p: p["answer"]), PAGE_BREAK).alias("text"))


def parsed(pages: DataFrame, generate: Callable[[DataFrame], DataFrame], prompt: str = PARSE_PROMPT) -> DataFrame:
    """(filename, text): the Markdown of documents whose pages are images (filename, page, content, media), read by ``generate``."""
    return joined_pages(generate(image_requests(pages, prompt)))


def write_text(docs: DataFrame, path: str, suffix: str = "_parsed.md") -> DataFrame:
    """Write each document (filename, text) to ``path`` in a folder named after it; the rows written, with their names."""
    named = docs.select(F.concat(F.regexp_replace("filename", "\\.[^.]*$", ""), F.lit(suffix)).alias("name"), F.col("text").alias("value"))
    named.write.mode("overwrite").option("lineSep", "\n").partitionBy("name").text(path)
    return named


def read_jsonl(spark: SparkSession, path: str, schema: StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSON lines file; blank lines are skipped. strict: a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line): the lines of a text file, or of a folder's files in order of their names, numbered from 0; blank ones are left out.

    Spark reads a file in parts, each from a place in it. Lines are counted for each part, and
    parts in order of file and place say where each begins; only these counts come together."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), F.col("value").alias("line"))
    rows = materialize(rows.where("trim(line) <> ''").withColumn("at", F.monotonically_increasing_id()), "lines")
    parts = rows.groupBy("file", "place").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    starts = parts.withColumn("start", F.sum("n").over(Window.orderBy("file", "place")) - F.col("n")).select("file", "place", "first", "start")  # a row for each part
    return rows.join(F.broadcast(starts), ["file", "place"]).select((F.col("start") + F.col("at") - F.col("first")).alias("n"), "line")


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(qid, question, gold) of a JSON lines file, numbered by line; a broken line is an error."""
    parsed = F.from_json("line", schemas.EVAL_CASE, {"mode": "FAILFAST"})
    return numbered_lines(spark, path).select(F.col("n").alias("qid"), parsed.alias("c")).select("qid", "c.question", "c.gold")


def write_jsonl(df: DataFrame, path: str, nulls: bool = False) -> None:
    """Columns in their order, text as it is; null fields are left out unless ``nulls``."""
    df.write.mode("overwrite").option("ignoreNullFields", not nulls).json(path)
