"""The corpus pipeline: score, dedup lines, dedup near copies, decontaminate, encode.

Each stage takes all that its predecessor kept and returns a DataFrame; all but
the last return the columns of documents. Stages decide by row: a row is known by
its id and a hash of its text, so rows that share an id, or have none, are decided
each on its own text. Null texts count as empty; an empty table gives an empty one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodespark.llm import bpe, decontamination, line_dedup, quality, simhash
from lodespark.llm.shared import drop_table, kept_tables, materialize, temporary_tables, unused


def with_row(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart and puts them in order, and that column's name: the id, none coming last, then a hash of the text."""
    (row,) = unused(docs, "row")
    parts = F.col("doc_id").isNull().alias("last"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("hash")
    return docs.withColumn(row, F.struct(*parts)), row


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least the threshold.

    Each row is scored by its own text; repeated rows are all kept or all dropped, and null texts are scored as empty ones."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (score,) = unused(docs, "score")
    return quality.with_score(docs, model, score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines and passages that an earlier document has; n_chars follows the text.

    No row goes: null and empty texts stay as they are, and rows of one id count as one document."""
    out = line_dedup.deduplicate_lines(docs, passages=True, lines=True)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the row with the smallest id, and of several with that id the one with the smallest text hash.

    Rows without an id stay only if no linked row has one. Rows equal in id and text are one
    document, of which any row stays. Null and empty texts are linked to each other."""
    rows, row = with_row(docs)
    found = materialize(simhash.near_duplicates(rows.select(row, "text"), id_col=row), "near-duplicates")
    gone, twice = found.where(f"{row} <> component_id").select(row), found.where(f"{row} = component_id").groupBy(row).count().where("count > 1").select(row)
    left = rows.join(gone, row, "left_anti")
    return left.join(twice, row, "left_anti").unionByName(left.join(twice, row, "left_semi").dropDuplicates([row])).drop(row)


def decontamination_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of words of a benchmark item.

    Each row goes or stays by its own text, whatever other rows of its id hold; null and empty texts have no words and stay."""
    rows, row = with_row(docs)
    hit = decontamination.decontaminate(rows.select(row, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    return rows.join(hit.where("n_hit > 0").select(row), row, "left_anti").drop(row)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text, one row for each row; null texts are encoded as empty ones."""
    return bpe.encode(docs, bpe.tokenizer_path(), columns=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_filter),
    ("SimHash near-dedup", near_duplicate_filter),
    ("benchmark decontamination", decontamination_filter),
    ("BPE encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents. What a stage has written for itself is deleted once its result is, and a result once the next is."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with temporary_tables(spark):
            made = stage(spark, docs, sf_dir)
            with kept_tables():
                docs = materialize(made, f"stage-{i + 1}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
