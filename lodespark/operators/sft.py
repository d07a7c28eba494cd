"""Supervised datasets: validation of question and answer pairs, splits, chat rows, and encoding with masks."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import wire
from ..sources.files import write_jsonl
from .number import BITS, numbered, numbered_by
from .prompt import QUESTION, messages

REFUSAL = "The documents given do not hold this."
IGNORE = -100
RATIO, EVAL, SEED = 0.2, 0.2, 42


def reject_reason(question: Column, answer: Column, chunk: Column, refusal: str = REFUSAL) -> Column:
    """The first rule that a pair breaks, or null: emptiness, lengths, citations, refusal, numbers that the chunk lacks."""
    q, a = T.strip(F.coalesce(question, F.lit(""))), T.strip(F.coalesce(answer, F.lit("")))
    cites = F.regexp_extract_all(a, F.lit(T.CITATION), F.lit(1))
    lacking = F.filter(T.numbers(a), lambda n: ~F.contains(F.coalesce(chunk, F.lit("")), n))
    return (
        F.when((q == "") | (a == ""), "empty").when(~F.length(q).between(5, 120), "question length").when(F.length(a) > 400, "answer too long")
        .when(F.size(cites) == 0, "no citation").when(F.exists(cites, lambda c: c != "1"), "citation of no excerpt").when(F.contains(a, F.lit(refusal)), "refusal")
        .when(F.size(lacking) > 0, F.concat(F.lit("number not in chunk("), F.get(lacking, F.lit(0)), F.lit(")")))
    )


def reject_tally(pairs: DataFrame, reason_col: str = "reason") -> DataFrame:
    """(reason, n) of the rejected pairs, by the reason's name without its detail."""
    return pairs.where(F.col(reason_col).isNotNull()).groupBy(F.substring_index(reason_col, "(", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def spread(id_col: Column, seed: int = SEED) -> Column:
    """A fixed pseudo-random number from 0 to 1 for each id: the same sample on any cluster."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))


def split(samples: DataFrame, unit_col: str, ratio: float = EVAL, draw=spread) -> DataFrame:
    """``samples`` with a column is_eval; samples of one unit are never divided."""
    return samples.withColumn("is_eval", draw(F.col(unit_col)) < ratio)


def unanswerable_count(n: int, ratio: float = RATIO) -> int:
    """How many unanswerable samples make up ``ratio`` of all, besides n others."""
    return int(n * ratio / max(1e-9, 1 - ratio))


def scattered(*ids: Column) -> Column:
    """A 64-bit key by which rows come in a fixed but arbitrary order."""
    return F.xxhash64(*ids, F.lit(SEED))


def unanswerable(chunks: DataFrame, count: int, order=scattered, refusal: str = REFUSAL) -> DataFrame:
    """``count`` samples at most of a question about one document with excerpts of another. chunks (doc_id, chunk_id, text).

    Documents are numbered by ``order``, a 64-bit key of their id; each asks about the next
    one, and, while samples lack, about the next but one and so on, so that no pairs are
    formed beyond those wanted. Its topic is the first line of its first chunk that has
    one, its excerpts are its first and last chunk. One document alone gives no samples."""
    topic = F.min(F.when(F.col("topic") != "", F.struct("chunk_id", "topic")))["topic"]
    ends = F.array_distinct(F.array(F.min(F.struct("chunk_id", "text")), F.max(F.struct("chunk_id", "text"))))
    docs = chunks.withColumn("topic", T.first_line(F.col("text"))).groupBy("doc_id").agg(topic.alias("topic"), ends.alias("ends"))
    docs = docs.withColumn("key", order(F.col("doc_id")).cast("bigint"))
    place = numbered_by(docs, "key", ["doc_id"], "n").where(F.col("n") <= count).drop("key")
    total = place.agg(F.count(F.lit(1)).alias("m"), F.ceil(F.lit(count) / F.nullif(F.count("topic"), F.lit(0))).alias("laps"))
    after = place.select(F.col("n").alias("at"), F.transform("ends", lambda t: t["text"]).alias("context"), F.col("doc_id").alias("context_doc"))
    asked = place.drop("ends").crossJoin(F.broadcast(total)).where("m > 1 and topic is not null")
    asked = asked.withColumn("lap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("laps") - 1)))
    asked = asked.withColumns({"at": F.expr("pmod(n + 1 + lap % (m - 1), m)"), "turn": F.expr("lap * m + n")})
    asked = numbered(asked, F.floor(F.col("turn") / (F.col("laps") * F.col("m")) * (1 << BITS)), ["turn"], "no").where(F.col("no") < count)
    return asked.join(after, "at").select(
        "doc_id", "context_doc", F.concat(F.lit("Tell me about "), F.col("topic"), F.lit(".")).alias("question"),
        "context", F.lit(refusal).alias("answer"), F.lit("unanswerable").alias("kind"),
    )


UNIT = ["doc_id", "chunk_id"]
#: Asks for question and answer pairs about an excerpt.
TEACHER = "Write {n} questions that the excerpt below answers, each with its answer, which ends with [1] and holds no number that the excerpt lacks. Reply with a JSON array of objects with the fields question and answer only.\n\nExcerpt:\n"


def taught(chunks: DataFrame, generate: Callable[[DataFrame], DataFrame], per_chunk: int = 5) -> DataFrame:
    """``chunks`` (doc_id, chunk_id, text) with the column reply: what ``generate`` answers when asked for pairs."""
    asked = F.concat(F.lit(TEACHER.format(n=per_chunk)), F.coalesce("text", F.lit("")))
    turn = F.array(F.struct(F.lit("user").alias("role"), asked.alias("content")))
    return generate(chunks.withColumn("messages", turn)).drop("messages").withColumnRenamed("answer", "reply")


def pairs(replies: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, text, question, answer, reason): the pairs in each reply's JSON array, and why one is rejected."""
    each = replies.select(*UNIT, "text", F.explode(wire.json_objects(F.col("reply"))).alias("pair"))
    field = lambda name: T.strip(F.coalesce(F.get_json_object("pair", f"$.{name}"), F.lit(""))).alias(name)
    found = each.select(*UNIT, "text", field("question"), field("answer"))
    return found.withColumn("reason", reject_reason(F.col("question"), F.col("answer"), F.col("text")))


def held_out(chunks: DataFrame, ratio: float = EVAL, order=scattered) -> DataFrame:
    """(doc_id, chunk_id) of the chunks kept for evaluation: ``ratio`` of all, rounded down, but one at least."""
    units = chunks.select(*UNIT).distinct().withColumn("key", order(F.col("doc_id"), F.col("chunk_id")).cast("bigint"))
    total = units.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * F.lit(ratio))).alias("most"))
    placed = numbered_by(units, "key", UNIT, "n")
    return placed.crossJoin(F.broadcast(total)).where("n < most").select(*UNIT)


def build(replies: DataFrame, eval_ratio: float = EVAL, ratio: float = RATIO, order=scattered) -> DataFrame:
    """Samples (doc_id, chunk_id, question, context, answer, kind, gold, is_eval) of a teacher's replies.

    replies (doc_id, chunk_id, text, reply): a written table, as it is read several times.
    Valid pairs are answerable samples, with the numbers in their answers as gold. A
    chunk's samples are all for evaluation or all for training; to both sets unanswerable
    ones are added, of their own chunks only, until they are ``ratio`` of the set, as
    far as its documents go. A null reply has no pairs, a chunk with a null id is for
    training. The order of rows is not fixed."""
    chunks, held = replies.select(*UNIT, "text"), held_out(replies, eval_ratio, order)
    good = pairs(replies).where("reason is null")
    good = good.select(*UNIT, "question", F.array("text").alias("context"), "answer", F.lit("answerable").alias("kind"), T.numbers(F.col("answer")).alias("gold"))
    sets = []
    for is_eval, how in ((False, "left_anti"), (True, "left_semi")):
        own = good.join(held, UNIT, how)
        none = unanswerable(chunks.join(held, UNIT, how), unanswerable_count(own.count(), ratio), order)
        sets.append(own.unionByName(none.drop("context_doc"), allowMissingColumns=True).withColumn("is_eval", F.lit(is_eval)))
    return sets[0].unionByName(sets[1])


def by_kind(samples: DataFrame) -> DataFrame:
    """(is_eval, n, n_answerable, n_unanswerable)."""
    none = F.col("kind") == "unanswerable"
    return samples.groupBy("is_eval").agg(F.count(F.lit(1)).alias("n"), F.count_if(~none).alias("n_answerable"), F.count_if(none).alias("n_unanswerable"))


def write_sets(samples: DataFrame, train_path: str, eval_path: str) -> None:
    """The two sets as chat rows in JSON lines; only the evaluation rows carry gold."""
    for is_eval, path in ((False, train_path), (True, eval_path)):
        rows = chat_rows(samples.where(F.col("is_eval") == is_eval), with_gold=is_eval)
        write_jsonl(rows.select("messages", "kind", "gold"), path)


def chat_rows(samples: DataFrame, with_gold: bool = False) -> DataFrame:
    """(messages, kind, gold) of samples (question, context, answer, kind, gold); gold is null unless wanted and not empty."""
    blocks = F.array_join(F.transform("context", lambda t, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), t)), "\n\n")
    user = F.concat(F.lit("Excerpts found:\n\n"), blocks, F.lit(f"\n\n{QUESTION} "), F.col("question"))
    gold = F.when(F.size("gold") > 0, F.col("gold")) if with_gold else F.lit(None).cast("array<string>")
    keep = [c for c in samples.columns if c not in ("question", "context", "answer", "kind", "gold")]
    return samples.select(*keep, messages(user, answer=F.col("answer")).alias("messages"), "kind", gold.alias("gold"))


def labelled(prompt: Column, answer: Column, most: int | None = None) -> Column:
    """struct<input_ids, labels>: the prompt's labels are ignored; what is over ``most`` goes from the left, so the answer stays."""
    ids, labels = F.concat(prompt, answer), F.concat(F.array_repeat(F.lit(IGNORE), F.size(prompt)), answer)
    cut = (lambda x: F.when(F.size(x) > most, F.slice(x, -most, most)).otherwise(x)) if most else (lambda x: x)
    return F.struct(cut(ids).alias("input_ids"), cut(labels).alias("labels"))


def supervised(labels: Column) -> Column:
    return F.size(F.filter(labels, lambda x: x != IGNORE))


def truncated(prompt: Column, answer: Column, most: int) -> Column:
    """Whether :func:`labelled` has to leave something out."""
    return F.size(prompt) + F.size(answer) > most


def encoding_counts(samples: DataFrame, most: int, prompt_col: str = "prompt", answer_col: str = "answer") -> DataFrame:
    """One row (n, n_truncated, n_unlabelled, n_supervised) of samples with token ids: how many lose something, how many have nothing left to learn from, and tokens that count."""
    cut, labels = truncated(F.col(prompt_col), F.col(answer_col), most), labelled(F.col(prompt_col), F.col(answer_col), most)["labels"]
    own = samples.select(cut.alias("cut"), supervised(labels).cast("bigint").alias("own"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if("cut").alias("n_truncated"), F.count_if(F.col("own") == 0).alias("n_unlabelled"), F.coalesce(F.sum("own"), F.lit(0)).alias("n_supervised"))


def token_ids(encoded) -> list[int]:
    """The ids in a tokenizer's output, whichever of its forms: a mapping with input_ids, an array, a list, or a batch of one."""
    ids = encoded["input_ids"] if isinstance(encoded, Mapping) else encoded
    ids = list(ids.tolist() if hasattr(ids, "tolist") else ids)
    return list(ids[0]) if ids and isinstance(ids[0], list | tuple) else ids


def batched(rows: DataFrame, size: int, order_col: str, name: str = "batch") -> DataFrame:
    """``rows`` with the number of their batch: ``size`` rows each in the order of the 64-bit ``order_col``, the last may be smaller."""
    low, high = rows.agg(F.min(order_col), F.max(order_col)).first()
    step = max(1, ((high or 0) - (low or 0)) >> BITS)
    at = F.coalesce(F.floor((F.col(order_col) - F.lit(low or 0)) / F.lit(step)), F.lit(-1))
    return numbered(rows, at, [order_col], name).withColumn(name, F.floor(F.col(name) / F.lit(size)))


def collate(rows: DataFrame, batch_col: str = "batch", pad: int = 0) -> DataFrame:
    """``rows`` (batch, input_ids, labels) padded on the right to the widest of their batch, with attention."""
    width = rows.groupBy(batch_col).agg(F.max(F.size("input_ids")).alias("width"))
    fill = lambda c, v: F.concat(c, F.array_repeat(F.lit(v), F.col("width") - F.size(c)))
    ones = F.transform("input_ids", lambda x: F.lit(1))
    return rows.join(width, batch_col).select(*[c for c in rows.columns if c not in ("input_ids", "labels")], fill(F.col("input_ids"), pad).alias("input_ids"), fill(F.col("labels"), IGNORE).alias("labels"), fill(ones, 0).alias("attention"))
