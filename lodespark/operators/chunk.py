"""Documents to chunks: sections, sentences, and packing with overlap.

Sections and sentences are array expressions for a table of them. Packing them is a running decision
that no frame can express, so it is a small Arrow function on each document's text,
which finds sections and sentences by the same patterns; only the text is sent to it. Nothing is shuffled, and chunk numbers follow from the order within the
document's own array."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SIZE, OVERLAP, LEAST_BODY = 600, 120, 16
#: Characters of chunks after which a task gives them up.
HELD = 1 << 19


BREAK = re.compile(T.BREAK)
#: White space between sentences; a unit separator only ends lines and texts.
WHITE = T.SPACE.translate({i: None for i in range(0x1C, 0x20)})
SENTENCE_END = re.compile(f"(?<=[.!?…。])[{WHITE}]+")
HEADING = re.compile(f"#{{1,6}}[{WHITE}]+(.*)", re.DOTALL)


def sections(text: str) -> Iterator[tuple[str, str]]:
    """(title, body) of each section with a body, in order; the text before the first heading has no title."""
    title, open_ = "", []
    for line in BREAK.split(text):
        if found := HEADING.fullmatch(line):
            yield title, "\n".join(open_)
            title, open_ = found[1].strip(T.SPACE), []
        else:
            open_.append(line)
    yield title, "\n".join(open_)


def sentences(body: str) -> list[str]:
    parts = (s.strip(T.SPACE) for line in body.split("\n") for s in SENTENCE_END.split(line.strip(T.SPACE)))
    return [s for s in parts if s]


def split_sections(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` by section, with columns section_no, section and body instead of the text."""
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(T.sections(F.col(text_col))).alias("section_no", "s")).select(*keep, "section_no", F.col("s.title").alias("section"), F.col("s.body").alias("body"))


def split_sentences(docs: DataFrame, text_col: str = "text") -> DataFrame:
    keep = [c for c in docs.columns if c != text_col]
    return docs.select(*keep, F.posexplode(T.sentences(F.col(text_col))).alias("sentence_no", "sentence"))


def packed(sentences: list[str], budget: int, overlap: int) -> list[str]:
    """Sentences packed into bodies of up to ``budget`` characters, each counted with a space.

    A full body is closed, and the next begins with as many of its last sentences as fit
    in ``overlap``, unless the sentence at hand would then not fit. A sentence over the
    budget stands alone, cut into pieces."""
    bodies: list[str] = []
    open_: list[str] = []
    length = 0  # of the open sentences, each with a space
    for s in sentences:
        need = len(s) + 1
        if len(s) > budget:
            bodies += [" ".join(open_), *(s[i : i + budget] for i in range(0, len(s), budget))]
            open_, length = [], 0
            continue
        if open_ and length + need > budget:
            bodies.append(" ".join(open_))
            room, start = overlap, len(open_)
            while start and room >= len(open_[start - 1]) + 1:
                start -= 1
                room -= len(open_[start]) + 1
            open_, length = (open_[start:], overlap - room) if overlap - room + need <= budget else ([], 0)
        open_.append(s)
        length += need
    bodies.append(" ".join(open_))
    return [b for b in (b.strip() for b in bodies) if b]


def chunk(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, section, text): chunks of up to ``size`` characters with their section's prefix, numbered from 0.

    Null and empty documents have no chunks."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, titles, texts, held = [], [], [], [], 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(titles, pa.string()), pa.array(texts, pa.string())], ["doc_id", "chunk_id", "section", "text"])  # noqa: B023

            for row, text in enumerate(batch.column("text")):  # one document at a time is held as Python objects
                n = 0
                for title, own in sections((text.as_py() or b"").decode("utf-8", "replace")):
                    prefix = f"[{title}] " if title else ""
                    for body in packed(sentences(own), max(size - len(prefix), LEAST_BODY), overlap):
                        ids.append(row)
                        numbers.append(n)
                        titles.append(title)
                        texts.append(prefix + body)
                        held += len(texts[-1])
                        n += 1
                if held >= HELD:
                    yield made()
                    ids, numbers, titles, texts, held = [], [], [], [], 0
            yield made()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"doc_id {kind}, chunk_id int, section string, text string")


def chunk_key(doc: Column, number: Column) -> Column:
    return F.concat_ws("#", doc.cast("string"), number.cast("string"))
