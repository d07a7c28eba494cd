"""Table functions for SQL: chunks of a text and pages of a document, with LATERAL.

``register(spark)`` makes them known to a session:

    select d.doc_id, c.* from documents d, lateral chunk_text(d.text, 600, 120) c
    select f.path, p.page from files f, lateral document_pages(f.content) p

Rows come as Arrow batches, and nothing is shuffled: each task makes the rows of its own
texts. A text without chunks gives no row, and Spark keeps none for it in a left join
either (as measured with 4.1). Sections and sentences are found and packed by the functions of operators/chunk.py."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.chunk import LEAST_BODY, OVERLAP, SIZE, packed, sections, sentences

class ChunkText:
    """(chunk_id, section, text) of a text's chunks of up to ``size`` characters. A null or empty text has none, and null numbers are the defaults."""

    def eval(self, text: str, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple[int, str, str]]:
        size, overlap, n = SIZE if size is None else size, OVERLAP if overlap is None else overlap, 0
        for title, body in sections(text or ""):
            prefix = f"[{title}] " if title else ""
            for chunk in packed(sentences(body), max(size - len(prefix), LEAST_BODY), overlap):
                yield n, title, prefix + chunk
                n += 1


def pages_by(render: Callable[[bytes], list[bytes]]) -> type:
    class DocumentPages:
        """(page, content, media) of a document's pages as PNG. Null, and a document without pages, has none."""

        def eval(self, content: bytes) -> Iterator[tuple[int, bytes, str]]:
            for n, page in enumerate(render(bytes(content)) if content is not None else ()):
                yield n, page, "image/png"

    return DocumentPages


def register(spark: SparkSession, render: Callable[[bytes], list[bytes]] | None = None) -> None:
    """Make chunk_text(text, size, overlap) known to the session's SQL, and with a renderer document_pages(content)."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType="chunk_id int, section string, text string", useArrow=True))
    if render:
        spark.udtf.register("document_pages", udtf(pages_by(render), returnType="page int, content binary, media string", useArrow=True))
