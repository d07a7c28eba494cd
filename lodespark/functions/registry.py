"""Tokenizers, embedders and a page renderer: built-in ones, and models and libraries that an environment may have.

A tokenizer is a function from a text column to a column of tokens; an embedder is
one from a table with a text column to a table with an embedding column."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

#: Tags of a morphological analyser whose words are kept: nouns, numerals, verbs, adjectives, roots, foreign words, digits, Chinese.
KEPT_TAGS = ("NN", "NR", "NP", "VV", "VA", "XR", "SL", "SN", "SH")
ANALYSER = "kiwipiepy"
PDF = "pypdfium2"


def morphemes(load: Callable[[], Callable[[str], list[tuple[str, str]]]]) -> Callable[[Column], Column]:
    """A tokenizer by an analyser: ``load`` runs once per worker and gives a function from text to (form, tag) pairs."""

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyse = load()
        for part in parts:
            yield part.map(lambda t: [form.lower() for form, tag in analyse(t or "") if tag.startswith(KEPT_TAGS)])

    return run


def _installed() -> Callable[[str], list[tuple[str, str]]]:
    import kiwipiepy

    kiwi = kiwipiepy.Kiwi()
    return lambda t: [(x.form, x.tag) for x in kiwi.tokenize(t)]


def tokenizer(name: str | None = None) -> Callable[[Column], Column]:
    """words, morphemes, or by default morphemes where the analyser is installed and words elsewhere."""
    if name == "morphemes" or name is None and importlib.util.find_spec(ANALYSER):
        return morphemes(_installed)
    if name in (None, "words"):
        return T.words
    raise ValueError(f"unknown tokenizer {name}")


def model_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 32, text_col: str = "text", out: str = "embedding") -> Callable[[DataFrame], DataFrame]:
    """An embedder by a model: ``load`` runs once per worker and gives a function from texts to vectors, which are brought to unit length."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        encode = load()
        for part in parts:
            texts, rows = part.fillna("").tolist(), []
            for i in range(0, len(texts), batch):
                m = np.asarray(encode(texts[i : i + batch]), dtype=np.float64)
                n = np.sqrt((m * m).sum(axis=1, keepdims=True))
                rows += (m / np.where(n == 0, 1.0, n)).astype(np.float32).tolist()
            yield pd.Series(rows)

    return lambda df: df.withColumn(out, run(F.col(text_col)))


def embedder(name: str) -> Callable[[DataFrame], DataFrame]:
    """hash, or a sentence model by its name (bge-m3 for short), where its library is installed."""
    if name == "hash":
        from ..operators.dense import embed

        return embed
    full = {"bge-m3": "BAAI/bge-m3"}.get(name, name)

    def load():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(full)
        return lambda texts: model.encode(texts, normalize_embeddings=True)

    return model_embedder(load)


def renderer(scale: float = 2.0) -> Callable[[bytes], list[bytes]]:
    """A document's pages as PNG, ``scale`` times 72 dots an inch, by a PDF library, where it is installed."""
    if not importlib.util.find_spec(PDF):
        raise ValueError(f"reading a PDF needs {PDF}")

    def run(content: bytes) -> list[bytes]:
        import io

        import pypdfium2

        made, pdf = [], pypdfium2.PdfDocument(content)
        try:
            for page in pdf:
                out = io.BytesIO()
                page.render(scale=scale).to_pil().save(out, format="PNG")
                made.append(out.getvalue())
        finally:
            pdf.close()
        return made

    return run
