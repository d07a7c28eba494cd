"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("bpe", "chat", "decontamination", "exact_dedup", "licenses", "line_dedup", "ngram_join", "pii", "prefix_trie", "quality", "resampling", "simhash", "token_counts")


def _collect(name: str) -> dict:
    out = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    import corpus_pipeline

    return _collect("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE")
