"""Settings with their defaults, read from prefixed environment variables and an optional .env file."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from functools import lru_cache
from pathlib import Path

PREFIX = "LODESPARK_"


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 600
    chunk_overlap: int = 120
    top_k: int = 5
    rrf_k: int = 60
    embedder: str = "hash"
    embed_dim: int = 512
    tokenizer: str = "words"
    index_dir: str = "index"
    llm_base_url: str = "http://localhost:8000/v1"
    llm_model: str = ""
    llm_api_key: str = "EMPTY"
    llm_max_tokens: int = 1024
    llm_temperature: float | None = 0.2
    llm_timeout: float = 120.0
    vlm_temperature: float | None = 0.0
    vlm_max_tokens: int = 4096


def _value(kind: str, raw: str):
    """A blank optional value is None; other values are of the field's type."""
    if "None" in kind and not raw.strip():
        return None
    return int(raw) if kind.startswith("int") else float(raw) if kind.startswith("float") else raw


def load(env: dict[str, str] | None = None, env_file: str | None = None) -> Settings:
    """Names the settings don't have are ignored; the environment goes before the file."""
    found: dict[str, str] = {}
    if env_file and Path(env_file).exists():
        lines = (line.partition("=") for line in Path(env_file).read_text(encoding="utf-8").splitlines() if "=" in line and not line.lstrip().startswith("#"))
        found = {k.strip(): v.strip().strip("\"'") for k, _, v in lines}
    found |= dict(os.environ if env is None else env)
    return Settings(**{f.name: _value(str(f.type), found[PREFIX + f.name.upper()]) for f in fields(Settings) if PREFIX + f.name.upper() in found})


@lru_cache(maxsize=1)
def settings() -> Settings:
    return load(env_file=".env")
