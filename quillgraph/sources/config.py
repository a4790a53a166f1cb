"""Settings: arguments before environment before file before defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import asdict, dataclass, fields, replace

_SECRET = ("key", "secret", "password")


@dataclass(frozen=True)
class Config:
    path: str = "knowledge-base"
    group_id: str = "default"
    embedding_dimensions: int = 256
    chunk_paragraphs: int = 6
    chunk_min_chars: int = 50
    dedup_threshold: float = 0.70
    dedup_batch: int = 25
    registry_threshold: float = 0.50
    registry_candidates: int = 25
    topic_threshold: float = 0.40
    query_entity_threshold: float = 0.30
    query_entity_candidates: int = 30
    query_topic_threshold: float = 0.35
    query_topic_candidates: int = 20
    high_relevance: float = 0.45
    max_sub_queries: int = 5
    expand_neighbours: bool = True
    api_key: str = ""


def _as(kind: str, value: object) -> object:
    if kind == "bool":
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    return {"int": int, "float": float}.get(kind, str)(value)


def load(file: str | None = None, prefix: str = "QUILLGRAPH_", **given: object) -> Config:
    """Sections of the TOML file are flattened; unknown names are an error."""
    kinds = {f.name: str(f.type) for f in fields(Config)}
    values: dict[str, object] = {}
    if file:
        with open(file, "rb") as f:
            for k, v in tomllib.load(f).items():
                values.update(v if isinstance(v, dict) else {k: v})
    values |= {n: os.environ[prefix + n.upper()] for n in kinds if prefix + n.upper() in os.environ}
    values |= {k: v for k, v in given.items() if v is not None}
    if wrong := set(values) - set(kinds):
        raise ValueError(f"no such setting: {', '.join(sorted(wrong))}")
    return replace(Config(), **{k: _as(kinds[k], v) for k, v in values.items()})


def save(config: Config, file: str) -> None:
    """Everything but keys."""
    show = lambda v: str(v).lower() if isinstance(v, bool) else repr(v) if not isinstance(v, str) else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"'
    with open(file, "w") as f:
        f.write("[settings]\n" + "".join(f"{k} = {show(v)}\n" for k, v in asdict(config).items() if not any(s in k for s in _SECRET)))
