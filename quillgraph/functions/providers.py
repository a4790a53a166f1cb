"""Models behind two interfaces, with deterministic defaults that need no network."""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


class Embeddings(ABC):
    """Texts to vectors of one length. Instances travel to executors, so they hold settings, not connections."""

    dimensions: int

    @abstractmethod
    def embed(self, texts: Sequence[str]) -> np.ndarray: ...

    def embed_one(self, text: str) -> list[float]:
        return [float(x) for x in self.embed([text])[0]]


class HashEmbeddings(Embeddings):
    """Signed hashes of words and their three-letter pieces, normalised: texts that share words are similar."""

    def __init__(self, dimensions: int = 256) -> None:
        self.dimensions = dimensions

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        from zlib import crc32

        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", (t or "").lower()):
                for g, weight in [(w, 2.0), *((f" {w} "[k : k + 3], 0.5) for k in range(len(w)))]:
                    h = crc32(g.encode())
                    out[i, h % self.dimensions] += weight if h >> 16 & 1 else -weight
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class LanguageModel(ABC):
    """What the pipelines ask of a model, as data in and data out."""

    @abstractmethod
    def extract(self, text: str) -> dict:
        """{"entities": [{name, entity_type, summary}], "facts": [{subject, relationship, object, content, date_context, topics}]}"""

    @abstractmethod
    def decompose(self, question: str) -> dict:
        """{"question_type", "sub_queries": [{"text", "entity_hints", "topic_hints"}], "confidence"}"""

    @abstractmethod
    def answer(self, question: str, context: str) -> tuple[str, float]: ...

    def same(self, rows: list[dict]) -> list[list[int]]:
        """Which of the entities of a cluster are one; all of them, unless a model knows better."""
        return [list(range(len(rows)))]

    def critique(self, text: str, found: dict) -> str | None:
        """What is missing in an extraction, or None if it will do."""
        return None


_NAME = re.compile(r"\b[A-Z][\w&.-]*(?:\s+[A-Z][\w&.-]*)*")
_STOP = {"The", "A", "An", "This", "That", "It", "In", "On", "What", "Which", "Who", "When", "Where", "How", "Why", "List", "Compare"}


class RuleModel(LanguageModel):
    """Capitalised names are entities; two in one sentence with words between them are a fact."""

    def extract(self, text: str) -> dict:
        entities, facts = {}, []
        for s in re.split(r"(?<=[.!?])\s+|\n+", text or ""):
            found = []
            for m in _NAME.finditer(s):
                words = m.group().rstrip(".").split()
                while words and words[0] in _STOP:
                    words = words[1:]
                if words and len(" ".join(words)) > 1:
                    found.append((" ".join(words), m.start(), m.end()))
            for name, _, _ in found:
                entities.setdefault(name, {"name": name, "entity_type": "concept", "summary": s.strip()})
            for (a, _, x), (b, y, _) in zip(found, found[1:]):
                verb = "_".join(re.findall(r"[A-Za-z]+", s[x:y].upper())[:8])
                if verb and a != b:
                    facts.append({"subject": a, "relationship": verb, "object": b, "content": s.strip(), "date_context": next(iter(re.findall(r"\b(?:19|20)\d\d\b", s)), ""), "topics": []})
        return {"entities": list(entities.values()), "facts": facts}

    def decompose(self, question: str) -> dict:
        hints = [h for m in _NAME.finditer(question) for w in [m.group().split()] for h in [" ".join(w[1:] if w[0] in _STOP else w)] if h]
        kind = next((k for k, words in (("comparison", ("compare", "versus")), ("causal", ("why",)), ("temporal", ("when", "before", "after")), ("enumeration", ("list", "which"))) if any(w in question.lower().split() for w in words)), "factual")
        return {"question_type": kind, "sub_queries": [{"text": question, "entity_hints": hints, "topic_hints": []}], "confidence": 0.5}

    def answer(self, question: str, context: str) -> tuple[str, float]:
        lines = [x[2:] for x in context.splitlines() if x.startswith("- ")]
        return (" ".join(lines[:5]), 0.3) if lines else ("There is nothing about this in the knowledge base.", 0.0)


def embedded(rows: DataFrame, text: str, model: Embeddings, out: str = "vector") -> DataFrame:
    """``rows`` with the vector of a text column, a batch at a time."""
    names, at = [*rows.columns, out], rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.asarray(model.embed([t or "" for t in b.column(at).to_pylist()]), np.float32).reshape(b.num_rows, model.dimensions)
            ends = pa.array(np.arange(b.num_rows + 1) * made.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(made.ravel()))], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))]))


def extracted(chunks: DataFrame, model: LanguageModel, retries: int = 1) -> DataFrame:
    """(chunk_uuid, entities, facts) of (uuid, content). What the critique misses is asked once more; a chunk whose extraction fails has nothing."""

    def one(text: str) -> dict:
        try:
            got = model.extract(text)
            for _ in range(retries):
                note = model.critique(text, got)
                if not note:
                    break
                got = model.extract(f"{text}\n\n{note}")
            return got
        except Exception:  # noqa: BLE001 a model may fail in any way; the other chunks go on
            return {"entities": [], "facts": []}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [one(t or "") for t in b["content"]]
            yield pd.DataFrame({"chunk_uuid": b["uuid"].tolist(), "entities": [g["entities"] for g in got], "facts": [g["facts"] for g in got]})

    return chunks.select("uuid", "content").mapInPandas(run, "chunk_uuid string, entities array<struct<name:string,entity_type:string,summary:string>>, facts array<struct<subject:string,relationship:string,object:string,content:string,date_context:string,topics:array<string>>>")
