"""The context of an answer: duplicates go, relevant and less relevant chunks part, each kind has its cap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HIGH, CAPS = 0.45, {"high": 30, "low": 20, "topic": 15, "fact": 40}
SCORES = {"entity": 0.5, "neighbour": 0.4, "topic": 0.5, "fact": 0.5}


def best_of(rows: DataFrame, key: str, score: str = "vector_score", seq: str = "seq") -> DataFrame:
    """One row a key: the highest score, the earliest of equals. ``first_seq`` is where the key was first seen, which orders equal scores."""
    w = W.partitionBy(key)
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(score), seq))).withColumn("first_seq", F.min(seq).over(w))
    return ranked.where("rn = 1").drop("rn")


def shaped(chunks: DataFrame, kind: str, name: str) -> DataFrame:
    return chunks.withColumn("vector_score", F.lit(SCORES[kind])).withColumn("source", F.lit(f"{kind}:{name}"))


def split(chunks: DataFrame, high: float = HIGH, caps: dict[str, int] = CAPS) -> DataFrame:
    """Deduplicated (chunk_id, vector_score, seq) with tier high or low and rank in it, within the caps."""
    rows, out = best_of(chunks, "chunk_id"), None
    for tier, part in (("high", F.col("vector_score") >= high), ("low", F.coalesce(F.col("vector_score") < high, F.lit(True)))):
        # a top-k in each partition and one of these; only what is left is ranked
        some = rows.where(part).orderBy(F.desc("vector_score"), "first_seq").limit(caps[tier]).withColumn("tier", F.lit(tier))
        some = some.withColumn("rank", F.row_number().over(W.partitionBy("tier").orderBy(F.desc("vector_score"), "first_seq")))
        out = some if out is None else out.unionByName(some)
    return out


def top_facts(facts: DataFrame, limit: int = CAPS["fact"]) -> DataFrame:
    return best_of(facts, "fact_id").orderBy(F.desc("vector_score"), "first_seq").limit(limit)


def global_chunks(fact_hits: DataFrame) -> DataFrame:
    """(chunk_uuid, score): chunks by the best of their facts."""
    return fact_hits.where("chunk_uuid <> ''").groupBy("chunk_uuid").agg(F.max("score").alias("score"))


def prompt(sections: dict[str, list[str]], excerpt: int = 200) -> str:
    """Sections in the given order, with their lines cut to an excerpt; empty ones are left out."""
    cut = lambda t: t if len(t) <= excerpt else t[:excerpt] + "..."
    return "\n\n".join(f"## {title}\n" + "\n".join(f"- {cut(x)}" for x in rows) for title, rows in sections.items() if rows)
