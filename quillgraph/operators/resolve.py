"""Resolution against what a knowledge base has: entities, and topics of a curated vocabulary. A decision without a model is the best candidate of at least a threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import vector

ENTITY = {"limit": 25, "threshold": 0.50}
TOPIC = {"limit": 15, "threshold": 0.40}
LIKELY_ENTITY, LIKELY_TOPIC = 0.90, 0.85


def candidates(rows: DataFrame, base: DataFrame, limit: int, threshold: float) -> DataFrame:
    """The most similar rows of the base, but not the row of the same key: what is resolved may be in the base already."""
    return vector.knn_join(rows, base, limit, threshold, others=True)


def registry(new: DataFrame, known: DataFrame, at: float = LIKELY_ENTITY, limit: int = ENTITY["limit"], threshold: float = ENTITY["threshold"]) -> DataFrame:
    """(uuid, match, score, is_new): each new entity with the known one it is, if its best candidate reaches ``at``."""
    best = candidates(new, known, min(limit, 1), max(threshold, at)).select(F.col("query").alias("uuid"), "match", "score")  # without a model only the first is asked for
    return new.select("uuid").join(best, "uuid", "left").withColumn("is_new", F.col("match").isNull())


def only_new(new: DataFrame, resolved: DataFrame) -> DataFrame:
    return new.join(resolved.where("not is_new"), "uuid", "left_anti")


def remapping(resolved: DataFrame) -> DataFrame:
    return resolved.where("not is_new").select(F.col("uuid").alias("old_uuid"), F.col("match").alias("new_uuid"))


def merged_summaries(new: DataFrame, known: DataFrame, resolved: DataFrame) -> DataFrame:
    """(uuid, summary): known summaries with those of what was matched to them appended in order, blank ones left out."""
    add = resolved.where("not is_new").join(new.select("uuid", "summary"), "uuid").where(F.trim(F.coalesce("summary", F.lit(""))) != "")
    added = add.groupBy(F.col("match").alias("uuid")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uuid", "summary"))), lambda x: x["summary"]), " ").alias("more"))
    return known.select("uuid", F.col("summary").alias("had")).join(added, "uuid").select("uuid", F.concat_ws(" ", F.nullif(F.trim("had"), F.lit("")), "more").alias("summary"))


def topics(asked: DataFrame, vocabulary: DataFrame, at: float = LIKELY_TOPIC, limit: int = TOPIC["limit"], threshold: float = TOPIC["threshold"]) -> DataFrame:
    """(spelling, uuid, score): every original spelling of (name, vector) with its topic; spellings that differ in case and blanks are asked once."""
    keyed = asked.withColumn("key", text.topic_key(F.col("name")))
    one = keyed.groupBy("key").agg(F.min_by("vector", "name").alias("vector")).withColumnRenamed("key", "uuid")
    best = candidates(one, vocabulary, min(limit, 1), max(threshold, at)).select(F.col("query").alias("key"), F.col("match").alias("uuid"), "score")
    return keyed.select("key", F.col("name").alias("spelling")).distinct().join(best, "key", "left").select("spelling", "uuid", "score")


def picked(decisions: DataFrame, cands: DataFrame) -> DataFrame:
    """Decisions (key, choice from 1) as the candidate of that rank; a choice out of range is no match, and of repeated keys the last by seq holds."""
    last = decisions.groupBy("key").agg(F.max_by("choice", "seq").alias("rank"))
    return last.join(cands.select(F.col("query").alias("key"), "rank", "match", "score"), ["key", "rank"], "left").select("key", "match", "score")


def ontology(rows: DataFrame) -> DataFrame:
    """(uuid, name, text) of an array of (uri, label, definition, synonyms): one row for the label and for each synonym, paired with the definition."""
    spelled = F.array_distinct(F.concat(F.array("label"), F.coalesce("synonyms", F.array().cast("array<string>"))))
    return rows.select(F.element_at(F.split("uri", "/"), -1).alias("uuid"), F.explode(spelled).alias("name"), "definition").select("uuid", "name", F.concat("name", F.lit(": "), F.coalesce("definition", F.lit(""))).alias("text"))


def two_stage_topics(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Vocabulary hits (name, score), each name once with its best score, joined to the base's topics by name."""
    best = hits.groupBy(F.lower("name").alias("k")).agg(F.max("score").alias("score"))
    return known.join(best, F.lower(known["name"]) == best["k"]).drop("k")


def hint_matches(hints: DataFrame, resolved: DataFrame) -> DataFrame:
    """(hint, name): one contains the other, regardless of case. Hints are those of one question, at most a few."""
    a, b = F.lower("hint"), F.lower("name")
    return resolved.select("name").join(F.broadcast(hints.select("hint")), a.contains(b) | b.contains(a)).select("hint", "name")


def returned_names(names: DataFrame, cands: DataFrame) -> DataFrame:
    """Candidates that a model named, which may have added a "(type)"."""
    k = names.select(F.lower(text.without_type_suffix(F.col("name"))).alias("k")).distinct()
    return cands.join(k, F.lower(cands["name"]) == F.col("k"), "left_semi")


def best_by_name(rows: DataFrame, score: str = "confidence") -> DataFrame:
    """One row a name regardless of case: the highest score, the earlier of equals; in the place where the name was first seen (column seq)."""
    w = W.partitionBy(F.lower("name"))
    ranked = rows.withColumn("rn", F.row_number().over(w.orderBy(F.desc(score), "seq"))).withColumn("first_seq", F.min("seq").over(w))
    return ranked.where("rn = 1").drop("rn")
