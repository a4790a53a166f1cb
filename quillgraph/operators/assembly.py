"""From extracted facts to graph rows: names to identifiers, remapping, edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ENTITY_TYPES = ("company", "person", "organization", "location", "product", "concept")


def entity_type(label: Column) -> Column:
    """One of the six types; any other label is a concept."""
    low = F.lower(F.trim(label))
    return F.when(low.isin(*ENTITY_TYPES), low).otherwise("concept")


def edges(facts: DataFrame) -> DataFrame:
    """One edge, subject to object, for each fact that names the chunk it comes from."""
    ours = facts.where(F.coalesce("chunk_uuid", F.lit("")) != "")
    return ours.select(F.concat(F.lit("r"), "uuid").alias("id"), F.col("subject_uuid").alias("from_uuid"), F.lit("entity").alias("from_type"), F.col("object_uuid").alias("to_uuid"), F.when(F.lower("object_type") == "topic", "topic").otherwise("entity").alias("to_type"), F.col("relationship_type").alias("rel_type"), "chunk_uuid", F.col("uuid").alias("fact_id"), "date_context", "group_id")


def name_map(entities: DataFrame, seq: str = "seq") -> DataFrame:
    """(name, uuid) of names and aliases in exact case; of an ambiguous name the entity with the greatest ``seq``."""
    every = entities.select(F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"), "uuid", seq)
    return every.groupBy("name").agg(F.max_by("uuid", F.struct(seq, "uuid")).alias("uuid"))


def remap(rows: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``column`` replaced by ``mapping`` (old_uuid, new_uuid) where it has an entry."""
    m = mapping.select(F.col("old_uuid").alias("__old"), F.col("new_uuid").alias("__new"))
    out = F.coalesce("__new", F.col(column))
    return rows.join(m, F.col(column) == F.col("__old"), "left").select(*(out.alias(column) if c == column else F.col(c) for c in rows.columns))


def resolve_facts(facts: DataFrame, names: DataFrame, chunks: DataFrame) -> DataFrame:
    """Facts whose subject and object both have an entity and whose chunk exists, with the two identifiers."""
    s, o = names.select(F.col("name").alias("subject_name"), F.col("uuid").alias("subject_uuid")), names.select(F.col("name").alias("object_name"), F.col("uuid").alias("object_uuid"))
    return facts.join(s, "subject_name").join(o, "object_name").join(chunks.select(F.col("uuid").alias("chunk_uuid")).distinct(), "chunk_uuid", "left_semi")


def with_vectors(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """``rows`` with the vector of their uuid, null where there is none."""
    return rows.join(vectors.select("uuid", "vector"), "uuid", "left")


def topic_names(facts: DataFrame) -> DataFrame:
    return facts.select(F.explode("topics").alias("name")).distinct()


def numbered(rows: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Rows numbered from 1 in the given order. For results small enough to be shown; a total order has one partition."""
    return rows.withColumn(name, F.row_number().over(W.orderBy(*order)))
