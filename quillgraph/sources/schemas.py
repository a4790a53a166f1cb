"""The tables of a knowledge base: six of the graph, four of vectors. Every one has a tenant, ``group_id``."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str, **other: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in text.split()])


_NAMES = T.ArrayType(T.StringType())
_VECTOR = T.ArrayType(T.FloatType(), False)

TABLES: dict[str, T.StructType] = {
    "entities": _struct("uuid name summary entity_type aliases created_at updated_at group_id", aliases=_NAMES),
    "chunks": _struct("uuid content header_path position document_uuid document_date created_at group_id", position=T.IntegerType()),
    "facts": _struct("uuid content subject_uuid subject_name object_uuid object_name object_type relationship_type date_context chunk_uuid created_at group_id"),
    "topics": _struct("uuid name definition parent_topic created_at group_id"),
    "documents": _struct("uuid name document_date source_path file_type metadata created_at group_id"),
    "relationships": _struct("id from_uuid from_type to_uuid to_type rel_type chunk_uuid fact_id description date_context created_at group_id"),
    "vectors_entities": _struct("uuid name summary vector group_id", vector=_VECTOR),
    "vectors_chunks": _struct("uuid content header_path document_uuid vector group_id", vector=_VECTOR),
    "vectors_facts": _struct("uuid content subject_name object_name relationship_type vector group_id", vector=_VECTOR),
    "vectors_topics": _struct("uuid name definition vector group_id", vector=_VECTOR),
}
