"""Lookups and traversals. Tables have a tenant; every operator takes it and filters each side, so partitions prune.

Names match regardless of case. Where a limit needs an order that the question doesn't
give, the identifier breaks ties, so results don't depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def scoped(df: DataFrame, group: str | None) -> DataFrame:
    return df if group is None else df.where(F.col("group_id") == group)


def same_name(column: str, name: str) -> Column:
    return F.lower(column) == name.lower()


def any_name(column: str, names: Iterable[str]) -> Column:
    return F.lower(column).isin(sorted({n.lower() for n in names}))


def by_uuid(df: DataFrame, uuid: str, group: str | None = None) -> DataFrame:
    return scoped(df, group).where(F.col("uuid") == uuid).limit(1)


def by_uuids(df: DataFrame, uuids: Iterable[str], group: str | None = None) -> DataFrame:
    """No row for no identifier."""
    return scoped(df, group).where(F.col("uuid").isin(sorted(set(uuids))))


def by_name(df: DataFrame, name: str, group: str | None = None) -> DataFrame:
    return scoped(df, group).where(same_name("name", name)).orderBy("uuid").limit(1)


def by_names(df: DataFrame, names: Iterable[str], group: str | None = None) -> DataFrame:
    return scoped(df, group).where(any_name("name", names))


def page(df: DataFrame, limit: int, offset: int = 0, group: str | None = None) -> DataFrame:
    return scoped(df, group).orderBy("name", "uuid").offset(offset).limit(limit)


def about(names: Iterable[str], mode: str = "around") -> Column:
    """Facts around names have one of them on either side; facts between names have them on both."""
    s, o = any_name("subject_name", names), any_name("object_name", names)
    if mode not in ("around", "between"):
        raise ValueError(f"mode is around or between, not {mode}")
    return s | o if mode == "around" else s & o


def entity_facts(facts: DataFrame, name: str, limit: int = 50, group: str | None = None) -> DataFrame:
    return scoped(facts, group).where(about([name])).orderBy("uuid").limit(limit)


def facts_for_entities(facts: DataFrame, names: Iterable[str], limit: int = 50, group: str | None = None) -> DataFrame:
    return scoped(facts, group).where(about(names)).orderBy(F.desc_nulls_last("date_context"), "uuid").limit(limit)


def facts_by_entities(facts: DataFrame, chunks: DataFrame, names: Iterable[str], mode: str = "around", since: str | None = None, until: str | None = None, limit: int = 50, group: str | None = None) -> DataFrame:
    """Facts about names, the newest document first; dates compare as text."""
    c = scoped(chunks, group).select(F.col("uuid").alias("chunk_uuid"), "document_date")
    found = scoped(facts, group).where(about(names, mode)).join(c, "chunk_uuid", "left")
    if since:
        found = found.where(F.col("document_date") >= since)
    if until:
        found = found.where(F.col("document_date") <= until)
    return found.orderBy(F.desc_nulls_last("document_date"), "uuid").limit(limit)


def _ends(rel: DataFrame) -> DataFrame:
    """Each edge once from either end. An edge is matched by identifier on one side or the other: two equi-joins, where an OR would be a nested loop."""
    return rel.select(F.col("from_uuid").alias("end"), "chunk_uuid").unionByName(rel.select(F.col("to_uuid").alias("end"), "chunk_uuid"))


def _chunk_rows(hit: DataFrame, chunks: DataFrame, documents: DataFrame, group: str | None) -> DataFrame:
    c = scoped(chunks, group).select(F.col("uuid").alias("chunk_uuid"), "content", "header_path", "document_uuid", "document_date")
    d = scoped(documents, group).select(F.col("uuid").alias("document_uuid"), F.col("name").alias("document_name"))
    return hit.join(c, "chunk_uuid").join(d, "document_uuid", "left")


_CHUNK = ["chunk_uuid", "content", "header_path", "document_uuid", "document_date", "document_name"]


def entity_chunks(entities: DataFrame, rel: DataFrame, chunks: DataFrame, documents: DataFrame, name: str, limit: int = 50, group: str | None = None) -> DataFrame:
    """Chunks of the edges at an entity, each once."""
    e = scoped(entities, group).where(same_name("name", name)).select(F.col("uuid").alias("end"))
    hit = _ends(scoped(rel, group)).join(e, "end", "left_semi").select("chunk_uuid").distinct()
    return _chunk_rows(hit, chunks, documents, group).select(*_CHUNK).orderBy("chunk_uuid").limit(limit)


def topic_chunks(topics: DataFrame, rel: DataFrame, chunks: DataFrame, documents: DataFrame, name: str, limit: int = 50, group: str | None = None) -> DataFrame:
    t = scoped(topics, group).where(same_name("name", name)).select(F.col("uuid").alias("to_uuid"))
    hit = scoped(rel, group).where("to_type = 'topic'").join(t, "to_uuid", "left_semi").select("chunk_uuid").distinct()
    return _chunk_rows(hit, chunks, documents, group).select(*_CHUNK).orderBy("chunk_uuid").limit(limit)


def neighbours(entities: DataFrame, rel: DataFrame, name: str, limit: int = 20, group: str | None = None, direction: str = "out") -> DataFrame:
    """(name, summary, entity_type, n) of entities that edges lead to, most edges first; direction: out, in or both."""
    e, r = scoped(entities, group), scoped(rel, group)
    start = e.where(same_name("name", name)).select(F.col("uuid").alias("a"))
    out = r.where("to_type = 'entity'").select(F.col("from_uuid").alias("a"), F.col("to_uuid").alias("b"))
    back = r.where("to_type = 'entity'").select(F.col("to_uuid").alias("a"), F.col("from_uuid").alias("b"))
    pairs = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    other = e.where(~same_name("name", name)).select(F.col("uuid").alias("b"), "name", "summary", "entity_type")
    found = pairs.join(start, "a", "left_semi").groupBy("b").agg(F.count("*").alias("k")).join(other, "b")
    return found.groupBy("name", "summary", "entity_type").agg(F.sum("k").alias("n")).orderBy(F.desc("n"), "name", "summary", "entity_type").limit(limit)


def neighbour_chunks(entities: DataFrame, rel: DataFrame, chunks: DataFrame, name: str, limit: int = 20, each: int = 10, group: str | None = None) -> DataFrame:
    """Two hops in one plan: chunks of the neighbours' edges, at most ``each`` of a neighbour."""
    near = neighbours(entities, rel, name, limit, group).select("name").alias("n")
    ends = scoped(entities, group).join(near, "name", "left_semi").select(F.col("uuid").alias("end"), F.col("name").alias("neighbour"))
    hit = _ends(scoped(rel, group)).join(ends, "end").select("neighbour", "chunk_uuid").distinct()
    known = hit.join(scoped(chunks, group).select(F.col("uuid").alias("chunk_uuid"), "header_path", "document_date"), "chunk_uuid")
    rank = F.row_number().over(W.partitionBy("neighbour").orderBy("chunk_uuid"))
    return known.withColumn("rank", rank).where(F.col("rank") <= each).select("neighbour", "chunk_uuid", "header_path", "document_date", "rank")


def with_document(facts: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Facts with the name of the document of their chunk, "Unknown" where there is none."""
    c = chunks.select(F.col("uuid").alias("chunk_uuid"), "document_uuid")
    d = documents.select(F.col("uuid").alias("document_uuid"), F.col("name").alias("document_name"))
    return facts.join(c, "chunk_uuid", "left").join(d, "document_uuid", "left").withColumn("document_name", F.coalesce("document_name", F.lit("Unknown")))


def counts(**tables: DataFrame) -> DataFrame:
    """(kind, n) in one job."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def listing(entities: DataFrame, facts: DataFrame, kind: str | None = None, limit: int = 20, group: str | None = None) -> DataFrame:
    """Entities by name with how many facts have them as subject or object; the type is looked at after the limit, so fewer may be left."""
    some = scoped(entities, group).orderBy("name", "uuid").limit(limit)
    if kind:
        some = some.where(F.upper("entity_type") == kind.upper())
    f = scoped(facts, group)
    ends = f.select(F.col("subject_uuid").alias("uuid")).unionByName(f.where("object_uuid <> subject_uuid").select(F.col("object_uuid").alias("uuid")))
    per = ends.join(F.broadcast(some.select("uuid")), "uuid", "left_semi").groupBy("uuid").agg(F.count("*").alias("n_facts"))
    return some.join(per, "uuid", "left").select("uuid", "name", "entity_type", F.coalesce("n_facts", F.lit(0)).cast("long").alias("n_facts"))


def relationship_types(facts: DataFrame, name: str, group: str | None = None) -> DataFrame:
    return scoped(facts, group).where(same_name("subject_name", name)).select("relationship_type").distinct()


def targets(facts: DataFrame, name: str, relationship_type: str, group: str | None = None) -> DataFrame:
    return scoped(facts, group).where(same_name("subject_name", name) & (F.col("relationship_type") == relationship_type)).select("object_name").distinct()


def find(entities: DataFrame, facts: DataFrame, like: str | None = None, kind: str | None = None, has: str | None = None, least: int = 0, month: str | None = None, group: str | None = None) -> DataFrame:
    """Entities by name pattern, type, a relationship they are subject of, and at least so many facts (of a month)."""
    out, f = scoped(entities, group), scoped(facts, group)
    if like:
        out = out.where(F.lower("name").like(like.lower()))
    if kind:
        out = out.where(F.col("entity_type") == kind)
    if has:
        out = out.join(f.where(F.col("relationship_type") == has).select(F.col("subject_uuid").alias("uuid")), "uuid", "left_semi")
    if least:
        f = f.where(F.col("date_context") == month) if month else f
        out = out.join(f.groupBy(F.col("subject_uuid").alias("uuid")).agg(F.count("*").alias("n_facts")).where(F.col("n_facts") >= least), "uuid")
    return out


def word_count(entities: DataFrame, facts: DataFrame) -> DataFrame:
    """(what, kind, n): entities by type and facts by relationship, each with the total of kind null."""
    e = entities.rollup("entity_type").agg(F.count("*").alias("n")).select(F.lit("entities").alias("what"), F.col("entity_type").alias("kind"), "n")
    r = facts.rollup("relationship_type").agg(F.count("*").alias("n")).select(F.lit("facts").alias("what"), F.col("relationship_type").alias("kind"), "n")
    return e.unionByName(r)


def triples(facts: DataFrame) -> DataFrame:
    """(triple): facts as N-Triples lines; identifiers are percent-encoded."""
    iri = lambda c: F.concat(F.lit("<urn:kg:"), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit(">"))
    return facts.select(F.concat_ws(" ", iri("subject_uuid"), iri("relationship_type"), iri("object_uuid"), F.lit(".")).alias("triple"))
