"""A knowledge base as an object: ingest, search, question answering and statistics over a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.providers import Embeddings, HashEmbeddings, LanguageModel, RuleModel, embedded, extracted
from quillgraph.functions.text import content_id, named_text, topic_key
from quillgraph.operators import assembly, cluster, context, graph, resolve, vector
from quillgraph.sources.config import Config
from quillgraph.sources.shared import written
from quillgraph.sources.store import Store

Progress = Callable[[str, float], None]


@dataclass
class Ingested:
    documents: int
    chunks: int
    entities: int
    facts: int
    relationships: int


@dataclass
class Answer:
    question: str
    question_type: str
    text: str
    confidence: float
    sub_answers: list[tuple[str, str, float]] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)


class KnowledgeBase:
    def __init__(self, spark: SparkSession, config: Config | None = None, embeddings: Embeddings | None = None, model: LanguageModel | None = None) -> None:
        self.spark, self.config = spark, config or Config()
        self.embeddings, self.model = embeddings or HashEmbeddings(self.config.embedding_dimensions), model or RuleModel()
        self.store = Store(spark, self.config.path, self.config.group_id, self.embeddings.dimensions)

    # ingest

    def ingest_markdown(self, docs: DataFrame, document_date: str | None = None, max_chunks: int | None = None, progress: Progress = lambda stage, done: None) -> Ingested:
        """Documents (name, content). Ingesting the same content again adds nothing."""
        before = self._sizes()
        progress("chunking", 0.0)
        known = self.store.read("chunks").select("uuid")
        known = written(known)
        self.store.add_markdown(docs, document_date, max_chunks)
        progress("chunking", 1.0)
        self._build(self.store.read("chunks").join(known, "uuid", "left_anti"), progress)
        after = self._sizes()
        return Ingested(*(after[k] - before[k] for k in ("documents", "chunks", "entities", "facts", "relationships")))

    def ingest_chunks(self, chunks: DataFrame, document_date: str | None = None, progress: Progress = lambda stage, done: None) -> Ingested:
        before = self._sizes()
        known = written(self.store.read("chunks").select("uuid"))
        self.store.add_chunks(chunks, document_date)
        self._build(self.store.read("chunks").join(known, "uuid", "left_anti"), progress)
        after = self._sizes()
        return Ingested(*(after[k] - before[k] for k in ("documents", "chunks", "entities", "facts", "relationships")))

    def _sizes(self) -> dict[str, int]:
        return {r["kind"]: r["n"] for r in graph.counts(**{t: self.store.read(t) for t in ("documents", "chunks", "entities", "facts", "relationships")}).collect()}

    def _build(self, new_chunks: DataFrame, progress: Progress) -> None:
        chunks, cfg = written(new_chunks), self.config
        progress("extraction", 0.0)
        got = written(extracted(chunks, self.model))
        progress("extraction", 1.0)
        progress("deduplication", 0.0)
        raw = got.select("chunk_uuid", F.posexplode("entities").alias("pos", "e")).select("chunk_uuid", "pos", "e.*").where("trim(name) <> ''")
        first = W.partitionBy("name").orderBy("chunk_uuid", "pos")
        one = raw.withColumn("rn", F.row_number().over(first)).where("rn = 1").select(content_id(F.col("name")).alias("uuid"), F.xxhash64("name").alias("seq"), "name", assembly.entity_type(F.col("entity_type")).alias("entity_type"), "summary")
        one = written(embedded(one.withColumn("text", named_text(F.col("name"), F.coalesce("summary", F.lit("")))), "text", self.embeddings).drop("text"))
        canon = written(cluster.deduplicate(one, cfg.dedup_threshold, cfg.dedup_batch, self.model.same))
        progress("deduplication", 0.5)
        progress("resolution", 0.0)
        canon = written(embedded(canon.withColumn("text", named_text(F.col("name"), F.col("summary"))), "text", self.embeddings).drop("text"))
        known = written(self.store.read("vectors_entities").select("uuid", "name", "summary", "vector"))
        resolved = written(resolve.registry(canon, known, limit=cfg.registry_candidates, threshold=cfg.registry_threshold))
        mapping = written(resolve.remapping(resolved))
        new = resolve.only_new(canon, resolved)
        progress("resolution", 1.0)
        progress("assembly", 0.0)
        names = assembly.remap(assembly.name_map(canon.withColumn("seq", F.col("uuid"))), "uuid", mapping)
        facts = got.select("chunk_uuid", F.explode("facts").alias("f")).select("chunk_uuid", F.col("f.subject").alias("subject_name"), F.col("f.object").alias("object_name"), F.col("f.relationship").alias("relationship_type"), F.col("f.content").alias("content"), F.col("f.date_context").alias("date_context"), F.lit("entity").alias("object_type"))
        facts = assembly.resolve_facts(facts, names, chunks).withColumn("uuid", content_id(F.col("chunk_uuid"), F.col("subject_name"), F.col("relationship_type"), F.col("object_name"), F.col("content")))
        facts = written(facts)
        changes = written(resolve.merged_summaries(canon, known, resolved))
        self.store.merge("entities", new)
        self.store.merge("vectors_entities", new)
        self.store.merge("facts", facts)
        self.store.merge("vectors_facts", embedded(facts, "content", self.embeddings))
        self.store.merge("vectors_chunks", embedded(chunks.select("uuid", "content", "header_path", "document_uuid"), "content", self.embeddings))
        self.store.merge("relationships", assembly.edges(facts.withColumn("group_id", F.lit(self.store.group))), "id")
        if changes.limit(1).count():
            self.store.update_summaries(changes)
        progress("assembly", 1.0)

    def load_ontology(self, rows: DataFrame) -> None:
        """The vocabulary of topics (uri, label, definition, synonyms) in place of the one before; spellings have vectors of their own."""
        spelled = resolve.ontology(rows)
        vocab = Store(self.spark, self.config.path, "ontology")
        vocab.replace("topics", rows.select(F.element_at(F.split("uri", "/"), -1).alias("uuid"), F.col("label").alias("name"), "definition"))
        vectors = embedded(spelled, "text", self.embeddings).select(content_id(F.col("uuid"), topic_key(F.col("name"))).alias("uuid"), "name", F.col("text").alias("definition"), "vector")
        vocab.replace("vectors_topics", vectors)

    # search

    def _search(self, table: str, full: str, text: str, limit: int, threshold: float) -> DataFrame:
        hits = vector.knn(self.store.read(f"vectors_{table}"), self.embeddings.embed_one(text), limit, threshold)
        return vector.enrich(hits, self.store.read(full))

    def search_entities(self, text: str, limit: int = 10, threshold: float = 0.3) -> DataFrame:
        return self._search("entities", "entities", text, limit, threshold)

    def search_facts(self, text: str, limit: int = 20, threshold: float = 0.3) -> DataFrame:
        return self._search("facts", "facts", text, limit, threshold)

    def search_chunks(self, text: str, limit: int = 10, threshold: float = 0.3) -> DataFrame:
        return self._search("chunks", "chunks", text, limit, threshold)

    def search_topics(self, text: str, limit: int = 20, threshold: float = 0.35) -> DataFrame:
        return vector.knn(self.store.read("vectors_topics", "ontology"), self.embeddings.embed_one(text), limit, threshold)

    def hybrid(self, names: list[str], text: str | None, mode: str = "around", since: str | None = None, until: str | None = None, limit: int = 20) -> DataFrame:
        """Facts about names, the newest first; with a text, the most similar of three times as many."""
        s = self.store
        found = graph.facts_by_entities(s.read("facts"), s.read("chunks"), names, mode, since, until, limit * 3 if text else limit)
        if text:
            found = vector.enrich(vector.among(s.read("vectors_facts"), found, self.embeddings.embed_one(text), limit), found)
        return graph.with_document(found, s.read("chunks").drop("document_date"), s.read("documents"))

    # questions

    def decompose(self, question: str) -> dict:
        try:
            got = self.model.decompose(question)
        except Exception:  # noqa: BLE001 the rules always give something to go on with
            got = RuleModel().decompose(question)
        got["sub_queries"] = got["sub_queries"][: self.config.max_sub_queries]
        return got

    def _context(self, hints: list[str], asked: str) -> tuple[str, list[str]]:
        s, cfg = self.store, self.config
        entities, rel, chunks, docs = s.read("entities"), s.read("relationships"), s.read("chunks"), s.read("documents")
        cands = written(self.search_entities(asked, cfg.query_entity_candidates, cfg.query_entity_threshold).select("uuid", "name", "summary", "score"))
        if hints:
            asked_for = self.spark.createDataFrame([(h,) for h in hints], "hint string")
            names = {r["name"] for r in resolve.hint_matches(asked_for, entities.select("name")).groupBy("name").count().orderBy(F.length("name"), "name").limit(50).collect()}  # the shortest names
        else:
            names = {r["name"] for r in cands.orderBy(F.desc("score"), "uuid").limit(3).collect()}
        parts, facts = [], graph.facts_for_entities(s.read("facts"), names, 100) if names else None
        for k, n in enumerate(sorted(names)):
            own = graph.entity_chunks(entities, rel, chunks, docs, n, 50).select(F.col("chunk_uuid").alias("chunk_id"), "content", "document_name")
            parts.append(context.shaped(own, "entity", n).withColumn("seq", F.concat(F.lit(f"a{k:04d}"), "chunk_id")))
            if cfg.expand_neighbours:
                far = graph.neighbour_chunks(entities, rel, chunks, n).select(F.col("chunk_uuid").alias("uuid")).distinct().join(chunks, "uuid").select(F.col("uuid").alias("chunk_id"), "content", F.lit(None).cast("string").alias("document_name"))
                parts.append(context.shaped(far, "neighbour", n).withColumn("seq", F.concat(F.lit(f"b{k:04d}"), "chunk_id")))
        near = self.search_chunks(asked).select(F.col("uuid").alias("chunk_id"), "content", F.lit(None).cast("string").alias("document_name"), F.col("score").alias("vector_score"), F.lit("global").alias("source"), F.concat(F.lit("c"), "uuid").alias("seq"))
        every = near
        for p in parts:
            every = every.unionByName(p)
        tiers = context.split(every, cfg.high_relevance).orderBy("tier", "rank").collect()  # at most 50 rows
        lines = {"Facts": [r["content"] for r in facts.limit(40).collect()] if facts is not None else [], "Relevant passages": [r["content"] for r in tiers if r["tier"] == "high"], "Other passages": [r["content"] for r in tiers if r["tier"] == "low"], "Entities": [f"{r['name']}: {r['summary']}" for r in cands.collect()]}
        return context.prompt(lines), sorted({r["source"] for r in tiers})

    def ask(self, question: str) -> Answer:
        plan = self.decompose(question)
        subs, sources = [], []
        for q in plan["sub_queries"]:
            text, seen = self._context(q["entity_hints"], question)
            answer, sure = self.model.answer(q["text"], text) if text else ("There is nothing about this in the knowledge base.", 0.0)
            subs.append((q["text"], answer, sure))
            sources += seen
        good = [x for x in subs if x[2] > 0]
        if not good:
            return Answer(question, plan["question_type"], "There is nothing about this in the knowledge base.", 0.0, subs)
        if len(good) == 1:
            text, sure = good[0][1], good[0][2]
        else:
            text, sure = " ".join(a for _, a, _ in good), sum(c for *_, c in good) / len(good) * 0.8
        return Answer(question, plan["question_type"], text, sure, subs, sorted(set(sources)))

    # lookups

    def entity(self, name: str) -> DataFrame:
        return graph.by_name(self.store.read("entities"), name)

    def neighbours(self, name: str, limit: int = 20) -> DataFrame:
        return graph.neighbours(self.store.read("entities"), self.store.read("relationships"), name, limit)

    def stats(self) -> dict[str, int]:
        return self.store.stats()
