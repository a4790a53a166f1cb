"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import assembly, chunking, cluster, context, graph, resolve, telemetry, vector
from quillgraph.sources import star
from quillgraph.sources.shared import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_S1, _G = "Supplier#000000001", "default"
_TWO = [_S1, "SUPPLIER#000000002"]


def query(sql: str | None = None, kg: bool = True) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"with {'recursive ' if 'recursive_' in sql else ''}{star.SQL}{', ' if sql.startswith(',') else ' '}{sql.removeprefix(',')}" if kg else sql
        return f

    return put


def _kg(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    f = star.facts(spark, d)
    return star.entities(spark, d), f, star.relationships(f), star.chunks(spark, d), star.documents(spark, d).drop("group_id").withColumn("group_id", F.lit(_G))


def _first(spark: SparkSession, d: str) -> list[float]:
    return star.table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0]


@query("select 'documents' kind, count(*) n from docs union all select 'entities', count(*) from entities union all select 'chunks', count(*) from chunks union all select 'facts', count(*) from facts")
def kg_stats(spark, d):
    e, f, _, c, docs = _kg(spark, d)
    return graph.counts(documents=docs, entities=e, chunks=c, facts=f)


@query(f"select uuid, name, entity_type, summary from entities where lower(name) = lower('{_S1.upper()}') order by uuid limit 1")
def entity_by_name_ci(spark, d):
    return graph.by_name(star.entities(spark, d), _S1.upper(), _G).select("uuid", "name", "entity_type", "summary")


@query("select uuid, name, entity_type, summary from entities where uuid in ('s1', 'p2', 'c3', 'x')")
def entities_multi_get(spark, d):
    return graph.by_uuids(star.entities(spark, d), ["s1", "p2", "c3", "x"], _G).select("uuid", "name", "entity_type", "summary")


@query("select uuid, name, entity_type from entities order by name, uuid limit 50 offset 20")
def entities_page(spark, d):
    return graph.page(star.entities(spark, d), 50, 20, _G).select("uuid", "name", "entity_type")


@query("select uuid, name, definition from topics where lower(name) in ('economy', 'promo')")
def topics_by_names_ci(spark, d):
    return graph.by_names(star.topics(spark, d), ["Economy", "promo", "none"], _G).select("uuid", "name", "definition")


_F = "uuid, subject_name, relationship_type, object_name, date_context, chunk_uuid"
_FC = _F.split(", ")
_AROUND = f"(lower(subject_name) in ('{_TWO[0].lower()}', '{_TWO[1].lower()}') or lower(object_name) in ('{_TWO[0].lower()}', '{_TWO[1].lower()}'))"


@query(f"select {_F} from facts where group_id = 'default' and (lower(subject_name) = '{_S1.lower()}' or lower(object_name) = '{_S1.lower()}') order by uuid limit 50")
def entity_facts(spark, d):
    return graph.entity_facts(star.facts(spark, d), _S1, 50, _G).select(*_FC)


@query(f"select {_F} from facts where group_id = 'default' and {_AROUND} order by date_context desc nulls last, uuid limit 50")
def facts_for_entities(spark, d):
    return graph.facts_for_entities(star.facts(spark, d), _TWO, 50, _G).select(*_FC)


_J4 = "from facts f left join (select uuid cu, document_date from chunks where group_id = 'default') on chunk_uuid = cu where group_id = 'default' and"


@query(f"select {_F}, document_date {_J4} {_AROUND} order by document_date desc nulls last, uuid limit 100")
def facts_around(spark, d):
    return graph.facts_by_entities(star.facts(spark, d), star.chunks(spark, d), _TWO, limit=100, group=_G).select(*_FC, "document_date")


@query(f"select {_F}, document_date {_J4} lower(subject_name) in ('{_S1.lower()}', 'economy') and lower(object_name) in ('{_S1.lower()}', 'economy') order by document_date desc nulls last, uuid limit 100")
def facts_between(spark, d):
    return graph.facts_by_entities(star.facts(spark, d), star.chunks(spark, d), [_S1, "Economy"], "between", limit=100, group=_G).select(*_FC, "document_date")


@query(f"select {_F}, document_date {_J4} {_AROUND} and document_date >= '2024-02' and document_date <= '2024-05' order by document_date desc nulls last, uuid limit 100")
def facts_around_dated(spark, d):
    return graph.facts_by_entities(star.facts(spark, d), star.chunks(spark, d), _TWO, since="2024-02", until="2024-05", limit=100, group=_G).select(*_FC, "document_date")


@query(f"""select distinct c.uuid chunk_uuid, content, header_path, document_uuid, document_date, dn.name document_name from entities e join relationships r on r.from_uuid = e.uuid or r.to_uuid = e.uuid
  join chunks c on c.uuid = r.chunk_uuid and c.group_id = 'default' left join docs dn on dn.uuid = c.document_uuid where r.group_id = 'default' and lower(e.name) = '{_S1.lower()}' order by chunk_uuid limit 50""")
def entity_chunks(spark, d):
    e, _, r, c, docs = _kg(spark, d)
    return graph.entity_chunks(e, r, c, docs, _S1, 50, _G)


_NEAR = f"""select n.name, n.summary, n.entity_type, count(*) n from entities e join relationships r on r.from_uuid = e.uuid and r.to_type = 'entity' join entities n on n.uuid = r.to_uuid
  where r.group_id = 'default' and lower(e.name) = '{_S1.lower()}' and lower(n.name) <> '{_S1.lower()}' group by n.name, n.summary, n.entity_type order by n desc, n.name, n.summary, n.entity_type limit 20"""


@query(_NEAR)
def entity_neighbors(spark, d):
    e, _, r, _, _ = _kg(spark, d)
    return graph.neighbours(e, r, _S1, 20, _G)


@query("""select distinct c.uuid chunk_uuid, content, header_path, document_uuid, document_date, dn.name document_name from topics t join relationships r on r.to_uuid = t.uuid and r.to_type = 'topic'
  join chunks c on c.uuid = r.chunk_uuid and c.group_id = 'default' left join docs dn on dn.uuid = c.document_uuid where r.group_id = 'default' and lower(t.name) = 'economy' order by chunk_uuid limit 50""")
def topic_chunks(spark, d):
    _, _, r, c, docs = _kg(spark, d)
    return graph.topic_chunks(star.topics(spark, d), r, c, docs, "economy", 50, _G)


@query(f""", near as ({_NEAR}), hop as (select distinct e.name neighbour, r.chunk_uuid from near n join entities e on e.name = n.name join relationships r on (r.from_uuid = e.uuid or r.to_uuid = e.uuid) and r.group_id = 'default')
  select neighbour, chunk_uuid, header_path, document_date, rank from (select neighbour, chunk_uuid, header_path, document_date, cast(row_number() over (partition by neighbour order by chunk_uuid) as int) rank
  from hop join chunks c on c.uuid = chunk_uuid and c.group_id = 'default') where rank <= 10""")
def neighbor_chunks_2hop(spark, d):
    e, _, r, c, _ = _kg(spark, d)
    return graph.neighbour_chunks(e, r, c, _S1, 20, 10, _G)


@query("select f.uuid, coalesce(dn.name, 'Unknown') document_name from facts f left join chunks c on c.uuid = f.chunk_uuid left join docs dn on dn.uuid = c.document_uuid")
def fact_document_enrich(spark, d):
    _, f, _, c, docs = _kg(spark, d)
    return graph.with_document(f, c, docs).select("uuid", "document_name")


_COS = "list_cosine_similarity(vector, (select vector from vectors where vec_id = 0))"


@query(f"select uuid, round(score, 6) score from (select uuid, {_COS} score from vectors order by score desc, uuid limit 20) where score >= 0.3")
def knn_entities(spark, d):
    return vector.knn(star.vectors(spark, d), _first(spark, d)).select("uuid", F.round("score", 6).alias("score"))


@query(f"select uuid, label, round(score, 6) score from (select uuid, label, {_COS} score from vectors where label = 3 order by score desc, uuid limit 20)where score >= 0")
def knn_by_uuids(spark, d):
    v = star.vectors(spark, d)
    return vector.enrich(vector.among(v, v.where("label = 3"), _first(spark, d)), v).select("uuid", "label", F.round("score", 6).alias("score"))


_VF = "'v' || (cast(substr(object_uuid, 2) as bigint) % (select count(*) from vectors))"


@query(f""", st as (select f.*, document_date {_J4} {_AROUND} and object_type = 'entity' order by document_date desc nulls last, f.uuid limit 60)
  select uuid, round(score, 6) score from (select st.uuid, {_COS} score from st join vectors v on v.uuid = {_VF} order by score desc, st.uuid limit 20) where score >= 0""")
def hybrid_search(spark, d):
    f = star.facts(spark, d).where("object_type = 'entity'")
    some = graph.facts_by_entities(f, star.chunks(spark, d), _TWO, limit=60, group=_G)
    v = star.vectors(spark, d)
    n = v.count()
    fv = some.select(F.col("uuid").alias("fact"), F.expr(f"concat('v', cast(substr(object_uuid, 2) as bigint) % {n})").alias("uuid")).join(v.select("uuid", "vector"), "uuid").select(F.col("fact").alias("uuid"), "vector")
    return vector.knn(fv, _first(spark, d), 20, 0.0).select("uuid", F.round("score", 6).alias("score"))


@query("""select * from (select a.uuid "query", b.uuid "match", round(list_cosine_similarity(a.vector, b.vector), 6) score, cast(row_number() over (partition by a.uuid order by list_cosine_similarity(a.vector, b.vector) desc, b.uuid) as int) rank
  from vectors a join vectors b on a.uuid <> b.uuid and list_cosine_similarity(a.vector, b.vector) >= 0.3) where rank <= 25""")
def knn_batch_join(spark, d):
    v = star.vectors(spark, d)
    return vector.knn_join(v, v, 25, 0.3, others=True).withColumn("score", F.round("score", 6))


_PAIRS = "select a.uuid a, b.uuid b, list_cosine_similarity(a.vector, b.vector) score from vectors a join vectors b on a.uuid < b.uuid and list_cosine_similarity(a.vector, b.vector) >= {}"


@query(f"select a, b, round(score, 6) score from ({_PAIRS.format(0.4)})")
def similarity_edges(spark, d):
    return vector.pairs(star.vectors(spark, d), 0.4).withColumn("score", F.round("score", 6))


@query("select a, b, 0.99::double score from (select min(uuid) over (partition by lower(trim(name))) a, uuid b from (select 'p' || p_partkey uuid, p_name name from part)) where a <> b")
def same_name_edges(spark, d):
    p = star.table(spark, d, "part").selectExpr("concat('p', p_partkey) uuid", "p_name name")
    return cluster.same_name_pairs(p)


_COMP = """, e as (select a, b from (""" + _PAIRS.format(0.35) + """) union all select b, a from (""" + _PAIRS.format(0.35) + """)), recursive_reach(uuid, root) as (select uuid, uuid from vectors union select r.uuid, e.b from recursive_reach r join e on e.a = r.root),
 comp as (select uuid, min(root) root from recursive_reach group by uuid)"""


def _entities_with_vectors(spark: SparkSession, d: str) -> DataFrame:
    return star.vectors(spark, d).selectExpr("uuid", "vec_id seq", "concat('Entity ', uuid) name", "case label % 3 when 0 then 'company' when 1 then 'person' else 'concept' end entity_type", "case when vec_id % 4 = 0 then ' ' else concat('About ', uuid) end summary", "vector")


@query(_COMP + " select uuid, root from comp")
def entity_components(spark, d):
    v = star.vectors(spark, d)
    return cluster.components(v, vector.links(v, 0.35))


_CANON = _COMP + """, rows as (select v.uuid, root, vec_id, 'Entity ' || v.uuid name, case label % 3 when 0 then 'company' when 1 then 'person' else 'concept' end entity_type, case when vec_id % 4 = 0 then '' else 'About ' || v.uuid end summary from vectors v join comp on comp.uuid = v.uuid)"""


@query(_CANON + """ select root uuid, first(name order by vec_id) name, first(entity_type order by vec_id) entity_type, coalesce(string_agg(summary, ' ' order by vec_id) filter (summary <> ''), '') summary,
  coalesce(array_to_string(list(name order by vec_id)[2:], '|'), '') aliases, count(*) n from rows group by root""")
def dedup_canonical(spark, d):
    c = cluster.deduplicate(_entities_with_vectors(spark, d), 0.35)
    return c.select("uuid", "name", "entity_type", "summary", F.array_join("aliases", "|").alias("aliases"), F.size("members").cast("long").alias("n"))


@query(_CANON + ' select root canonical, uuid "member", cast(row_number() over (partition by root order by vec_id) - 1 as int) "position" from rows qualify count(*) over (partition by root) > 1')
def merge_history(spark, d):
    return cluster.merge_history(cluster.deduplicate(_entities_with_vectors(spark, d), 0.35))


_BEST = """(select a.uuid, b.uuid "match", list_cosine_similarity(a.vector, b.vector) score, row_number() over (partition by a.uuid order by list_cosine_similarity(a.vector, b.vector) desc, b.uuid) rank
  from vectors a join vectors b on a.uuid <> b.uuid)"""


@query(f"""select v.uuid, x."match", round(x.score, 6) score, x."match" is null is_new from vectors v left join (select * from {_BEST} where rank = 1 and score >= 0.35) x on x.uuid = v.uuid""")
def registry_resolve(spark, d):
    v = star.vectors(spark, d)
    return resolve.registry(v, v, 0.35, threshold=0.3).withColumn("score", F.round("score", 6))


@query(f"""select v.uuid, 'known' state from vectors v join {_BEST} x on x.uuid = v.uuid where rank = 1 and score >= 0.35 union all select v.uuid, 'new' from vectors v where v.uuid not in (select uuid from {_BEST} where rank = 1 and score >= 0.35)""")
def registry_split(spark, d):
    v = star.vectors(spark, d)
    r = written(resolve.registry(v, v, 0.35, threshold=0.3))  # read twice, compared once
    return resolve.remapping(r).select(F.col("old_uuid").alias("uuid"), F.lit("known").alias("state")).unionByName(resolve.only_new(v, r).select("uuid", F.lit("new").alias("state")))


@query(f"""select spelling, 't' || x."match" uuid, round(x.score, 6) score from (select uuid, ' ' || upper('t' || uuid) spelling from vectors union all select uuid, 't' || uuid from vectors) s
  left join (select * from {_BEST} where rank = 1 and score >= 0.35) x on x.uuid = s.uuid""")
def topic_fanout(spark, d):
    v = star.vectors(spark, d)
    asked = v.select(F.explode(F.expr("array(concat(' ', upper(concat('t', uuid))), concat('t', uuid))")).alias("name"), "vector")
    return resolve.topics(asked, v.withColumn("uuid", F.concat(F.lit("t"), "uuid")), 0.35, threshold=0.3).withColumn("score", F.round("score", 6))


@query("""select 't' || replace(p_name, ' ', '-') uuid, n as name, n || ': parts like ' || p_name as "text" from (select distinct p_name from part), unnest([p_name, upper(p_name)]) u(n)""")
def ontology_expand(spark, d):
    rows = star.table(spark, d, "part").select("p_name").distinct().selectExpr("concat('https://example.org/o/t', replace(p_name, ' ', '-')) uri", "p_name label", "concat('parts like ', p_name) definition", "array(upper(p_name), p_name) synonyms")
    return resolve.ontology(rows)


def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "documents").selectExpr("cast(doc_id as string) uuid", "concat('# ', source, '\\n\\n## ', lang, '\\n\\n', replace(text, '\\n', '\\n\\n')) content")


_MD = r"""md as (select cast(doc_id as varchar) uuid, '# ' || source || chr(10) || chr(10) || '## ' || lang || chr(10) || chr(10) || replace("text", chr(10), chr(10) || chr(10)) content, source, lang from documents)"""


@query(f"""with {_MD}, l as (select uuid, source, lang, unnest(string_split(content, chr(10))) line, generate_subscripts(string_split(content, chr(10)), 1) - 1 pos from md)
  select uuid, cast(pos as int) pos, case when pos < 2 then source else source || ' > ' || lang end header_path from l""", kg=False)
def markdown_breadcrumbs(spark, d):
    return chunking.breadcrumbs(_markdown(spark, d)).select("uuid", "pos", "header_path")


@query(rf"""with {_MD}, s as (select uuid, source, lang, list_filter(list_transform(string_split("text", chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') ps from md join (select cast(doc_id as varchar) u, "text" from documents) on u = uuid),
  t as (select *, len(ps) n, cast(ceil(len(ps) / 6.0) as bigint) parts from s where len(ps) > 0), p as (select *, unnest(generate_series(0, parts - 1)) part from t),
  c as (select uuid, source || ' > ' || lang header_path, part, array_to_string(ps[part * (n // parts) + least(part, n % parts) + 1 : (part + 1) * (n // parts) + least(part + 1, n % parts)], chr(10) || chr(10)) content from p)
  select uuid, header_path, cast(row_number() over (partition by uuid order by part) - 1 as int) "position", length(content) chars, md5(content) digest from c where length(content) >= 50""", kg=False)
def markdown_chunks(spark, d):
    return chunking.plain_chunks(_markdown(spark, d)).select("uuid", "header_path", "position", F.length("content").cast("long").alias("chars"), F.md5("content").alias("digest"))


@query()
def html_paragraph_chunks(spark, d):
    """Chunks of the pages, tables and fences kept whole; headings become headers."""
    t = F.regexp_replace(F.regexp_replace("html", r"(?is)<h1[^>]*>(.*?)</h1>", "\n# $1\n\n"), r"(?i)</?p[^>]*>", "\n\n")
    return chunking.chunks(star.table(spark, d, "pages").select(F.col("page_id").cast("string").alias("uuid"), t.alias("content")))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return star.table(spark, d, "lineitem").selectExpr("concat('k', l_partkey) chunk_id", "l_quantity / 50 vector_score", "struct(l_orderkey, l_linenumber, l_suppkey, l_shipdate) seq")


_SC = "select 'k' || l_partkey chunk_id, l_quantity / 50 vector_score, row(l_orderkey, l_linenumber, l_suppkey, l_shipdate) seq from lineitem"


@query(f"select chunk_id, max(vector_score) vector_score from ({_SC}) group by chunk_id")
def context_dedup(spark, d):
    return context.best_of(_scored(spark, d), "chunk_id").select("chunk_id", "vector_score")


@query(f"""select * from (select chunk_id, vector_score, tier, cast(row_number() over (partition by tier order by vector_score desc, first_seq, chunk_id) as int) rank from
  (select chunk_id, max(vector_score) vector_score, min(seq) first_seq, case when max(vector_score) >= 0.45 then 'high' else 'low' end tier from ({_SC}) group by chunk_id)) where rank <= case tier when 'high' then 30 else 20 end""")
def context_split_caps(spark, d):
    return context.split(_scored(spark, d)).select("chunk_id", "vector_score", "tier", "rank")


@query("select lower(p_name) k, max(p_retailprice) confidence, min(p_partkey) first_seq from part group by 1", kg=False)
def resolved_dedupe(spark, d):
    rows = star.table(spark, d, "part").selectExpr("case when p_partkey % 2 = 0 then upper(p_name) else p_name end name", "p_retailprice confidence", "p_partkey seq")
    return resolve.best_by_name(rows).select(F.lower("name").alias("k"), "confidence", "first_seq")


@query("select t.uuid, t.name, x.score from topics t join (select lower(p_type) k, max(p_retailprice) score from part group by 1) x on x.k = lower(t.name)")
def ontology_dedupe(spark, d):
    return resolve.two_stage_topics(star.table(spark, d, "part").selectExpr("upper(p_type) name", "p_retailprice score"), star.topics(spark, d)).select("uuid", "name", "score")


@query(r"""select p_partkey, coalesce(nullif(array_to_string(list_filter(string_split(upper(trim(regexp_replace(regexp_replace(raw, '\([^)]*\)', ' ', 'g'), '[^A-Za-z0-9]+', ' ', 'g'))), ' ')[1:8], lambda x: true), '_'), ''), 'RELATED_TO') rel
  from (select p_partkey, case when p_partkey % 9 = 0 then '(only)' else p_name || ' is-made (by) ' || p_brand || ' of the type ' || p_type || ', size ' || p_size end raw from part)""", kg=False)
def rel_type_normalize(spark, d):
    raw = F.expr("case when p_partkey % 9 = 0 then '(only)' else concat(p_name, ' is-made (by) ', p_brand, ' of the type ', p_type, ', size ', p_size) end")
    return star.table(spark, d, "part").select("p_partkey", text.relationship_type(raw).alias("rel"))


@query(r"""select p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')  ' || p_type, '\s*\([^)]*\)\s*', ' ', 'g'), '\s+', ' ', 'g')) clean from part""", kg=False)
def entity_name_clean(spark, d):
    return star.table(spark, d, "part").select("p_partkey", text.entity_name(F.expr("concat(p_name, ' (', p_brand, ')  ', p_type)")).alias("clean"))


@query("select p_partkey, printf('%s_chunk_%04d', p_name, p_size) id from part", kg=False)
def chunk_id_format(spark, d):
    return star.table(spark, d, "part").select("p_partkey", text.chunk_id(F.col("p_name"), F.col("p_size")).alias("id"))


@query("select p_partkey, p_name plain from part", kg=False)
def type_suffix_strip(spark, d):
    return star.table(spark, d, "part").select("p_partkey", text.without_type_suffix(F.expr("concat(p_name, ' (Product)', case when p_partkey % 2 = 0 then ': size' else '' end)")).alias("plain"))


@query(r"""select conv_id, turn, case when regexp_matches(q, ' (compare|versus|vs|difference) ') then 'comparison' when regexp_matches(q, ' (why|cause|caused|because) ') then 'causal' when regexp_matches(q, ' (when|before|after|during|since) ') then 'temporal'
  when regexp_matches(q, ' (list|which|what are|how many|all) ') then 'enumeration' else 'factual' end kind from (select conv_id, turn, ' ' || regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g') || ' ' q from conversations where role = 'user')""", kg=False)
def question_type(spark, d):
    return star.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", text.question_type(F.col("text")).alias("kind"))


@query(r"""select conv_id, turn, array_to_string(list_filter(list_transform(regexp_split_to_array(trim(text), '\s+')[2:], lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: regexp_matches(w, '^[A-Z]') and length(w) > 1 and w not in ('What', 'Which', 'Who', 'When', 'Where', 'How')), '|') hints
  from conversations where role = 'user'""", kg=False)
def cap_word_hints(spark, d):
    return star.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(text.capitalised_hints(F.col("text")), "|").alias("hints"))


@query("select conv_id, sum(4 + case when length(text) = 0 then 0 else greatest(1, (length(text) + 3) // 4) end)::bigint tokens from conversations group by conv_id", kg=False)
def token_estimate(spark, d):
    return star.table(spark, d, "conversations").groupBy("conv_id").agg(text.chat_tokens(F.collect_list("text")).alias("tokens"))


def _usage(spark: SparkSession, d: str) -> DataFrame:
    n = text.token_estimate(F.col("text"))
    return telemetry.priced(star.table(spark, d, "conversations").select(F.col("role").alias("stage"), F.expr("case conv_id % 3 when 0 then 'small' when 1 then 'large' else 'unknown' end").alias("model"), n.alias("input_tokens"), (n * 2).alias("output_tokens"), (F.col("turn") + 1).alias("latency_ms")))


@query("""select stage, count(*) calls, sum(n)::bigint input_tokens, sum(2 * n)::bigint output_tokens, sum(3 * n)::bigint total_tokens, round(sum(case m when 0 then (n * 0.15 + 2 * n * 0.6) / 1e6 when 1 then (n * 2.5 + 2 * n * 10.0) / 1e6 else 0 end::double), 9) cost_usd, sum(turn + 1)::bigint latency_ms
  from (select role stage, turn, conv_id % 3 m, case when length(text) = 0 then 0 else greatest(1, (length(text) + 3) // 4) end n from conversations) group by stage""", kg=False)
def cost_rollup(spark, d):
    return telemetry.by_stage(_usage(spark, d)).withColumn("cost_usd", F.round("cost_usd", 9))


@query("""select count(*) calls, sum(3 * n)::bigint total_tokens, 'no price for unknown' warnings from (select case when length(text) = 0 then 0 else greatest(1, (length(text) + 3) // 4) end n from conversations)""", kg=False)
def cost_totals(spark, d):
    return telemetry.totals(_usage(spark, d)).select("calls", "total_tokens", F.array_join("warnings", "|").alias("warnings"))


@query("""select f.uuid, f.subject_uuid, f.object_uuid from facts f where object_type = 'entity' and chunk_uuid in (select uuid from chunks)""")
def fact_build(spark, d):
    names = assembly.name_map(star.entities(spark, d).selectExpr("uuid", "name", "uuid seq", "array(upper(name)) aliases"))
    return star.resolved_facts(spark, d, names, star.chunks(spark, d))


@query("select id, from_uuid, from_type, to_uuid, to_type, rel_type, chunk_uuid, fact_id, date_context, group_id from relationships")
def relationship_build(spark, d):
    return assembly.edges(star.facts(spark, d))


@query("""select doc_id, count(*) n from (select doc_id, unnest(string_split("text", chr(10))) line from documents) where contains(lower(line), 'license') group by doc_id""", kg=False)
def grep_keyword(spark, d):
    rows = star.table(spark, d, "documents").where(text.contains_line(F.col("text"), "license", ignore_case=True)).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return rows.where(text.contains_line(F.col("line"), "license", ignore_case=True)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("""select e.uuid, e.name, n_facts from entities e join (select subject_uuid, count(*) n_facts from facts where group_id = 'default' and date_context = '1998-10' group by 1 having count(*) >= 2) x on x.subject_uuid = e.uuid
  where lower(name) like 'supplier#%' and entity_type = 'organization' and uuid in (select subject_uuid from facts where relationship_type = 'RETURNED' and group_id = 'default')""")
def find_min_facts(spark, d):
    return graph.find(star.entities(spark, d), star.facts(spark, d), "Supplier#%", "organization", "RETURNED", 2, "1998-10", _G).select("uuid", "name", "n_facts")


@query("select 'entities' what, entity_type kind, count(*) n from entities group by rollup (entity_type) union all select 'facts', relationship_type, count(*) from facts group by rollup (relationship_type)")
def wc_by_type(spark, d):
    return graph.word_count(star.entities(spark, d), star.facts(spark, d))


@query(f"""select uuid, round(sum(1.0 / (60 + rank)), 9)::double score from (select * from (select uuid, row_number() over (order by {_COS} desc, uuid) rank from vectors) where rank <= 100
  union all select * from (select uuid, row_number() over (order by label, uuid) rank from vectors) where rank <= 100) group by uuid""")
def rrf_hybrid(spark, d):
    """Two searches give their best hundred each, which are fused."""
    v = star.vectors(spark, d)
    a = vector.knn(v, _first(spark, d), 100, -1.0).select("uuid", F.row_number().over(W.orderBy(F.desc("score"), "uuid")).alias("rank"))
    b = v.select("uuid", "label").orderBy("label", "uuid").limit(100).select("uuid", F.row_number().over(W.orderBy("label", "uuid")).alias("rank"))
    return vector.fused(a, b).select("uuid", F.round("score", 9).alias("score"))


@query(f"select uuid, round({_COS}, 6) score from vectors where label in (1, 4) and {_COS} >= 0.05 order by {_COS} desc, uuid limit 20")
def knn_filtered(spark, d):
    """Search among the rows that a filter leaves, before any similarity is computed."""
    v = star.vectors(spark, d)
    return vector.among(v, v.where("label in (1, 4)"), _first(spark, d), 20, 0.05).select("uuid", F.round("score", 6).alias("score"))


@query(f"select chunk_uuid, max(round(score, 6)) score from (select chunk_uuid, {_COS} score from facts f join vectors v on v.uuid = {_VF} where object_type = 'entity') where chunk_uuid <> '' group by chunk_uuid")
def global_chunk_search(spark, d):
    v = star.vectors(spark, d)
    n = v.count()
    scores = v.select(F.col("uuid").alias("v"), vector.cosine("vector", F.array(*map(F.lit, _first(spark, d)))).alias("score"))
    f = star.facts(spark, d).where("object_type = 'entity'").select("chunk_uuid", F.expr(f"concat('v', cast(substr(object_uuid, 2) as bigint) % {n})").alias("v"))
    return context.global_chunks(f.join(scores, "v")).select("chunk_uuid", F.round("score", 6).alias("score"))


@query("""select e.uuid, e.name, e.entity_type, coalesce(n, 0) n_facts from (select * from entities order by name, uuid limit 200) e
  left join (select u, count(*) n from (select subject_uuid u from facts where group_id = 'default' union all select object_uuid from facts where group_id = 'default' and object_uuid <> subject_uuid) group by u) x on x.u = e.uuid where entity_type = 'company'""")
def ls_entities(spark, d):
    return graph.listing(star.entities(spark, d), star.facts(spark, d), "company", 200, _G)


@query(f"select distinct relationship_type from facts where lower(subject_name) = '{_S1.lower()}'")
def relationship_types(spark, d):
    return graph.relationship_types(star.facts(spark, d), _S1)


@query(f"select distinct object_name from facts where lower(subject_name) = '{_S1.lower()}' and relationship_type = 'RETURNED'")
def relationship_targets(spark, d):
    return graph.targets(star.facts(spark, d), _S1, "RETURNED")


@query("""select p_partkey, case when p_size <= 12 and not (p_size = 2 and p_partkey % 31 + 1 > 28) and not (p_size in (4, 6, 9, 11) and p_partkey % 31 + 1 > 30) then printf('2023-%02d-%02d', p_size, p_partkey % 31 + 1) end as "date" from part""", kg=False)
def document_dates(spark, d):
    return star.table(spark, d, "part").select("p_partkey", text.document_date(F.lit(2023), F.col("p_size"), F.expr("p_partkey % 31 + 1")).alias("date"))


@query("select '<urn:kg:' || url_encode(subject_uuid) || '> <urn:kg:' || url_encode(relationship_type) || '> <urn:kg:' || url_encode(object_uuid) || '> .' triple from facts")
def export_triples(spark, d):
    return graph.triples(star.facts(spark, d))


@query("""select event_type, date_trunc('hour', ts) "start", count(*) n from events group by all""", kg=False)
def events_by_hour(spark, d):
    """Activity of the stream table by hour, in the shape that streaming.activity gives it in micro-batches."""
    from quillgraph.streaming.ingest import activity

    return activity(star.table(spark, d, "events"))
