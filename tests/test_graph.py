"""Graph, vector, clustering, resolution, context and telemetry operators on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text
from quillgraph.operators import assembly, chunking, cluster, context, graph, resolve, telemetry, vector
from quillgraph.plans import catalog
from quillgraph.sources import star

FACT = "uuid string, subject_uuid string, subject_name string, object_uuid string, object_name string, object_type string, relationship_type string, date_context string, chunk_uuid string, group_id string"


@pytest.fixture(scope="module")
def facts(spark):
    rows = [
        ("f1", "a", "Apple Inc", "m", "Microsoft Corp", "entity", "COMPETES_WITH", "2024", "k1", "g"), ("f2", "a", "Apple Inc", "b", "Beats", "entity", "ACQUIRED", "2014", "k2", "g"), ("f3", "m", "Microsoft Corp", "a", "Apple Inc", "entity", "SUED", None, "", "g"),
        ("f4", "a", "Apple Inc", "t", "M&A", "topic", "ABOUT", "2014", "k2", "g"), ("f5", "a", "APPLE INC", "m", "Microsoft Corp", "entity", "COMPETES_WITH", "2023", "k9", "h"),
    ]
    return spark.createDataFrame(rows, FACT)


@pytest.fixture(scope="module")
def entities(spark):
    return spark.createDataFrame([("a", "Apple Inc", "company", "maker", "g"), ("m", "Microsoft Corp", "company", "rival", "g"), ("b", "Beats", "company", "sound", "g"), ("x", "apple inc", "product", "other tenant", "h")], "uuid string, name string, entity_type string, summary string, group_id string")


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([("k1", "one", "A > B", "d1", "2024-01-15", "g"), ("k2", "two", "A", "d2", "2024-03-01", "g"), ("k9", "nine", "", "d9", "2025-01-01", "h")], "uuid string, content string, header_path string, document_uuid string, document_date string, group_id string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.createDataFrame([("d1", "First", "g")], "uuid string, name string, group_id string")


def ids(df, c="uuid"):
    return [r[c] for r in df.collect()]


def test_lookups(entities, facts):
    assert ids(graph.by_name(entities, "APPLE inc", "g")) == ["a"] and ids(graph.by_name(entities, "apple inc", "h")) == ["x"]
    assert ids(graph.by_uuids(entities, [], "g")) == [] and ids(graph.by_uuid(entities, "b", "g")) == ["b"]
    assert ids(graph.entity_facts(facts, "apple inc", group="g")) == ["f1", "f2", "f3", "f4"]
    assert ids(graph.facts_for_entities(facts, ["Beats", "microsoft corp"], group="g")) == ["f1", "f2", "f3"]
    assert ids(graph.page(entities, 1, 1, "g")) == ["b"]


def test_around_and_between(facts, chunks):
    names = ["Apple Inc", "Microsoft Corp"]
    around, between = (set(ids(graph.facts_by_entities(facts, chunks, names, m, group="g"))) for m in ("around", "between"))
    assert around == {"f1", "f2", "f3", "f4"} and between == {"f1", "f3"} and between <= around
    assert ids(graph.facts_by_entities(facts, chunks, names, group="g"))[-1] == "f3"  # without a date, last
    assert ids(graph.facts_by_entities(facts, chunks, names, until="2024-01", group="g")) == []  # text order: the 15th is after the month
    with pytest.raises(ValueError):
        graph.about(names, "beside")


def test_traversal(entities, facts, chunks, documents):
    rel = assembly.edges(facts)
    assert set(ids(rel, "fact_id")) == {"f1", "f2", "f4", "f5"}
    got = graph.entity_chunks(entities, rel, chunks, documents, "apple inc", group="g").collect()
    assert [(r["chunk_uuid"], r["document_name"]) for r in got] == [("k1", "First"), ("k2", None)]
    assert [(r["name"], r["n"]) for r in graph.neighbours(entities, rel, "Apple Inc", group="g").collect()] == [("Beats", 1), ("Microsoft Corp", 1)]
    assert [r["name"] for r in graph.neighbours(entities, rel, "Beats", group="g", direction="in").collect()] == ["Apple Inc"]
    assert {(r["neighbour"], r["chunk_uuid"]) for r in graph.neighbour_chunks(entities, rel, chunks, "Apple Inc", group="g").collect()} == {("Beats", "k2"), ("Microsoft Corp", "k1")}
    plan = graph.entity_chunks(entities, rel, chunks, documents, "a", group="g")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    named = {r["uuid"]: r["document_name"] for r in graph.with_document(facts, chunks, documents).collect()}
    assert named["f1"] == "First" and named["f3"] == "Unknown"


def test_listing_filters_after_the_limit(entities, facts):
    assert ids(graph.listing(entities, facts, "PRODUCT", 2)) == []
    assert {r["name"]: r["n_facts"] for r in graph.listing(entities, facts, group="g").collect()} == {"Apple Inc": 4, "Beats": 1, "Microsoft Corp": 2}


def test_facts_need_both_names_and_the_chunk(spark, chunks):
    names = assembly.name_map(spark.createDataFrame([("1", "A", ["a1"], 1), ("2", "A", None, 2), ("3", "B", [], 3)], "uuid string, name string, aliases array<string>, seq int"))
    raw = spark.createDataFrame([("A", "B", "k1"), ("a1", "B", "k1"), ("a", "B", "k1"), ("A", "B", "gone"), ("A", "C", "k1")], "subject_name string, object_name string, chunk_uuid string")
    assert sorted((r["subject_name"], r["subject_uuid"], r["object_uuid"]) for r in assembly.resolve_facts(raw, names, chunks).collect()) == [("A", "2", "3"), ("a1", "1", "3")]
    moved = assembly.remap(raw.selectExpr("subject_name uuid"), "uuid", spark.createDataFrame([("A", "Z")], "old_uuid string, new_uuid string"))
    assert sorted(ids(moved)) == ["Z", "Z", "Z", "a", "a1"]


def test_names_are_looked_up_once_a_supplier_and_part(spark, tmp_path, monkeypatch):
    """Odd lines and names: the same facts as from a look-up for every fact, and no fact is shuffled by a name."""
    tables = {
        "supplier": ([(1, "S1"), (2, "S2"), (3, None), (4, "unknown")], "s_suppkey long, s_name string"),
        "part": ([(1, "nut", "BOLTS"), (2, "NUT", "S2"), (3, None, None), (4, "gone", "none")], "p_partkey long, p_name string, p_type string"),
        "lineitem": ([(o, n, p, s, "R", None) for o in (0, 1, 2, 3, 9, None) for n in (1, 7, None) for p in (1, 2, 3, 4, 5, None) for s in (1, 2, 3, 4, 5, None)] * 2, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_shipdate timestamp"),
        "documents": ([(0,), (1,), (1,), (7,)], "doc_id long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    names = assembly.name_map(spark.createDataFrame([("a", "S1", 1), ("b", "s2", 2), ("c", "nut 1", 3), ("d", "x", 4), ("e", "nut 2", 5)], "uuid string, name string, seq int").withColumn("aliases", F.expr("array(upper(name))")))
    known = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("concat('k', doc_id) uuid")
    f = star.facts(spark, str(tmp_path)).drop("subject_uuid", "object_uuid")
    cols = ["uuid", "subject_uuid", "object_uuid"]
    want = sorted(map(tuple, assembly.resolve_facts(f, names, known).select(*cols).collect()), key=str)
    assert {w[2] for w in want} == {"b", "c", "e"} and any(w[0] is None for w in want)
    for rows in (500_000, 0):
        monkeypatch.setattr(star, "BROADCAST_ROWS", rows)
        assert sorted(map(tuple, star.resolved_facts(spark, str(tmp_path), names, known).collect()), key=str) == want
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = catalog.QUERIES["fact_build"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "hashpartitioning(subject_name" not in plan and "hashpartitioning(object_name" not in plan


def vectors(spark, rows):
    return spark.createDataFrame([(u, None if v is None else [float(x) for x in v]) for u, v in rows], "uuid string, vector array<float>")


def test_knn(spark):
    v = vectors(spark, [("c1", [1, 0, 0]), ("c2", [0, 1, 0]), ("c3", [0.9, 0.1, 0]), ("zero", [0, 0, 0]), ("none", None), ("short", [1.0])])
    assert ids(vector.knn(v, [1, 0, 0], 5, 0.5)) == ["c1", "c3"]
    assert ids(vector.knn(v, [1, 0, 0], 2, -1.0)) == ["c1", "c3"]
    assert ids(vector.knn(v, [0, 0, 0], 2, -1.0)) == []
    assert ids(vector.among(v, v.where("uuid <> 'c1'"), [1, 0, 0], 5, 0.5)) == ["c3"]


def test_joins_against_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5)).astype(np.float32)
    v = vectors(spark, [(f"v{k:02d}", [float(x) for x in r]) for k, r in enumerate(m)])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u.astype(float) @ u.T.astype(float)
    want = {(f"v{i:02d}", f"v{j:02d}") for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    assert {(r["a"], r["b"]) for r in vector.pairs(v, 0.5, block=17).collect()} == want
    got = vector.knn_join(v, v, 3, 0.2, block=13).collect()
    for i in range(60):
        best = [f"v{j:02d}" for j in np.argsort(-s[i], kind="stable")[:3] if s[i, j] >= 0.2]
        assert [r["match"] for r in sorted((r for r in got if r["query"] == f"v{i:02d}"), key=lambda r: r["rank"])] == best


def test_blocks_of_any_shape(spark):
    """Repeated keys and vectors, missing, zero and short ones: the blocks give what all pairs give, ties to the lesser key, and links connect what pairs connect."""
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(150, 4)), 1)
    m[100:130] = m[7]
    rows = [(f"v{k % 140:03d}", r) for k, r in enumerate(m)] + [("zero", [0] * 4), ("none", None), (None, [1] * 4), ("short", [1.0]), ("short2", [2.0])]
    v = vectors(spark, rows).repartition(3)
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u[:, None] * u[None]).sum(axis=2)
    want = sorted((min(a, b), max(a, b)) for i, (a, _) in enumerate(rows[:150]) for j, (b, _) in enumerate(rows[:i]) if a != b and s[i, j] >= 0.95 - 1e-12) + [("short", "short2")]
    for block in (20, 1000):
        pairs = vector.pairs(v, 0.95, block=block)
        assert sorted((r["a"], r["b"]) for r in pairs.collect()) == sorted(want)
        nodes = spark.createDataFrame([(k,) for k in {k for k, _ in rows if k}], "uuid string")
        roots = {(r["uuid"], r["root"]) for r in cluster.components(nodes, pairs).collect()}
        assert roots == {(r["uuid"], r["root"]) for r in cluster.components(nodes, vector.links(v, 0.95, block=block)).collect()}
        for limit, others in ((1, True), (3, True), (3, False), (40, True)):
            got = {}
            for r in vector.knn_join(v, v, limit, 0.2, block=block, others=others).orderBy("query", "rank").collect():
                got.setdefault(r["query"], []).append(r["match"])
            for key in ("v000", "v005", "v007", "v105", "v139"):
                every = sorted((-s[i, j], b) for i, (a, _) in enumerate(rows[:150]) for j, (b, _) in enumerate(rows[:150]) if a == key and s[i, j] >= 0.2 and not (others and a == b))
                assert got[key] == [b for _, b in every[:limit]], (key, limit, others, block)


def test_blocks_hand_on_little(spark):
    """Rows go to as many tasks whether there are few thousands or many, and links stay as many as rows however many pairs there are."""
    assert [vector._block_count(spark.range(n).selectExpr("id uuid", "array(1f, 2f) vector"), "vector", None, 12) for n in (100, 3000, 300_000)] == [1, 12, 12]
    like = spark.range(3000).selectExpr("cast(id as string) uuid", "array(1f, cast(id % 50 / 1000 as float)) vector")
    assert vector.links(like, 0.9).count() < 12 * 3000
    assert {r["root"] for r in cluster.components(like, vector.links(like, 0.9)).select("root").distinct().collect()} == {"0"}


def test_deduplicate(spark):
    rows = [("1", 1, "Apple Inc.", "company", "Maker of phones.", [1.0, 0.0, 0.0]), ("2", 2, "AAPL", "company", " ", [0.95, 0.1, 0.0]), ("3", 3, "Google", "company", "Search.", [0.0, 0.0, 1.0]), ("4", 4, "google ", "company", "Ads.", [0.0, 1.0, 0.0])]
    e = spark.createDataFrame(rows, "uuid string, seq long, name string, entity_type string, summary string, vector array<double>")
    got = {r["uuid"]: r for r in cluster.deduplicate(e).collect()}
    assert set(got) == {"1", "3"} and got["1"]["aliases"] == ["AAPL"] and got["3"]["summary"] == "Search. Ads." and got["1"]["summary"] == "Maker of phones."
    apart = cluster.deduplicate(e, decide=lambda rows: [[k] for k in range(len(rows))])
    assert apart.count() == 4
    assert [(r["canonical"], r["member"]) for r in cluster.merge_history(cluster.deduplicate(e)).orderBy("canonical", "position").collect()] == [("1", "1"), ("1", "2"), ("3", "3"), ("3", "4")]


def test_deduplicate_lists_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(vector, "pairs", None)
    e = spark.createDataFrame([(str(k), k, f"n{k}", "company", "", [1.0, k % 2 * 5.0]) for k in range(9)], "uuid string, seq long, name string, entity_type string, summary string, vector array<double>")
    assert {r["uuid"]: len(r["members"]) for r in cluster.deduplicate(e).collect()} == {"0": 5, "1": 4}


def test_components_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(f"n{k:02d}",) for k in range(n + 1)], "uuid string")
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}") for k in range(n - 1)], "a string, b string")
    got = {r["uuid"]: r["root"] for r in cluster.components(nodes, chain).collect()}
    assert set(got.values()) == {"n00", f"n{n:02d}"} and sum(v == "n00" for v in got.values()) == n


def test_batches_and_merging():
    assert cluster.batches(25) == [range(25)] and cluster.batches(30)[1].start == 20
    assert {k for b in cluster.batches(103) for k in b} == set(range(103))
    assert cluster.merge_batches([[0, 1], [1, 2], [3], [4, 3]]) == [[0, 1, 2], [3, 4]]
    order = cluster.similarity_order(np.array([[1, 0], [0, 1], [0.9, 0.1], [0.1, 0.9]]))
    assert order == [0, 2, 3, 1] or order == [0, 2, 1, 3]


def test_resolution(spark):
    new = spark.createDataFrame([("n1", "s1", [1.0, 0.0]), ("n2", "s2", [0.0, 1.0])], "uuid string, summary string, vector array<double>")
    known = spark.createDataFrame([("k1", "had", [0.99, 0.05])], "uuid string, summary string, vector array<double>")
    r = resolve.registry(new, known)
    assert sorted((x["uuid"], x["match"], x["is_new"]) for x in r.collect()) == [("n1", "k1", False), ("n2", None, True)]
    assert ids(resolve.only_new(new, r)) == ["n2"] and resolve.merged_summaries(new, known, r).collect()[0]["summary"] == "had s1"
    asked = spark.createDataFrame([("Inflation", [1.0, 0.0]), (" inflation", [1.0, 0.0]), ("Trade", [0.0, -1.0])], "name string, vector array<double>")
    got = {x["spelling"]: x["uuid"] for x in resolve.topics(asked, known).collect()}
    assert got == {"Inflation": "k1", " inflation": "k1", "Trade": None}
    onto = spark.createDataFrame([("http://o/x/inflation", "Inflation", "rising prices", ["CPI", "Price Increases"]), ("http://o/x/gdp", "GDP", None, ["Economic Output"])], "uri string, label string, definition string, synonyms array<string>")
    assert resolve.ontology(onto).count() == 5 and "CPI: rising prices" in ids(resolve.ontology(onto), "text")
    hints = spark.createDataFrame([("apple",), ("Federal Reserve System of old",)], "hint string")
    names = spark.createDataFrame([("Apple Inc",), ("federal reserve system",), ("Beats",)], "name string")
    assert resolve.hint_matches(hints, names).count() == 2
    decided = spark.createDataFrame([("t", 9, 1), ("t", 2, 2), ("u", 7, 1)], "key string, choice int, seq int")
    cands = spark.createDataFrame([("t", 1, "a", 0.9), ("t", 2, "b", 0.8), ("u", 1, "c", 0.7)], "query string, rank int, match string, score double")
    assert {x["key"]: x["match"] for x in resolve.picked(decided, cands).collect()} == {"t": "b", "u": None}


def test_resolution_asks_for_the_best_alone(spark, monkeypatch):
    asked = []
    real = vector.knn_join
    monkeypatch.setattr(vector, "knn_join", lambda q, b, limit, threshold, **k: asked.append((limit, threshold)) or real(q, b, limit, threshold, **k))
    v = vectors(spark, [("a", [1, 0]), ("b", [0.9, 0.1]), ("c", [0, 1])])
    got = {r["uuid"]: r["match"] for r in resolve.registry(v, v, 0.8, threshold=0.3).collect()}
    assert got == {"a": "b", "b": "a", "c": None} and asked == [(1, 0.8)]
    got = {r["spelling"]: r["uuid"] for r in resolve.topics(v.withColumnRenamed("uuid", "name"), v, 0.3, threshold=0.8).collect()}
    assert got == {"a": "b", "b": "a", "c": None} and asked[1:] == [(1, 0.8)]


def test_context(spark):
    rows = spark.createDataFrame([("c1", 0.5, 1), ("c2", 0.85, 2), ("c1", 0.8, 3), ("c3", 0.35, 4), ("c4", 0.8, 5)], "chunk_id string, vector_score double, seq int")
    got = context.split(rows).orderBy("tier", "rank").collect()
    assert [(r["tier"], r["chunk_id"]) for r in got] == [("high", "c2"), ("high", "c1"), ("high", "c4"), ("low", "c3")]
    assert context.split(rows, caps={"high": 1, "low": 0}).count() == 1
    assert context.prompt({"Facts": ["x" * 300], "None": []}) == "## Facts\n- " + "x" * 200 + "..."


def test_telemetry(spark):
    u = spark.createDataFrame([("decomposition", "small", 100, 20, 5), ("synthesis", "strange", 40, 10, 7)], "stage string, model string, input_tokens long, output_tokens long, latency_ms long")
    p = telemetry.priced(u)
    t = telemetry.totals(p, 0.0).first()
    assert (t["calls"], t["total_tokens"]) == (2, 170) and t["warnings"] == ["no price for strange", "cost is over 0.0"]
    assert [r["stage"] for r in telemetry.by_stage(p).collect()] == ["decomposition", "synthesis"]


def test_text(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first()["x"]

    assert one(text.relationship_type(F.lit("was acquired (in 2014) by-the  firm"))) == "WAS_ACQUIRED_BY_THE_FIRM" and one(text.relationship_type(F.lit("(x)"))) == "RELATED_TO"
    assert one(text.entity_name(F.lit(" Apple (the firm)  Inc "))) == "Apple Inc"
    assert one(text.chunk_id(F.lit("d"), F.lit(7))) == "d_chunk_0007"
    assert one(text.without_type_suffix(F.lit("Apple (Company): maker"))) == "Apple"
    assert one(text.entity_text(F.lit("A"), F.lit(" "), F.lit("s"))) == "A: s" and one(text.entity_text(F.lit("A"), F.lit(None).cast("string"), F.lit(""))) == "A"
    assert [one(text.token_estimate(F.lit(x))) for x in ("", "a", "abcd", "abcde")] == [0, 1, 1, 2]
    assert one(text.csv_list(F.lit("a, ,b"))) == ["a", "b"] and one(text.percent(F.lit(0.879))) == 87
    assert one(text.document_date(F.lit(2024), F.lit(2), F.lit(30))) is None and one(text.document_date(F.lit(2024), F.lit(None).cast("int"), F.lit(None).cast("int"))) == "2024-01-01"
    assert one(text.capitalised_hints(F.lit('How did "Apple," beat Which Microsoft?'))) == ["Apple", "Microsoft"]


def test_chunking(spark):
    body = "\n\n".join(f"Paragraph number {k} has enough words in it to be kept whole." for k in range(8))
    md = f"Words before any header that are long enough to count as one.\n# A\n\n{body}\n\n## B\n\nshort\n\n### C\n\n<table>\n\n<tr><td>{'cell ' * 20}</td></tr>\n\n</table>\n# D\n\nThe last of the sections of this text, long enough too."
    d = spark.createDataFrame([("d", md), ("e", ""), ("n", None)], "uuid string, content string")
    got = chunking.chunks(d).orderBy("position").collect()
    assert [(r["position"], r["header_path"]) for r in got] == [(0, ""), (1, "A"), (2, "A"), (3, "A > B > C"), (4, "D")]
    assert got[1]["content"].count("Paragraph") == 4 and got[3]["content"].startswith("<table>")
    plain = spark.createDataFrame([("d", f"# A\n\n{body}")], "uuid string, content string")
    assert [tuple(r) for r in chunking.plain_chunks(plain).orderBy("position").collect()] == [tuple(r) for r in chunking.chunks(plain).orderBy("position").collect()]
    assert [len(x) for x in chunking.evenly(list("abcdefgh"), 3)] == [3, 3, 2]
    assert chunking.paragraphs("a\n\n```\nx\n\ny\n```\n\nb") == ["a", "```\nx\n\ny\n```", "b"]
