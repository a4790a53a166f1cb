"""The store, settings, the knowledge base end to end, its commands and its stream."""

import json

import pytest

from quillgraph.functions.providers import HashEmbeddings, LanguageModel, RuleModel, extracted
from quillgraph.plans.commands import Session, blocks, names, selector
from quillgraph.plans.knowledge import KnowledgeBase
from quillgraph.sources import config, readers
from quillgraph.sources.store import Store
from quillgraph.streaming.ingest import activity, documents_into

TEXT = """# Deals

Apple acquired Beats in 2014 for a large sum of money, as was reported then. Microsoft competes with Apple in many a market.

## Later

Microsoft acquired LinkedIn in 2016, which the press had not expected at all at that time.
"""


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("kb")
    (at / "in").mkdir()
    (at / "in" / "deals.md").write_text(TEXT)
    made = KnowledgeBase(spark, config.Config(path=str(at / "kb"), dedup_threshold=0.98))
    stages = []
    made.first = made.ingest_markdown(readers.markdown(spark, str(at / "in")), "2024-02-01", progress=lambda s, x: stages.append((s, x)))
    made.stages = stages
    return made


def test_ingest(kb, spark):
    assert (kb.first.documents, kb.first.chunks) == (1, 2) and kb.first.facts == kb.first.relationships >= 3
    assert kb.stages == [("chunking", 0.0), ("chunking", 1.0), ("extraction", 0.0), ("extraction", 1.0), ("deduplication", 0.0), ("deduplication", 0.5), ("resolution", 0.0), ("resolution", 1.0), ("assembly", 0.0), ("assembly", 1.0)]
    again = kb.ingest_markdown(spark.createDataFrame([("deals.md", TEXT)], "name string, content string"), "2024-02-01")
    assert (again.documents, again.chunks, again.facts) == (0, 0, 0)
    assert kb.stats()["documents"] == 1
    assert {r["document_date"] for r in kb.store.read("chunks").collect()} == {"2024-02-01"}


def test_search_and_ask(kb):
    assert kb.search_entities("Apple", 3, 0.1).first()["name"] == "Apple"
    assert "LinkedIn" in kb.search_facts("Microsoft acquired LinkedIn", 1).first()["content"]
    assert "Beats" in kb.search_chunks("Apple acquired Beats for money").first()["content"]
    got = kb.ask("Which firm acquired Beats?")
    assert "Beats" in got.text and got.confidence > 0 and got.question_type == "enumeration" and got.sources
    near = [r["name"] for r in kb.neighbours("apple").collect()]
    assert "Beats" in near


def test_commands(kb):
    s = Session(kb)
    out = s.run("search --entity 'Apple, Beats' --mode between")
    assert out.startswith("[1] Apple ACQUIRED") and "deals.md" in out
    assert "Apple acquired Beats" in s.run("cat 1") and s.run("cat 9").startswith("Error")
    assert "LinkedIn" in s.run("search --entity Microsoft --query 'acquired LinkedIn' --limit 1")
    assert s.run("search --entity Apple --from 2025-01") == "Nothing found."
    assert s.run("info Apple").startswith("Apple (CONCEPT)") and s.run("info Nobody").startswith("No entity")
    assert "Apple" in s.run("ls entities") and s.run("ls documents") == "deals.md" and s.run("ls cats").startswith("Error")
    assert "documents: 1" in s.run("stats") and "find" in s.run("help") and s.run("drop").startswith("Error: unknown")
    assert "Apple" in s.run('find --entity {"name": "Apple", "definition": "a firm"}')
    assert s.run("find --entity {}").startswith("Error")
    assert blocks('--entity {"a": "b c"} x') == ["--entity", '{"a": "b c"}', "x"] and names("a, b,,a") == ["a", "b"]
    with pytest.raises(ValueError):
        selector('{"name": "x", "definition": " "}')


def test_ontology(kb, spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps([{"uri": "http://o/inflation", "label": "Inflation", "definition": "rising prices", "synonyms": ["CPI"]}]))
    kb.load_ontology(readers.ontology(spark, str(tmp_path / "o.json")))
    kb.load_ontology(readers.ontology(spark, str(tmp_path / "o.json")))
    assert kb.store.read("vectors_topics", "ontology").count() == 2
    assert kb.search_topics("CPI: rising prices").first()["name"] == "CPI"
    assert kb.store.read("topics").count() == 0
    kb.load_ontology(spark.createDataFrame([("https://example.org/gdp", "GDP", "what is produced", ["Output"])], "uri string, label string, definition string, synonyms array<string>"))
    assert [tuple(r) for r in kb.store.read("topics", "ontology").select("uuid", "definition").collect()] == [("gdp", "what is produced")]
    assert {r["name"] for r in kb.store.read("vectors_topics", "ontology").collect()} == {"GDP", "Output"}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    assert s.read("facts").count() == 0 and json.loads((tmp_path / "s" / "metadata.json").read_text())["version"]
    s.append("entities", spark.createDataFrame([("1", "A", ["x"], None)], "uuid string, name string, aliases array<string>, summary string"))
    s.merge("entities", spark.createDataFrame([("1", "again"), ("2", "B"), ("2", "B")], "uuid string, name string"))
    assert sorted((r["uuid"], r["name"], r["summary"]) for r in s.read("entities").collect()) == [("1", "A", ""), ("2", "B", "")]
    s.update_summaries(spark.createDataFrame([("2", "new"), ("9", "none")], "uuid string, summary string"))
    assert {r["uuid"]: r["summary"] for r in s.read("entities").collect()} == {"1": "", "2": "new"}
    assert Store(spark, str(tmp_path / "s"), "other").read("entities").count() == 0
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path / "s"), "a b")
    with s.lock(), pytest.raises(TimeoutError), s.lock(0.1):
        pass


def test_single_file_table_is_taken_over(spark, tmp_path):
    import pandas as pd

    s = Store(spark, str(tmp_path / "s"))
    pd.DataFrame([{"uuid": "old", "content": "c", "header_path": "", "position": 0, "document_uuid": "d", "document_date": "2026-01-31", "group_id": "default", "created_at": ""}]).astype({"position": "int32"}).to_parquet(tmp_path / "s" / "chunks")
    assert s.read("chunks").count() == 1
    s.append("chunks", spark.createDataFrame([("new", "c")], "uuid string, content string"))
    assert {r["uuid"] for r in s.read("chunks").collect()} == {"old", "new"}


def test_chunks_of_one_document(kb, spark):
    two = spark.createDataFrame([("a", "d1"), ("b", "d2")], "content string, document_uuid string")
    with pytest.raises(ValueError):
        kb.ingest_chunks(two)
    got = kb.ingest_chunks(spark.createDataFrame([("Tesla bought SolarCity long ago.", "H", "dx", "2020-01-01"), ("And more.", "H", "dx", None)], "content string, header_path string, document_uuid string, document_date string"))
    assert (got.documents, got.chunks) == (1, 2) and {r["document_date"] for r in kb.store.read("chunks").where("document_uuid = 'dx'").collect()} == {"2020-01-01"}


def test_settings(tmp_path, monkeypatch):
    (tmp_path / "c.toml").write_text('[storage]\npath = "a"\ngroup_id = "t"\n[query]\nmax_sub_queries = 3\n')
    monkeypatch.setenv("QUILLGRAPH_GROUP_ID", "env")
    got = config.load(str(tmp_path / "c.toml"), path="given")
    assert (got.path, got.group_id, got.max_sub_queries) == ("given", "env", 3)
    config.save(config.Config(path='q"uote', api_key="hidden", expand_neighbours=False), str(tmp_path / "o.toml"))
    monkeypatch.delenv("QUILLGRAPH_GROUP_ID")
    back = config.load(str(tmp_path / "o.toml"))
    assert back.path == 'q"uote' and back.api_key == "" and back.expand_neighbours is False
    with pytest.raises(ValueError):
        config.load(nonsense=1)


class Failing(RuleModel):
    def extract(self, text):
        if "bad" in text:
            raise RuntimeError
        return super().extract(text)


def test_providers(spark):
    assert issubclass(RuleModel, LanguageModel)
    e = HashEmbeddings(64)
    a, b, c, empty = e.embed(["Apple sells phones", "apple phones", "rain in spring", ""])
    assert a @ b > a @ c and abs(float(a @ a) - 1) < 1e-5 and not empty.any() and e.embed_one("x") == e.embed_one("x")
    got = {r["chunk_uuid"]: r for r in extracted(spark.createDataFrame([("1", "bad"), ("2", "Apple met Beats.")], "uuid string, content string"), Failing()).collect()}
    assert got["1"]["facts"] == [] and got["2"]["facts"][0]["relationship"] == "MET"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nA paragraph that is long enough to be kept as a chunk of its own.")
    s = Store(spark, str(tmp_path / "kb"))
    for _ in range(2):
        documents_into(spark, str(tmp_path / "in"), s, str(tmp_path / "cp")).awaitTermination(120)
    (tmp_path / "in" / "b.md").write_text("# B\n\nAnother paragraph that is long enough to be kept as a chunk by itself.")
    documents_into(spark, str(tmp_path / "in"), s, str(tmp_path / "cp")).awaitTermination(120)
    assert s.stats()["documents"] == 2 and s.stats()["chunks"] == 2
    src = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{src}/events.parquet").schema
    stream = activity(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(src))
    q = stream.writeStream.format("memory").queryName("act").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.sql("select * from act").collect())) == sorted(map(tuple, activity(spark.read.parquet(f"{src}/events.parquet")).collect()))
