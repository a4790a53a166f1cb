"""The pipeline against the stages done by brute force on the driver."""

import corpus_pipeline
from tests.llm.test_operators import brute_groups, fold

from quillgraph.llm import mixing, pii, quality

DATA = "/root/testdata/sf0.001"


def test_pipeline_by_hand(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    good = {r.doc_id for r in quality.classify(docs).where("keep").collect()}
    rows = [r for r in rows if r["doc_id"] in good]
    gone = {d for d, k in brute_groups([(r["doc_id"], r["text"]) for r in rows]) if d != k}
    rows = [r for r in rows if r["doc_id"] not in gone]
    items = [fold(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    grams = {tuple(w[k : k + 12]) for w in items for k in range(len(w) - 11)}
    rows = [r for r in rows for w in [fold(r["text"])] if not any(tuple(w[k : k + 12]) in grams for k in range(len(w) - 11))]
    anchors = pii.automaton()
    for r in rows:
        r["text"] = pii.redact_text(r["text"], anchors)
        r["n_chars"] = len(r["text"])
    want = mixing.sample(spark.createDataFrame(rows, docs.schema))
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 20


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, DATA).columns == docs.columns
    # nulls in every column, repeated rows, a long text and columns whose names clash with those of the operators
    odd = docs.limit(30).unionByName(docs.limit(5)).selectExpr("*", "1 as score", "'x' as topic", "true as keep").unionByName(
        spark.createDataFrame([(None, None, None, None, None), (None, "a text of plain words without an id, for all to read", None, None, None), (-5, "Of the thing that was seen. " * 20_000, "en", "s", 1)], docs.schema).selectExpr("*", "1 as score", "'x' as topic", "true as keep")
    )
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, odd, DATA)
        assert left.columns[: len(odd.columns)] == odd.columns and 0 < left.count() <= odd.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
