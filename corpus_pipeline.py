"""The training-text pipeline: five stages over documents, each over all that its predecessor kept.

Counted as part of the subpackage ``llm``. Every stage takes (spark, docs, sf_dir) and
returns a DataFrame; all but the last return the columns of ``documents``. Texts
without a word go in the first stage; null sources and languages are categories of
their own in the last; rows without a doc_id are never near duplicates. Repeated rows are
kept or left together, but in the second stage rows of one doc_id are one document. Texts of any length are
read whole. What equals a threshold is kept, and of a group of near duplicates the smallest doc_id stays, so nothing is decided by chance.
Columns besides those of documents go through, whatever their names. Of an empty table nothing is left.
A stage's table is removed once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import mixing, pii, quality, simhash, suffix
from quillgraph.llm.common import cut, forget, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest doc_id stays."""
    return simhash.drop_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return suffix.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics come near their target weights."""
    return mixing.sample(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", without_personal_data),
    ("mixing", mixed),
]

#: No SQL can express the first three stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    last = None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if last is not None:
            forget(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
