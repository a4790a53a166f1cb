"""Documents from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(name, content) of Markdown files."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=recursive).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))


def converted(spark: SparkSession, path: str, convert: Callable[[bytes], str], glob: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """(name, content) of binary files such as PDF, through a converter to Markdown that is handed in."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(path).select(F.col("_metadata.file_name").alias("name"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"name": b["name"].tolist(), "content": [convert(bytes(x)) for x in b["content"]]})

    return files.mapInPandas(run, "name string, content string")


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(uri, label, definition, synonyms) of a JSON array."""
    return spark.read.schema("uri string, label string, definition string, synonyms array<string>").json(path, multiLine=True)
