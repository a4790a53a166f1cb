"""Tables written to the cluster's shared folder to end lineage; any executor can read them again."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, a local session, as in tests, has one of this machine; a cluster has an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return (at or "file://" + os.path.join(tempfile.gettempdir(), "quillgraph-shared")).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    path = f"{folder(df.sparkSession)}/kg-{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
