"""What the operators share: reading, cutting lineage, checked broadcasts, bounded samples."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that are ever handed to every executor at once; larger sides are joined or taken in slices.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a local session, as in tests, has a folder of this machine; a cluster has an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    at = os.path.join(tempfile.gettempdir(), "quillgraph-shared")
    os.makedirs(at, exist_ok=True)
    return f"file://{at}"


#: Tables that ``cut`` wrote and nobody removed yet, with what removes them.
_written: dict[str, Callable[[], object]] = {}


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lineage ends there and any executor can read it again.

    Tables that a result still reads stay until ``forget_all`` or the end of this process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quill-{uuid.uuid4().hex}.parquet"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    _written[path.rsplit("/", 1)[1]] = lambda: fs.delete(at, True)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Removes tables that ``cut`` wrote, once nothing reads them any more."""
    for df in tables:
        for f in {os.path.basename(os.path.dirname(x)) for x in df.inputFiles()}:
            if remove := _written.pop(f, None):
                remove()


def forget_all() -> None:
    """Removes every table that ``cut`` wrote in this process; for when no result is read any more."""
    while _written:
        _, remove = _written.popitem()
        try:
            remove()
        except Exception:  # noqa: BLE001 the JVM may be gone at the end of the process
            return


atexit.register(forget_all)


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the identifier and the text, under private names, whatever other columns there are."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def bounded_sample(df: DataFrame, rows: int, seed: int = 0) -> list:
    """At most ``rows`` rows, those with the smallest hash of doc_id: the same for the same table, in any partitioning. For fitting models only."""
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return df.withColumn("__h", h).orderBy("__h", "doc_id").limit(rows).drop("__h").collect()
