"""A knowledge base on disk: a folder of Parquet tables partitioned by tenant, with a metadata file and a lock for its single writer."""

from __future__ import annotations

import contextlib
import json
import os
import re
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import content_id
from quillgraph.operators import chunking
from quillgraph.sources.schemas import TABLES

VERSION = "1.0.0"


class Store:
    """``root`` is a folder that the driver and the executors share."""

    def __init__(self, spark: SparkSession, root: str, group: str = "default", dimensions: int | None = None) -> None:
        if not re.fullmatch(r"[a-zA-Z0-9_-]+", group):
            raise ValueError(f"a tenant has letters, digits, hyphens and underscores: {group!r}")
        self.spark, self.root, self.group = spark, root, group
        os.makedirs(root, exist_ok=True)
        meta = self.path("metadata.json")
        if not os.path.exists(meta):
            with open(meta, "w") as f:
                json.dump({"version": VERSION, "created_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "embedding_dimensions": dimensions}, f)

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    @contextlib.contextmanager
    def lock(self, timeout: float = 30.0) -> Iterator[None]:
        """One writer at a time; a lock file that only its maker removes."""
        at, until = self.path(".lock"), time.time() + timeout
        while True:
            try:
                fd = os.open(at, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
                break
            except FileExistsError:
                if time.time() > until:
                    raise TimeoutError(f"{at} is held by another writer") from None
                time.sleep(0.05)
        try:
            yield
        finally:
            os.close(fd)
            os.unlink(at)

    def read(self, table: str, group: str | None = "") -> DataFrame:
        """The tenant's rows; of a table that isn't there yet, none. ``group`` None reads all tenants."""
        at = self.path(table)
        has = os.path.isfile(at) or os.path.isdir(at) and any(not n.startswith((".", "_")) for n in os.listdir(at))
        df = self.spark.read.schema(TABLES[table]).parquet(at) if has else self.spark.createDataFrame([], TABLES[table])
        return df if group is None else df.where(F.col("group_id") == (group or self.group))

    def shaped(self, table: str, rows: DataFrame) -> DataFrame:
        """``rows`` with the table's columns in order: missing ones are null, text nulls become empty, the tenant and time are ours."""
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        out = []
        for f in TABLES[table].fields:
            kind = f.dataType.simpleString()
            c = F.col(f.name).cast(kind) if f.name in rows.columns else F.lit(None).cast(kind)
            if f.name == "group_id":
                c = F.lit(self.group)
            elif f.name in ("created_at", "updated_at"):
                c = F.coalesce(c, now)
            elif kind == "string":
                c = F.coalesce(c, F.lit(""))
            out.append(c.alias(f.name))
        return rows.select(*out)

    def append(self, table: str, rows: DataFrame) -> None:
        """Adds files; what is there is not read. A table that is a single file becomes the first file of its folder."""
        at = self.path(table)
        with self.lock():
            if os.path.isfile(at):
                legacy = self.spark.read.parquet(at)
                moved = f"{at}.legacy-{uuid.uuid4().hex}"
                os.rename(at, moved)
                old = self.spark.read.schema(legacy.schema).parquet(moved)
                self._write(table, old if "group_id" in old.columns else old.withColumn("group_id", F.lit(self.group)))
                os.unlink(moved)
            self._write(table, self.shaped(table, rows))

    def _write(self, table: str, rows: DataFrame) -> None:
        rows.write.mode("append").option("compression", "zstd").partitionBy("group_id").parquet(self.path(table))

    def merge(self, table: str, rows: DataFrame, key: str = "uuid") -> None:
        """Appends the rows whose key isn't there yet, each key once."""
        new = rows.dropDuplicates([key]).join(self.read(table).select(key), key, "left_anti")
        self.append(table, new)

    def replace(self, table: str, rows: DataFrame) -> None:
        """This tenant's rows of a table, in place of those it had; other tenants keep theirs. The rows must not be read from the table."""
        with self.lock():
            self.shaped(table, rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("group_id").parquet(self.path(table))
        self.spark.catalog.refreshByPath(self.path(table))

    def update_summaries(self, changes: DataFrame) -> None:
        """Applies (uuid, summary) in one rewrite: written beside the table, then swapped in."""
        at, new, old = self.path("entities"), self.path(f"entities.new-{uuid.uuid4().hex}"), self.path(f"entities.old-{uuid.uuid4().hex}")
        if not os.path.exists(at):
            return
        with self.lock():
            c = changes.groupBy("uuid").agg(F.max("summary").alias("__new"))
            rows = self.read("entities", None).join(c, "uuid", "left")
            mine = (F.col("group_id") == self.group) & F.col("__new").isNotNull()
            now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            out = rows.withColumn("summary", F.when(mine, F.col("__new")).otherwise(F.col("summary"))).withColumn("updated_at", F.when(mine, now).otherwise(F.col("updated_at")))
            out.select(*TABLES["entities"].names).write.option("compression", "zstd").partitionBy("group_id").parquet(new)
            os.rename(at, old)
            os.rename(new, at)
        import shutil

        shutil.rmtree(old) if os.path.isdir(old) else os.unlink(old)
        self.spark.catalog.refreshByPath(at)

    def stats(self) -> dict[str, int]:
        from quillgraph.operators.graph import counts

        return {r["kind"]: r["n"] for r in counts(**{t: self.read(t) for t in ("documents", "entities", "chunks", "facts")}).collect()}

    def add_markdown(self, docs: DataFrame, document_date: str | None = None, max_chunks: int | None = None) -> None:
        """Documents (name, content) and their chunks, by content: what is there already stays as it is."""
        if max_chunks is not None and max_chunks <= 0:
            raise ValueError("max_chunks is over 0")
        rows = docs.select(content_id(F.col("name"), F.col("content")).alias("uuid"), "name", "content")
        date = F.lit(document_date).cast("string")
        self.merge("documents", rows.select("uuid", "name", date.alias("document_date"), F.col("name").alias("source_path"), F.lit("markdown").alias("file_type"), F.lit("{}").alias("metadata")))
        cut = chunking.chunks(rows.select("uuid", "content"))
        if max_chunks is not None:
            cut = cut.where(F.col("position") < max_chunks)
        self.merge("chunks", cut.select(content_id(F.col("uuid"), F.col("position")).alias("uuid"), "content", "header_path", "position", F.col("uuid").alias("document_uuid"), date.alias("document_date")))

    def add_chunks(self, chunks: DataFrame, document_date: str | None = None) -> None:
        """Chunks of one document (content, header_path, document_uuid, and position, uuid, document_date if known)."""
        n = chunks.select("document_uuid").distinct().limit(2).count()
        if n != 1:
            raise ValueError("all chunks belong to one document" if n else "there are no chunks")
        have = set(chunks.columns)
        dates = chunks.where("document_date <> ''").orderBy(*(c for c in ("position",) if c in have), "content").select("document_date").first() if "document_date" in have else None
        date = F.lit(document_date or (dates[0] if dates else None)).cast("string")
        from pyspark.sql import Window as W

        at = F.row_number().over(W.partitionBy("document_uuid").orderBy("header_path", "content")) - 1
        rows = chunks.withColumn("position", F.coalesce("position", at) if "position" in have else at)
        made = content_id(F.col("document_uuid"), F.col("position"), F.col("content"))
        rows = rows.withColumn("uuid", F.coalesce("uuid", made) if "uuid" in have else made)
        rows = rows.withColumn("document_date", F.coalesce(F.nullif(F.col("document_date"), F.lit("")), date) if "document_date" in have else date)
        self.merge("chunks", rows)
        self.merge("documents", rows.select(F.col("document_uuid").alias("uuid"), F.col("document_uuid").alias("name"), date.alias("document_date")))
