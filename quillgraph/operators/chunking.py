"""Header-aware chunks of Markdown.

A section is the text under a header, with the path of the headers above it. Its
paragraphs are the pieces between blank lines; tables and fenced code are never cut.
A section of more than ``max_paragraphs`` is divided evenly, larger parts first; chunks
shorter than ``min_chars`` go, and positions count those that stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_PARAGRAPHS, MIN_CHARS = 6, 50
_HEADER = r"^(#{1,6})[ \t]+(.+)$"


def lines(docs: DataFrame) -> DataFrame:
    """(uuid, pos, line, level, title) of every line; level 0 is text."""
    split = docs.select("uuid", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("pos", "line"))
    level = F.length(F.regexp_extract("line", _HEADER, 1))
    return split.select("uuid", "pos", "line", level.alias("level"), F.trim(F.regexp_extract("line", _HEADER, 2)).alias("title"))


def breadcrumbs(docs: DataFrame) -> DataFrame:
    """``lines`` with section, the number of headers so far, and header_path, "A > B". A header of level k closes those of level k and deeper."""
    w = W.partitionBy("uuid").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = lines(docs).withColumn("section", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    for k in range(1, 7):
        rows = rows.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(w)).withColumn(f"t{k}", F.last(F.when(F.col("level") == k, F.col("title")), True).over(w))
    above = None
    parts = []
    for k in range(1, 7):
        here = F.col(f"at{k}")
        parts.append(F.when(here.isNotNull() & (F.lit(True) if above is None else here > above), F.col(f"t{k}")))
        above = F.coalesce(here, F.lit(-1)) if above is None else F.greatest(above, F.coalesce(here, F.lit(-1)))
    return rows.select("uuid", "pos", "line", "level", "title", "section", F.concat_ws(" > ", *parts).alias("header_path"))


def sections(docs: DataFrame) -> DataFrame:
    """(uuid, section, header_path, text) of every section with text."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    return breadcrumbs(docs).groupBy("uuid", "section").agg(F.first("header_path").alias("header_path"), body.alias("text")).where(F.trim("text") != "")


def plain_chunks(docs: DataFrame, max_paragraphs: int = MAX_PARAGRAPHS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(uuid, position, header_path, content) where no text has tables or fences: one plan, no Python."""
    trimmed = lambda c: F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")
    s = sections(docs).withColumn("ps", F.filter(F.transform(F.split("text", "\n\n"), trimmed), lambda x: x != ""))
    n = F.size("ps")
    s = s.withColumn("parts", F.ceil(n / max_paragraphs).cast("int")).where("parts > 0")
    s = s.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    small, more = F.floor(n / F.col("parts")).cast("int"), n % F.col("parts")
    piece = F.slice("ps", F.col("part") * small + F.least("part", more) + 1, small + F.when(F.col("part") < more, 1).otherwise(0))
    content = F.when(F.col("parts") == 1, trimmed(F.col("text"))).otherwise(F.array_join(piece, "\n\n"))
    kept = s.select("uuid", "section", "part", "header_path", content.alias("content")).where(F.length("content") >= min_chars)
    at = F.row_number().over(W.partitionBy("uuid").orderBy("section", "part")) - 1
    return kept.withColumn("position", at).select("uuid", "position", "header_path", "content")


_ATOM = re.compile(r"<table\b.*?</table>|```.*?```", re.S | re.I)


def paragraphs(text: str) -> list[str]:
    """Trimmed pieces between blank lines; a table or fenced block is one piece whatever is in it, and where two overlap the first wins."""
    out, at = [], 0
    for m in _ATOM.finditer(text):
        out += [p.strip() for p in text[at : m.start()].split("\n\n")]
        out.append(m.group().strip())
        at = m.end()
    out += [p.strip() for p in text[at:].split("\n\n")]
    return [p for p in out if p]


def evenly(ps: list[str], most: int) -> list[list[str]]:
    parts = -(-len(ps) // most)
    size, more = divmod(len(ps), parts) if parts else (0, 0)
    cut = [k * size + min(k, more) for k in range(parts + 1)]
    return [ps[a:z] for a, z in zip(cut, cut[1:])]


def chunks(docs: DataFrame, max_paragraphs: int = MAX_PARAGRAPHS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(uuid, position, header_path, content) with tables and fences kept whole. Sections are cut apart by the plan, paragraphs in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for uuid, section, path, text in zip(b["uuid"], b["section"], b["header_path"], b["text"]):
                ps = paragraphs(text)
                pieces = [text.strip()] if len(ps) <= max_paragraphs else ["\n\n".join(x) for x in evenly(ps, max_paragraphs)]
                rows += [(uuid, section, k, path, x) for k, x in enumerate(pieces) if len(x) >= min_chars]
            yield pd.DataFrame(rows, columns=["uuid", "section", "part", "header_path", "content"])

    kept = sections(docs).mapInPandas(run, "uuid string, section long, part long, header_path string, content string")
    at = F.row_number().over(W.partitionBy("uuid").orderBy("section", "part")) - 1
    return kept.withColumn("position", at).select("uuid", "position", "header_path", "content")
