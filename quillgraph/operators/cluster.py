"""Entity deduplication within a document set: similar pairs, connected components, canonical entities."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.operators import vector
from quillgraph.sources.shared import written

THRESHOLD, MAX_BATCH, OVERLAP, SAME_NAME = 0.70, 25, 5, 0.99


def same_name_pairs(rows: DataFrame, key: str = "uuid", name: str = "name") -> DataFrame:
    """(a, b, score): pairs whose trimmed names are equal regardless of case. Each such group hands on a star to its least key, so a name held by thousands stays cheap and connects all the same."""
    k = rows.select(F.col(key).alias("b"), F.lower(F.trim(name)).alias("n")).where("n <> ''")
    least = k.groupBy("n").agg(F.min("b").alias("a"))  # a hot name is summed up before the shuffle, and its join can be split
    return k.join(least, "n").where("a <> b").select("a", "b", F.lit(SAME_NAME).alias("score"))


def components(nodes: DataFrame, edges: DataFrame, key: str = "uuid") -> DataFrame:
    """(key, root): the least key of each node's component; a lone node is its own. Alternating large-star and small-star; each round is written to the shared folder."""
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        sign = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == last or not sign[0]:
            break
        last = sign
    return nodes.select(key).join(e.select(F.col("u").alias(key), F.col("v").alias("root")), key, "left").select(key, F.coalesce("root", key).alias("root"))


def similarity_order(vectors: np.ndarray, frontier: int = 10) -> list[int]:
    """Greedy order that keeps like beside like: start at 0, then the rest's most similar to any of the last ``frontier``; ties to the smaller index."""
    if not len(vectors):
        return []
    n = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, n, out=np.zeros_like(vectors, dtype=float), where=n > 0)
    s = unit @ unit.T
    order, left = [0], list(range(1, len(vectors)))
    while left:
        best = s[np.ix_(left, order[-frontier:])].max(axis=1)
        order.append(left.pop(int(np.argmax(best))))
    return order


def batches(n: int, size: int = MAX_BATCH, overlap: int = OVERLAP) -> list[range]:
    """Ranges of at most ``size`` that overlap, so groups that span a cut are seen whole in one of them."""
    if n <= size:
        return [range(n)]
    step = max(1, size - overlap)
    return [range(k, min(k + size, n)) for k in range(0, n - overlap if n > overlap else 1, step)]


def merge_batches(groups: Sequence[Sequence[int]]) -> list[list[int]]:
    """Groups of several batches as one partition: a member stays with the group that had it first, and groups that share members become one."""
    at: dict[int, int] = {}
    out: list[list[int]] = []
    for g in groups:
        known = [at[m] for m in g if m in at]
        k = known[0] if known else len(out)
        if not known:
            out.append([])
        for m in g:
            if m not in at:
                at[m] = k
                out[k].append(m)
    return [g for g in out if g]


def verified(members: DataFrame, decide: Callable[[list[dict]], list[list[int]]], max_batch: int = MAX_BATCH) -> DataFrame:
    """(uuid, root, part): components as a decider splits them. ``members``: uuid, root, seq, name, entity_type, summary, vector. Lone members aren't asked about; more than ``max_batch`` are put in similarity order and asked in overlapping batches."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable").reset_index(drop=True)
        rows = pdf[["uuid", "name", "entity_type", "summary"]].to_dict("records")
        order = list(range(len(rows)))
        if len(rows) > max_batch:
            order = similarity_order(np.array(pdf["vector"].tolist(), float))
        groups = []
        if len(rows) > 1:
            for b in batches(len(order), max_batch):
                idx = [order[k] for k in b]
                groups += [[idx[k] for k in g if 0 <= k < len(idx)] for g in decide([rows[k] for k in idx])]
        groups = merge_batches(groups)
        part = {m: min(g) for g in groups for m in g}
        return pd.DataFrame({"uuid": pdf["uuid"].tolist(), "root": pdf["root"].tolist(), "part": [part.get(k, k) for k in range(len(rows))]})

    return members.groupBy("root").applyInPandas(solve, "uuid string, root string, part long")


def keep_component(rows: list[dict]) -> list[list[int]]:
    """The decider without a model: a component is one entity."""
    return [list(range(len(rows)))]


def canonical(entities: DataFrame, roots: DataFrame) -> DataFrame:
    """(uuid, name, entity_type, summary, aliases, members) of each group: the name and type of its first member by seq, the non-blank summaries joined in that order, other names as aliases."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("seq", "uuid", "name", "entity_type", "summary"))), lambda x: x)
    g = entities.join(roots, "uuid").groupBy("root").agg(m.alias("m"))
    name = F.col("m")[0]["name"]
    return g.select(
        F.col("root").alias("uuid"),
        name.alias("name"),
        F.col("m")[0]["entity_type"].alias("entity_type"),
        F.array_join(F.filter(F.transform("m", lambda x: F.trim(F.coalesce(x["summary"], F.lit("")))), lambda x: x != ""), " ").alias("summary"),
        F.filter(F.transform("m", lambda x: x["name"]), lambda x: x != name).alias("aliases"),
        F.transform("m", lambda x: x["uuid"]).alias("members"),
    )


def merge_history(groups: DataFrame) -> DataFrame:
    """(canonical, member, position) of groups of two or more."""
    return groups.where(F.size("members") > 1).select(F.col("uuid").alias("canonical"), F.posexplode("members").alias("position", "member")).select("canonical", "member", "position")


def deduplicate(entities: DataFrame, threshold: float = THRESHOLD, max_batch: int = MAX_BATCH, decide: Callable[[list[dict]], list[list[int]]] | None = None) -> DataFrame:
    """Canonical entities of (uuid, seq, name, entity_type, summary, vector)."""
    e = vector.links(entities, threshold).unionByName(same_name_pairs(entities).select("a", "b"))
    roots = components(entities, e)
    if decide is not None:
        parts = verified(entities.join(roots, "uuid"), decide, max_batch)
        first = F.min("uuid").over(W.partitionBy("root", "part"))
        roots = parts.select("uuid", first.alias("root"))
    return canonical(entities, roots)
