"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. The token weights of the
cells are raked: scaled in turn to the target share of every source, language and
topic, ``ROUNDS`` times over. A document is then drawn with its cell's calibrated
probability p = min(1, scale * raked share / tokens), where the scale is raised in
``CLIPS`` steps so that the expected tokens of the sample come to ``KEEP`` of the
input though some cells are taken whole. The draw is a fixed function of doc_id,
so it is the same in any partitioning, and again for repeated rows.

Tokens are estimated as a quarter of the characters, rounded up. The topic is told
by the form of the text: "legal" for licence and copyright lines, "tabular" for
cells between bars, "contact" for at-signs, else "prose". Both are parameters in
form of columns. Target shares are by default the input's own to the power of
``POWERS`` (0.5 for sources, so a hot source is damped), then made to sum to one.

Cells are few in comparison with documents. Up to ``DRIVER_CELLS`` they are raked
on the driver; more are raked as a table, a written copy a round, by the same sums.

Defined results. A null source, language or topic is a category of its own. A null
or empty text has no tokens and the probability of its cell; a cell without
tokens has probability 0. A null doc_id draws as the empty string. Repeated rows are drawn or left alike. A draw that equals
the probability is left. Texts count at their whole length. Of an empty table nothing is drawn. A clashing
column of the input is kept and ours is left out where results are joined to it.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import BROADCAST_BYTES, cut, forget

POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEEP, ROUNDS, CLIPS, DRIVER_CELLS = 0.5, 20, 8, 100_000
DIMS = ("source", "lang", "topic")


class Parts(NamedTuple):
    source: Column
    lang: Column
    topic: Column
    tokens: Column


def parts(source: str = "source", lang: str = "lang", text: str = "text") -> Parts:
    t = F.col(f"`{text}`")
    topic = F.when(t.contains("icense") | t.contains("opyright"), "legal").when(t.contains(" | "), "tabular").when(t.contains("@"), "contact").when(t.isNull(), F.lit(None)).otherwise("prose")
    none = F.lit("<null>")
    return Parts(F.coalesce(F.col(f"`{source}`").cast("string"), none), F.coalesce(F.col(f"`{lang}`").cast("string"), none), F.coalesce(topic, none), F.coalesce(F.ceil(F.length(t) / 4), F.lit(0)).cast("long"))


def draw(id_col: str = "doc_id") -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of the identifier's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def cells(docs: DataFrame, p: Parts) -> DataFrame:
    return docs.select(*(c.alias(n) for n, c in zip((*DIMS, "tokens"), p))).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))


def rake(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Token weights whose sums by each of ``keys`` (category numbers) approach ``targets`` times all tokens."""
    w = tokens.astype(np.float64)
    total = w.sum()
    for _ in range(rounds):
        for k, t in zip(keys, targets):
            have = np.bincount(k, w, len(t))
            w = w * np.divide(t * total, have, out=np.zeros(len(t)), where=have > 0)[k]
    return w


def calibrate(weights: np.ndarray, tokens: np.ndarray, keep: float = KEEP, clips: int = CLIPS) -> np.ndarray:
    """Probability by cell, so that sum(p * tokens) approaches ``keep`` of all tokens and no p is over 1."""
    want = keep * tokens.sum()
    p = np.zeros(len(tokens))
    whole = tokens == 0
    for _ in range(clips):
        free = weights[~whole].sum()
        if free <= 0:
            break
        scale = max(0.0, want - tokens[whole].sum()) / free
        p = np.where(whole, 1.0, np.minimum(1.0, np.divide(weights * scale, tokens, out=np.zeros(len(tokens)), where=tokens > 0)))
        whole = p >= 1
        whole |= tokens == 0
    return np.where(tokens == 0, 0.0, p)


def default_targets(sums: np.ndarray, power: float) -> np.ndarray:
    t = np.where(sums > 0, sums.astype(np.float64), 0) ** power
    t = np.where(sums > 0, t, 0)
    return t / t.sum() if t.sum() > 0 else t


def _rates_on_driver(rows: list, keep: float, rounds: int, powers: dict[str, float], targets: dict[str, dict[str, float]] | None) -> list[tuple]:
    rows = sorted(rows, key=lambda r: tuple(r[d] for d in DIMS))
    tokens = np.array([r["tokens"] for r in rows], np.float64)
    keys, goal = [], []
    for d in DIMS:
        names, k = np.unique([r[d] for r in rows], return_inverse=True)
        keys.append(k)
        given = (targets or {}).get(d)
        if given is None:
            goal.append(default_targets(np.bincount(k, tokens, len(names)), powers[d]))
        else:
            t = np.array([float(given.get(x, 0.0)) for x in names.tolist()])
            goal.append(t / t.sum() if t.sum() > 0 else t)
    w = rake(keys, tokens, goal, rounds)
    p = calibrate(w, tokens, keep)
    return [(*(r[d] for d in DIMS), float(x), float(y)) for r, x, y in zip(rows, w, p)]


def _rates_as_table(c: DataFrame, keep: float, rounds: int, powers: dict[str, float], targets: dict[str, dict[str, float]] | None) -> DataFrame:
    """The same sums for any number of cells: three grouped sums and joins a round, each round written to the shared folder."""
    spark = c.sparkSession
    total = float(c.agg(F.sum("tokens")).first()[0] or 0)
    w = c.withColumn("w", F.col("tokens").cast("double"))
    goals = {}
    for d in DIMS:
        given = (targets or {}).get(d)
        sums = c.groupBy(d).agg(F.sum("tokens").alias("s"))
        if given is None:
            powered = sums.withColumn("g", F.when(F.col("s") > 0, F.pow(F.col("s").cast("double"), F.lit(powers[d]))).otherwise(0.0))
        else:
            wanted = spark.createDataFrame([(k, float(v)) for k, v in given.items()] or [("", 0.0)], f"`{d}` string, v double")
            powered = sums.join(wanted, d, "left").withColumn("g", F.coalesce("v", F.lit(0.0)))
        whole = float(powered.agg(F.sum("g")).first()[0] or 0) or 1.0
        goals[d] = cut(powered.select(d, (F.col("g") / whole * total).alias("g")))
    last = None
    for _ in range(rounds):
        for d in DIMS:
            f = w.groupBy(d).agg(F.sum("w").alias("have")).join(goals[d], d).select(d, F.when(F.col("have") > 0, F.col("g") / F.col("have")).otherwise(0.0).alias("f"))
            w = w.join(f, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        w = cut(w.select(*DIMS, "tokens", "w"))
        if last is not None:
            forget(last)
        last = w
    forget(*goals.values())
    want, p = keep * total, F.lit(0.0)
    whole = F.col("tokens") == 0
    for _ in range(CLIPS):
        free, taken = (float(x or 0) for x in w.agg(F.sum(F.when(~whole, F.col("w"))), F.sum(F.when(whole, F.col("tokens")))).first())
        if free <= 0:
            break
        p = F.when(whole, 1.0).otherwise(F.least(F.lit(1.0), F.col("w") * (max(0.0, want - taken) / free) / F.col("tokens")))
        w = cut(w.withColumn("p", p))
        forget(last)
        last = w
        whole = (F.col("p") >= 1) | (F.col("tokens") == 0)
    if "p" not in w.columns:
        w = w.withColumn("p", F.lit(0.0))
    return w.select(*DIMS, F.col("w").alias("weight"), F.when(F.col("tokens") == 0, 0.0).otherwise(F.col("p")).alias("p"))


def rates(docs: DataFrame, p: Parts | None = None, keep: float = KEEP, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, targets: dict[str, dict[str, float]] | None = None, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, weight, p) of every cell."""
    c = cut(cells(docs, p or parts()))
    if c.count() > driver_cells:
        made = _rates_as_table(c, keep, rounds, powers, targets)
    else:
        made = docs.sparkSession.createDataFrame(_rates_on_driver(c.collect(), keep, rounds, powers, targets), "source string, lang string, topic string, weight double, p double")
    forget(c)
    return made


def _with_rates(docs: DataFrame, p: Parts, id_col: str, how: dict) -> DataFrame:
    """``docs`` with the private columns __source, __lang, __topic, __tokens, __p; the cells are few, so their side of the join is broadcast if its size allows."""
    r = rates(docs, p, **how).select(*(F.col(d).alias(f"__{d}") for d in DIMS), F.col("p").alias("__p"))
    size = r.agg(F.count("*"), F.sum(sum((F.octet_length(f"__{d}") for d in DIMS), F.lit(0)))).first()
    small = size[0] * 64 + (size[1] or 0) <= BROADCAST_BYTES
    mine = docs.select("*", *(c.alias(f"__{n}") for n, c in zip((*DIMS, "tokens"), p)))
    return mine.join(F.broadcast(r) if small else r, [f"__{d}" for d in DIMS]).where(draw(id_col) < F.col("__p"))


def sample(docs: DataFrame, id_col: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", **how) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are, and of topic, tokens and p those that it has not itself."""
    drawn = _with_rates(docs, parts(source, lang, text), id_col, how)
    ours = {"topic": F.col("__topic"), "tokens": F.col("__tokens"), "p": F.round("__p", 6)}
    taken = {c.lower() for c in docs.columns}
    return drawn.select(*(F.col(f"`{c}`") for c in docs.columns), *(c.alias(n) for n, c in ours.items() if n not in taken))


def mixture(docs: DataFrame, id_col: str = "doc_id", source: str = "source", lang: str = "lang", text: str = "text", **how) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, p) of every drawn document."""
    drawn = _with_rates(docs, parts(source, lang, text), id_col, how)
    return drawn.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("__source").alias("source"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.round("__p", 6).alias("p"))


def sql(keep: float = KEEP, rounds: int = ROUNDS, powers: dict[str, float] = POWERS, clips: int = CLIPS) -> str:
    """The same rows as ``mixture(documents)`` in DuckDB's SQL, every round written out."""
    out = [
        """docs as materialized (select doc_id, coalesce(source, '<null>') source, coalesce(lang, '<null>') lang,
  case when contains(text, 'icense') or contains(text, 'opyright') then 'legal' when contains(text, ' | ') then 'tabular' when contains(text, '@') then 'contact' when text is null then '<null>' else 'prose' end topic,
  coalesce(cast(ceil(length(text) / 4) as bigint), 0) tokens,
  cast(cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 13) as bigint) as double) / 4503599627370496.0 u from documents)""",
        "c0 as materialized (select source, lang, topic, cast(sum(tokens) as double) tokens, cast(sum(tokens) as double) w, " + ", ".join(f"sum(sum(tokens)) over (partition by {d}) s_{d}" for d in DIMS) + ", sum(sum(tokens)) over () total from docs group by source, lang, topic)",
    ]
    for d in DIMS:
        out.append(f"g_{d} as materialized (select {d}, pow(s, {powers[d]}) / sum(pow(s, {powers[d]})) over () g from (select distinct {d}, cast(s_{d} as double) s from c0 where s_{d} > 0))")
    out.append("r0 as materialized (select c0.source, c0.lang, c0.topic, tokens, w, cast(total as double) total, " + ", ".join(f"coalesce(g_{d}.g, 0) g_{d}" for d in DIMS) + " from c0 " + " ".join(f"left join g_{d} on g_{d}.{d} = c0.{d}" for d in DIMS) + ")")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            out.append(f"r{k + 1} as materialized (select * replace (case when sum(w) over (partition by {d}) > 0 then w * (g_{d} * total / sum(w) over (partition by {d})) else 0 end as w) from r{k})")
            k += 1
    out.append(f"p0 as materialized (select source, lang, topic, tokens, w, {keep} * total want, case when tokens = 0 then 1.0 else 0.0 end p from r{k})")
    for j in range(clips):
        out.append(
            f"p{j + 1} as materialized (select source, lang, topic, tokens, w, want, case when tokens = 0 or p >= 1 then 1.0 when free <= 0 then p else least(1.0, w * (greatest(0.0, want - taken) / free) / tokens) end p from (select *, coalesce(sum(w) filter (tokens > 0 and p < 1) over (), 0) free, coalesce(sum(tokens) filter (tokens = 0 or p >= 1) over (), 0) taken from p{j}))"
        )
    return "with " + ",\n".join(out) + f"\nselect d.doc_id, d.source, d.lang, d.topic, d.tokens, round(c.p, 6) p from docs d join p{clips} c on c.source = d.source and c.lang = d.lang and c.topic = d.topic where c.tokens > 0 and d.u < c.p"
