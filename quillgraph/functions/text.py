"""Scalar text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relationship_type(raw: Column) -> Column:
    """UPPER_SNAKE of the first eight words without parentheses; RELATED_TO for nothing."""
    plain = F.regexp_replace(F.regexp_replace(raw, r"\([^)]*\)", " "), r"[^A-Za-z0-9]+", " ")
    return F.coalesce(F.nullif(F.array_join(F.slice(F.split(F.upper(F.trim(plain)), " "), 1, 8), "_"), F.lit("")), F.lit("RELATED_TO"))


def entity_name(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"\s*\([^)]*\)\s*", " "), r"\s+", " "))


def chunk_id(doc: Column, seq: Column) -> Column:
    return F.format_string("%s_chunk_%04d", doc, seq)


def topic_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def without_type_suffix(name: Column) -> Column:
    """Cut at the first ": ", then a trailing "(Type)" goes."""
    return F.trim(F.regexp_replace(F.substring_index(name, ": ", 1), r"\s*\([A-Z][a-zA-Z]*\)$", ""))


def entity_text(name: Column, definition: Column, summary: Column) -> Column:
    """What is embedded for deduplication: the name with its definition, else its summary, else alone."""
    given = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(given(definition), F.concat(name, F.lit(": "), definition)).when(given(summary), F.concat(name, F.lit(": "), summary)).otherwise(name)


def named_text(name: Column, summary: Column) -> Column:
    return F.concat(name, F.lit(": "), summary)


def question_type(question: Column) -> Column:
    q = F.lower(question)
    has = lambda *w: F.lit(False) if not w else F.concat(F.lit(" "), F.regexp_replace(q, r"[^a-z0-9]+", " "), F.lit(" ")).rlike(" (" + "|".join(w) + ") ")
    return F.when(has("compare", "versus", "vs", "difference"), "comparison").when(has("why", "cause", "caused", "because"), "causal").when(has("when", "before", "after", "during", "since"), "temporal").when(has("list", "which", "what are", "how many", "all"), "enumeration").otherwise("factual")


_STOP = ("What", "Which", "Who", "When", "Where", "How")


def capitalised_hints(question: Column) -> Column:
    """Capitalised words but the first, without punctuation around them and common question words."""
    words = F.transform(F.split(F.trim(question), r"\s+"), lambda w: F.regexp_replace(w, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    return F.filter(F.slice(words, 2, 1_000_000), lambda w: w.rlike("^[A-Z]") & (F.length(w) > 1) & ~w.isin(*_STOP))


def csv_list(raw: Column) -> Column:
    return F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")


def spaced(name: Column) -> Column:
    return F.replace(name, F.lit("_"), F.lit(" "))


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")


def likely(score: Column, at: float) -> Column:
    return F.when(score >= at, "LIKELY").otherwise("")


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun; none for nothing."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor((n + 3) / 4))).cast("long")


def chat_tokens(texts: Column) -> Column:
    return F.aggregate(F.transform(texts, lambda t: token_estimate(t) + F.lit(4)), F.lit(0).cast("long"), lambda a, b: a + b)


def document_date(y: Column, m: Column, d: Column) -> Column:
    """ISO text of a date with month and day defaulting to 1; null if there is no such date."""
    made = F.format_string("%04d-%02d-%02d", y.cast("int"), F.coalesce(m, F.lit(1)).cast("int"), F.coalesce(d, F.lit(1)).cast("int"))
    return F.when(y.isNotNull(), F.try_to_date(made, "yyyy-MM-dd").cast("string"))


def content_id(*parts: Column) -> Column:
    """An identifier that depends on content alone, so writing twice changes nothing."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32)


def contains_line(text: Column, pattern: str, fixed: bool = True, ignore_case: bool = False) -> Column:
    """grep -F or -E as a predicate."""
    if fixed:
        return F.lower(text).contains(pattern.lower()) if ignore_case else text.contains(pattern)
    return text.rlike(("(?i)" if ignore_case else "") + pattern)
