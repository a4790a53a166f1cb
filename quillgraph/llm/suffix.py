"""Benchmark decontamination with suffix arrays of the training text.

Every shard of training text (whole documents of about ``SHARD`` bytes) gets a
suffix array over its words. Words are maximal runs of letters and digits, with
ASCII case folded; order is that of a 20-bit symbol of the word's hash, refined
by prefix doubling as deep as the longest benchmark item. Every suffix of every
benchmark item is binary-searched in every shard. The interval that shares its
first ``min_words`` words holds all its locations; each is then extended with the
full 64-bit hashes to its longest match, so symbols that collide do no harm. Only
matches that can't be extended to the left are reported.

An item shorter than ``min_words`` words matches as a whole, if it has at least
``least_item_words``. The suffixes of the items are handed to every executor; items
beyond ``BROADCAST_BYTES`` of text are taken in slices, each a scan of its own.

Defined results. Null and empty texts and items match nothing. Repeated rows and
repeated items repeat their matches; an item without an id matches without one. A document is affected if it has a match, and
each row, with an id or without, is judged by its own text. A text of more than ``SHARD`` bytes is searched in shards that overlap by the
longest item, so no match is lost or found twice. Several matches at one place are all reported, so there are no ties. Without documents or items there
are no matches. Only the named columns are read; ``decontaminate`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import BROADCAST_BYTES, texts

MIN_WORDS, LEAST_ITEM_WORDS, SHARD = 12, 5, 2 << 20
_BITS = 20
MATCHES = "doc_id long, item_id long, words int, start int, `end` int, item_word int"


class Items(NamedTuple):
    """The suffixes of all items: word hashes with a gap after each item, and for each suffix its first word, its item and how many words must match."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    item: np.ndarray
    within: np.ndarray
    need: np.ndarray
    deepest: int


def _hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    s, e, toks = K.spans(raw, offs)
    return K.hashes(raw, s, e) | np.uint64(1 << 44), s, e, toks  # bit 44 keeps every symbol above the gap's 0


def item_suffixes(rows: list[tuple[int | None, str | None]], min_words: int = MIN_WORDS, least_item_words: int = LEAST_ITEM_WORDS) -> Items:
    raw, offs = K.buffers(pa.array([t or "" for _, t in rows], pa.large_string()))
    h, _, _, toks = _hashes(raw, offs)
    n = np.diff(toks)
    words = np.zeros(len(h) + len(n), np.uint64)
    item = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(h)) + item
    words[at] = h
    within = np.arange(len(h)) - np.repeat(toks[:-1], n)
    size = np.repeat(n, n)
    need = np.minimum(min_words, size)
    take = (within + need <= size) & (size >= least_item_words)
    return Items([i for i, _ in rows], words, at[take], item[take], within[take], need[take], int(n.max(initial=0)))


def suffix_array(sym: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their next ``deep`` symbols at least, first two symbols of each); symbols have 20 bits."""
    n = len(sym)
    b = max(1, n.bit_length())
    two = (sym << np.uint64(_BITS)) | np.append(sym[1:], np.uint64(0))

    def order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        c = max(1, len(key).bit_length())
        if bits + c <= 64:
            packed = np.sort((key << np.uint64(c)) | np.arange(len(key), dtype=np.uint64))
            return (packed & np.uint64((1 << c) - 1)).astype(np.int64), packed >> np.uint64(c)
        at = np.argsort(key, kind="stable")
        return at, key[at]

    sa, first = order(two, 2 * _BITS)
    fresh = np.concatenate([[True], first[1:] != first[:-1]]) if n else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank = np.zeros(n + 1, np.uint64)  # of the end: 0, which no tie that matters looks at
    rank[sa] = head.astype(np.uint64)
    depth = 2
    slots = np.arange(n)
    while depth < deep and len(slots):
        f = fresh[slots]
        lone = f & np.append(f[1:], True)
        slots = slots[~lone]
        if not len(slots):
            break
        p = sa[slots]
        key = (rank[p] << np.uint64(b)) | rank[np.minimum(p + depth, n)]
        by, key = order(key, 2 * b)
        p = p[by]
        sa[slots] = p
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[slots] = new
        rank[p] = slots[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))].astype(np.uint64)
        depth *= 2
    return sa, first


def _bound(sym: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of the ``d``-th next symbol in many intervals at once; sym has a tail of zeros."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        x = sym[np.minimum(sa[np.minimum(mid, len(sa) - 1)] + d, len(sym) - 1)]
        up = (x <= want if after else x < want) & open_
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)


def search(raw: np.ndarray, offs: np.ndarray, items: Items, shard: int = SHARD) -> list[tuple[int, int, int, int, int, int]]:
    """Every match of a group of documents; one of over ``shard`` bytes, a group by itself, goes in overlapping shards."""
    if len(offs) > 2 or len(raw) <= shard or not len(items.first):
        return _search(raw, offs, items)
    s, e, _ = K.spans(raw, offs)
    out: list[tuple[int, int, int, int, int, int]] = []
    step = max(1, len(s) * shard // len(raw))
    for k in range(0, len(s), step):
        lo, hi = max(0, k - 1), min(len(s), k + step + items.deepest + 1)  # with the word before, which may extend a match to the left
        at, end = int(s[lo]), int(s[k + step]) if k + step < len(s) else len(raw)
        part = raw[at : int(e[hi - 1])]
        out += [(0, i, n, x + at, y + at, w) for _, i, n, x, y, w in _search(part, np.array([0, len(part)]), items) if s[k] <= x + at < end]
    return out


def _search(raw: np.ndarray, offs: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """(document, item, words, first byte, last byte + 1, word in item) of every match of a shard; documents and items by index, bytes in the document."""
    h, s, e, toks = _hashes(raw, offs)
    if not len(h) or not len(items.first):
        return []
    docs = len(toks) - 1
    doc = np.repeat(np.arange(docs), np.diff(toks))
    words = np.zeros(len(h) + docs + 1, np.uint64)  # a gap after every document
    words[np.arange(len(h)) + doc] = h
    sym = words >> np.uint64(64 - _BITS)
    sa, first = suffix_array(sym, items.deepest)
    want = items.words >> np.uint64(64 - _BITS)
    q = np.arange(len(items.first))
    key = (want[items.first] << np.uint64(_BITS)) | want[items.first + 1]
    lo, hi = np.searchsorted(first, key, "left"), np.searchsorted(first, key, "right")
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    d = 2
    while True:
        some = lo < hi
        q, lo, hi = q[some], lo[some], hi[some]
        full = items.need[q] <= d
        if full.any():
            done.append((q[full], lo[full], hi[full]))
            q, lo, hi = q[~full], lo[~full], hi[~full]
        if not len(q):
            break
        w = want[items.first[q] + d]
        lo, hi = _bound(sym, sa, lo, hi, d, w, False), _bound(sym, sa, lo, hi, d, w, True)
        d += 1
    if not done:
        return []
    q, lo, hi = (np.concatenate(x) for x in zip(*done))
    many = hi - lo
    slot = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
    q, pos = np.repeat(q, many), sa[slot]
    a = items.first[q]
    left = (items.within[q] > 0) & (pos > 0) & (words[np.maximum(pos - 1, 0)] == items.words[np.maximum(a - 1, 0)]) & (words[np.maximum(pos - 1, 0)] != 0)
    q, pos, a = q[~left], pos[~left], a[~left]
    length = np.zeros(len(q), np.int64)
    live = np.arange(len(q))
    while len(live):
        x, y = np.minimum(pos[live] + length[live], len(words) - 1), np.minimum(a[live] + length[live], len(items.words) - 1)
        live = live[(words[x] == items.words[y]) & (words[x] != 0)]
        length[live] += 1
    real = length >= items.need[q]
    q, pos, length = q[real], pos[real], length[real]
    ends = np.cumsum(np.diff(toks) + 1)
    owner = np.searchsorted(ends, pos, "right")
    word = pos - owner
    return [(int(o), int(items.item[k]), int(n), int(s[w] - offs[o]), int(e[w + n - 1] - offs[o]), int(items.within[k])) for k, o, w, n in zip(q, owner, word, length)]


def _slices(items: DataFrame, id_col: str, text_col: str, min_words: int, least_item_words: int) -> Iterator[Items]:
    rows = texts(items, id_col, text_col).where("text is not null and text <> ''")
    size = rows.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    parts = 1 + size // BROADCAST_BYTES
    for k in range(parts):
        some = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)) == k)
        got = sorted(((r.doc_id, r.text) for r in some.collect()), key=lambda x: (x[0] is None, x[0], x[1]))
        if got:
            yield item_suffixes(got, min_words, least_item_words)


def matches(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, least_item_words: int = LEAST_ITEM_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, words, start, end, item_word): every left-maximal match, with the document's characters it covers."""
    out = None
    for sought in _slices(items, item_col, item_text_col, min_words, least_item_words):

        def run(batches: Iterator[pa.RecordBatch], sought: Items = sought) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0)
                for lo, _, raw, offs in K.each_group(b.column(1), SHARD):
                    found = search(raw, offs, sought)
                    if found:
                        doc, first, last = (np.array([f[k] for f in found]) for k in (0, 3, 4))
                        at = K.chars(raw, np.concatenate([offs[doc], offs[doc] + first, offs[doc] + last])).reshape(3, -1)
                        rows = [(ids[lo + o].as_py(), sought.ids[i], n, x, y, w) for (o, i, n, _, _, w), x, y in zip(found, (at[1] - at[0]).tolist(), (at[2] - at[0]).tolist())]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.int32()] * 4))], names=["doc_id", "item_id", "words", "start", "end", "item_word"])

        part = texts(docs, id_col, text_col).mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], MATCHES)


def decontaminate(docs: DataFrame, items: DataFrame, min_words: int = MIN_WORDS, least_item_words: int = LEAST_ITEM_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the affected rows, in one pass and without a shuffle; all columns as they are."""
    at = docs.columns.index(text_col)
    for sought in _slices(items, item_col, item_text_col, min_words, least_item_words):

        def run(batches: Iterator[pa.RecordBatch], sought: Items = sought) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for lo, _, raw, offs in K.each_group(b.column(at), SHARD):
                    for o in {x[0] for x in search(raw, offs, sought)}:
                        keep[lo + o] = False
                yield b if keep.all() else b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
