"""Quality rules: likelihood ratio of hashed n-grams between a trusted target and the raw corpus.

The n-grams of a text are its tokens and its pairs of adjacent tokens; a token is a run
of letters and digits, or a run of marks such as # and |, with case kept. Each is known
by 44 bits of its hash, so what is counted grows with the corpus and rare n-grams don't
share counts. Two multinomials are estimated: of the raw corpus, over every document,
and of the trusted target, over every document labelled good and not toxic. Both get the
same prior in proportion, ``PRIOR`` counts in the target, so an n-gram seen rarely says
little. A document's score is the mean over its n-grams of log(target / raw), so long
and short texts compare; it is kept exactly if the score is at least ``LEAST``.

Documents go in chunks of about ``CHUNK`` bytes. A chunk sends each of the blocks that the
hashes are divided into its n-grams there, with the documents they are in; a block adds up
the counts of all chunks and sends back a sum for each document. The number of blocks grows
with the corpus, the memory of a task doesn't, and three numbers reach the driver. ``fit`` and
``judge`` do the same over a given number of buckets in memory.

Defined results. A null or empty text, or one without a token, has no score and is not
kept. Without trusted documents every score is 0 and everything with a token is kept.
Repeated rows count and are judged each, rows without an id too. A score of exactly ``LEAST`` is kept. Texts of any length
are read whole. Of an empty table there is no result. Labels other than 0 and 1, null ids and labels
of unknown documents are left out; a document labelled both ways is not trusted. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import BROADCAST_BYTES, texts

PRIOR, LEAST = 2.0, -0.5
#: Bytes of text of a chunk of documents, and for each block of hashes.
CHUNK, SHARE = 16 << 20, 20 << 20
_BLOCK = 4096


class Model(NamedTuple):
    ratio: np.ndarray
    trusted: int
    raw: int


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of tokens, their offsets by document, hashes of pairs, their offsets)."""
    parts = []
    for inside in (K.WORD, K.MARK):
        s, e, _ = K.spans(raw, offs, inside)
        parts.append((s, e))
    s, e = (np.concatenate(x) for x in zip(*parts))
    by = np.argsort(s, kind="stable")
    s, e = s[by], e[by]
    toks = np.searchsorted(s, offs)
    h = K.hashes(raw, s, e, K.SAME)
    two, pairs = K.bigrams(h, toks)
    return h, toks, two, pairs


def ngrams(raw: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of tokens, their offsets by document, buckets of pairs, their offsets)."""
    h, toks, two, pairs = grams(raw, offs)
    top = np.uint64(64 - (buckets.bit_length() - 1))
    return (h >> top).astype(np.int64), toks, (two >> top).astype(np.int64), pairs


def _counts(docs: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(raw, trusted) counts over (text, trusted)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for b in batches:
            flags = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in K.each_group(b.column(0)):
                u, ut, p, pt = ngrams(raw, offs, buckets)
                both = np.bincount(np.concatenate([u, p]), minlength=buckets)
                total[0] += both
                f = flags[lo:hi]
                if f.any():
                    own = np.concatenate([u[np.repeat(f, np.diff(ut))], p[np.repeat(f, np.diff(pt))]])
                    total[1] += np.bincount(own, minlength=buckets)
        size = min(_BLOCK, buckets)
        blocks = [(k, total[:, k * size : (k + 1) * size]) for k in range(buckets // size)]
        blocks = [(k, t) for k, t in blocks if t.any()]
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in blocks], pa.int32()), pa.array([t.tobytes() for _, t in blocks], pa.binary())], names=["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(t.as_buffer(), np.int64)
                held[k] = held[k] + x if k in held else x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([t.tobytes() for t in held.values()], pa.binary())], names=["block", "counts"])

    summed = docs.mapInArrow(count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, counts binary").collect()
    total = np.zeros((2, buckets), np.int64)
    size = min(_BLOCK, buckets)
    for r in summed:
        total[:, r["block"] * size : (r["block"] + 1) * size] += np.frombuffer(r["counts"], np.int64).reshape(2, size)
    return total[0], total[1]


def ratios(raw: np.ndarray, trusted: np.ndarray, prior: float = PRIOR, share: float | None = None) -> np.ndarray:
    """log of target over raw probability by n-gram; the prior weighs alike in either, in proportion to its size. share: trusted n-grams for each raw one, where the counts aren't all there are."""
    if share is None:
        share = trusted.sum() / max(1, raw.sum())
    if not share:
        return np.zeros(len(raw))
    return np.log((trusted + prior) / (raw * share + prior))


def _marked(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, quality_col: str, toxic_col: str) -> DataFrame:
    """(doc_id, text, trusted) of every row; trusted is true or null."""
    given = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{quality_col}`").cast("int").alias("q"), F.col(f"`{toxic_col}`").cast("int").alias("x")).where("doc_id is not null and q in (0, 1)")
    good = given.groupBy("doc_id").agg(F.min("q").alias("q"), F.max("x").alias("x")).where("q = 1 and coalesce(x, 0) = 0").select("doc_id", F.lit(True).alias("trusted"))
    if good.count() * 16 <= BROADCAST_BYTES:
        good = F.broadcast(good)
    return texts(docs, id_col, text_col).join(good, "doc_id", "left").select("doc_id", "text", "trusted")


def fit(docs: DataFrame, labels: DataFrame, buckets: int, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", prior: float = PRIOR) -> Model:
    raw, own = _counts(_marked(docs, labels, id_col, text_col, quality_col, toxic_col).select("text", "trusted"), buckets)
    return Model(ratios(raw, own, prior).astype(np.float32), int(own.sum()), int(raw.sum()))


def scores(raw: np.ndarray, offs: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean log ratio, n-grams) by document."""
    u, ut, p, pt = ngrams(raw, offs, len(ratio))
    n = np.diff(ut) + np.diff(pt)
    r = ratio.astype(np.float64)
    return (K.sums(r[u], ut) + K.sums(r[p], pt)) / np.maximum(n, 1), n


def judge(docs: DataFrame, model: Model, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ngrams, score, keep) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                s, n = scores(raw, offs, model.ratio)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(np.round(s, 6), mask=n == 0), pa.array((n > 0) & (s >= least))], names=["doc_id", "ngrams", "score", "keep"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ngrams long, score double, keep boolean")


def _pack(*arrays: np.ndarray) -> list[bytes]:
    """Every byte of the numbers apart, compressed: the high ones are mostly alike."""
    c = zs.ZstdCompressor(level=1)
    return [c.compress(np.ascontiguousarray(x.view(np.uint8)[k :: x.itemsize])) for x in arrays for k in range(x.itemsize)]


def _unpack(planes: list[bytes], *types: type) -> list[np.ndarray]:
    d, out, at = zs.ZstdDecompressor(), [], 0
    for t in types:
        size = np.dtype(t).itemsize
        out.append(np.stack([np.frombuffer(d.decompress(x), np.uint8) for x in planes[at : at + size]], 1).reshape(-1).view(t))
        at += size
    return out


_ROWS = "part int, chunk int, block int, first int, planes array<binary>"
_SCHEMA = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("block", pa.int32()), ("first", pa.int32()), ("planes", pa.list_(pa.binary()))])
#: In ``first``: the row holds the identifiers of a chunk. In other rows it is the number of trusted documents, which come first.
_IDS = -1


def _send(raw: np.ndarray, offs: np.ndarray, trusted: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, list[bytes]]]]:
    """(order of the documents, n-grams of each, (block, planes) of each block): gaps between hashes, documents of each hash, gaps between those, times in each."""
    parts = []
    n = np.zeros(len(offs) - 1, np.int64)
    for lo, hi in K.groups(offs):
        h, ht, two, tt = grams(raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        n[lo:hi] = np.diff(ht) + np.diff(tt)
        parts.append((h, np.repeat(np.arange(lo, hi, dtype=np.uint16), np.diff(ht))))
        parts.append((two, np.repeat(np.arange(lo, hi, dtype=np.uint16), np.diff(tt))))
    order = np.argsort(~trusted, kind="stable")
    place = np.empty(len(order), np.uint64)
    place[order] = np.arange(len(order), dtype=np.uint64)
    key = np.concatenate([(h & np.uint64(0xFFFF_FFFF_FFF0_0000)) | place[d] for h, d in parts])
    del parts
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    times = np.diff(np.append(at, len(key))).astype(np.uint32)
    key = key[at]
    doc, key = (key & np.uint64(0xFFFF)).astype(np.uint16), key >> np.uint64(16)
    out = []
    cuts = np.searchsorted(key, edges)
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        x, d, c = key[cuts[k] : cuts[k + 1]], doc[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]]
        new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        gap = np.diff(d, prepend=np.uint16(0))
        gap[new] = d[new]
        out.append((k, _pack(np.diff(x[new] >> np.uint64(4), prepend=np.uint64(0)), np.diff(np.append(new, len(x))).astype(np.uint32), gap, c)))
    return order, n[order], out


def _receive(planes: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets of the documents of each, documents, times) of what ``_send`` made."""
    gaps, many, gap, times = _unpack(planes, np.uint64, np.uint32, np.uint16, np.uint32)
    ends = np.concatenate([[0], np.cumsum(many, dtype=np.int64)])
    run = np.cumsum(gap, dtype=np.int64)
    return np.cumsum(gaps), ends, run - np.repeat(run[ends[:-1]] - gap[ends[:-1]], many), times.astype(np.int64)


def rules(docs: DataFrame, labels: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality", toxic_col: str = "toxic", prior: float = PRIOR, chunk: int = CHUNK, share: int = SHARE) -> DataFrame:
    """(doc_id, ngrams, score, keep) of every row."""
    marked = _marked(docs, labels, id_col, text_col, quality_col, toxic_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n = t = 0
        for b in batches:
            flags = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in K.each_group(b.column(0)):
                _, ht, _, tt = grams(raw, offs)
                own = np.diff(ht) + np.diff(tt)
                size, n, t = size + len(raw), n + int(own.sum()), t + int(own[flags[lo:hi]].sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (size, n, t)], names=["size", "n", "t"])

    size, n, t = (x or 0 for x in marked.select("text", "trusted").mapInArrow(measure, "size long, n long, t long").agg(F.sum("size"), F.sum("n"), F.sum("t")).first())
    blocks, part_of = min(1 << 15, max(1, -(-size // share))), t / max(1, n)
    edges = np.array([-(-(k << 48) // blocks) for k in range(blocks + 1)], np.uint64)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for b in batches:
            flags = b.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            for lo, hi, raw, offs in K.each_group(b.column(1), chunk):
                order, own, sent = _send(raw, offs, flags[lo:hi], edges)
                ids = b.column(0).slice(lo, hi - lo).take(pa.array(order))
                first = int(flags[lo:hi].sum())
                rows = [((part + made) % blocks, _IDS, _pack(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), own.astype(np.int64)))]
                rows += [(k, first, planes) for k, planes in sent]
                yield pa.RecordBatch.from_pylist([{"part": part, "chunk": made, "block": k, "first": f, "planes": p} for k, f, p in rows], _SCHEMA)
                made += 1

    def add(rows: pa.Table) -> pa.Table:
        out, got, hs, raws, owns = [], [], [], [], []
        for r in rows.to_pylist():
            if r["first"] == _IDS:
                out.append(r)
                continue
            h, ends, doc, times = _receive(r["planes"])
            hs.append(h)
            raws.append(K.sums(times, ends))
            owns.append(K.sums(np.where(doc < r["first"], times, 0), ends))
            got.append((r, np.diff(ends), doc.astype(np.uint16), times.astype(np.uint32)))
        if got:
            each, where = np.unique(np.concatenate(hs), return_inverse=True)
            value = ratios(np.bincount(where, np.concatenate(raws), len(each)), np.bincount(where, np.concatenate(owns), len(each)), prior, part_of)
            at = 0
            for r, many, doc, times in got:
                total = np.bincount(doc, np.repeat(value[where[at : at + len(many)]], many) * times)
                at += len(many)
                there = np.flatnonzero(np.bincount(doc))
                out.append(r | {"planes": _pack(np.diff(there, prepend=0).astype(np.uint16), total[there].astype(np.float32))})
        return pa.Table.from_pylist(out, _SCHEMA)

    def finish(rows: pa.Table) -> pa.Table:
        held = sorted(rows.to_pylist(), key=lambda r: (r["first"] != _IDS, r["block"]))
        ids, null, own = _unpack(held[0]["planes"], np.int64, np.uint8, np.int64)
        total = np.zeros(len(ids))
        for r in held[1:]:
            gap, x = _unpack(r["planes"], np.uint16, np.float32)
            total[np.cumsum(gap, dtype=np.int64)] += x
        s = total / np.maximum(own, 1)
        return pa.table([pa.array(ids, mask=null.astype(bool)), pa.array(own), pa.array(np.round(s, 6), mask=own == 0), pa.array((own > 0) & (s >= least))], names=["doc_id", "ngrams", "score", "keep"])

    summed = marked.mapInArrow(send, _ROWS).groupBy("block").applyInArrow(add, _ROWS)
    return summed.groupBy("part", "chunk").applyInArrow(finish, "doc_id long, ngrams long, score double, keep boolean")
