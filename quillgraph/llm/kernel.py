"""Vectorised text primitives over the raw UTF-8 buffers of Arrow batches.

A batch of documents is one byte array plus document offsets. Everything here
works on whole arrays, so the cost is a few nanoseconds a byte and no Python
object is made for a word. Batches are cut into groups of whole documents of
about ``GROUP`` bytes, which bounds the memory of temporaries and keeps them in
cache; a longer document forms a group of its own, of which only arrays by word and
single bytes by byte are held at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

GROUP = 1 << 20

_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LOWERCASE = (_B >= 97) & (_B <= 122)
DIGIT = (_B >= 48) & (_B <= 57)
SPACE = (_B == 32) | ((_B >= 9) & (_B <= 13))
HIGH = _B >= 128
MARK = np.isin(_B, np.frombuffer(b"!#$%&*|~^@+=<>", np.uint8))
WORD = UPPER | LOWERCASE | DIGIT | HIGH
FOLD = np.where(UPPER, _B + 32, _B).astype(np.uint8)
SAME = _B.astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int) -> np.ndarray:
    """base ** 0..GROUP modulo 2**64, kept."""
    if base not in _powers:
        steps = np.full(GROUP + 1, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 entries) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def groups(offs: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about ``limit`` bytes, at most 60,000 documents each."""
    n, lo = len(offs) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), lo + 60_000, n)
        yield lo, hi
        lo = hi


def each_group(column: pa.Array, limit: int = GROUP) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets from 0) for each group of documents of a column."""
    raw, offs = buffers(column)
    for lo, hi in groups(offs, limit):
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def spans(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, token offsets by document) of the maximal runs of bytes in ``inside``; no run crosses documents."""
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = inside[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] |= w[cuts]
    last[cuts - 1] |= w[cuts - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def _prefix(part: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial of at most ``GROUP`` bytes."""
    p = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((table.astype(np.uint64) + np.uint64(1))[part] * _power(_BASE)[: len(part)], out=p[1:])
    return p


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLD) -> np.ndarray:
    """64-bit hash of every span, from prefix sums of a polynomial in an odd base modulo 2**64; ``table`` maps bytes first (case folding).

    Spans are in order and don't overlap. Prefix sums reach over at most ``GROUP`` bytes at a time, whatever the
    length of a text; a span that is longer still is added up piece by piece.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + GROUP, "right"))
        if j > i:
            p = _prefix(raw[at : int(ends[j - 1])], table)
            x = starts[i:j] - at
            out[i:j] = (p[ends[i:j] - at] - p[x]) * _power(_INVERSE)[x]
            i = j
            continue
        total, up = 0, 1
        for k in range(at, int(ends[i]), GROUP):
            total += up * int(_prefix(raw[k : min(k + GROUP, int(ends[i]))], table)[-1])
            up = up * pow(_BASE, GROUP, 1 << 64) % (1 << 64)
        out[i] = total % (1 << 64)
        i += 1
    return mix(out)


def bigrams(h: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of adjacent pairs within documents, offsets by document)."""
    n = np.diff(toks)
    offs = np.concatenate([[0], np.cumsum(np.maximum(n - 1, 0))])
    if len(h) < 2:
        return np.zeros(0, np.uint64), offs
    two = mix(h[:-1] * np.uint64(0x9FB21C651E98DF25) + h[1:] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(7))
    keep = np.ones(len(two), bool)
    ends = toks[1:-1]
    ends = ends[(ends > 0) & (ends < len(h))]
    keep[ends - 1] = False
    return two[keep], offs


def doubled(h: np.ndarray, toks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, offsets by document): each hash of a document once for every power of two up to its number of occurrences, so that counts matter, but slowly. Documents of a group number under 65,536."""
    doc = np.repeat(np.arange(len(toks) - 1, dtype=np.uint64), np.diff(toks))
    key = np.sort((doc << np.uint64(48)) | (h >> np.uint64(16)))
    if not len(key):
        return key, np.zeros(len(toks), np.int64)
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.frexp(np.diff(np.concatenate([at, [len(key)]])).astype(np.float64))[1]
    offs = np.searchsorted(key[at], np.arange(len(toks), dtype=np.uint64) << np.uint64(48))
    ends = np.concatenate([[0], np.cumsum(times)])
    level = np.arange(ends[-1]) - np.repeat(ends[:-1], times)
    return mix((np.repeat(key[at], times) << np.uint64(16)) + level.astype(np.uint64)), ends[offs]


_NIBBLE = np.array([sum(((v >> j) & 1) << (16 * j) for j in range(4)) for v in range(16)], dtype=np.uint64)


def bit_counts(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many hashes of each document have each of the 64 bits set. Four 16-bit counters share a machine word; runs are cut at 60,000."""
    n = len(offs) - 1
    out = np.zeros((n, 64), np.int64)
    some = np.flatnonzero(np.diff(offs) > 0)
    if len(some) == 0:
        return out
    cut, owner = [], []
    sizes = np.diff(offs)[some]
    if sizes.max() <= 60_000:
        cut, owner = offs[some], some
    else:
        for d, size in zip(some, sizes):
            for x in range(0, int(size), 60_000):
                cut.append(offs[d] + x)
                owner.append(d)
        cut, owner = np.array(cut), np.array(owner)
    lane = np.arange(4, dtype=np.uint64) * np.uint64(16)
    for k in range(16):
        sums = np.add.reduceat(_NIBBLE[((h >> np.uint64(4 * k)) & np.uint64(15)).astype(np.intp)], cut)
        four = ((sums[:, None] >> lane) & np.uint64(0xFFFF)).astype(np.int64)
        if len(owner) == len(some):
            out[owner, 4 * k : 4 * k + 4] = four
        else:
            np.add.at(out, (owner[:, None], np.arange(4 * k, 4 * k + 4)), four)
    return out


def majority(h: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """SimHash of each document: bit b is set if more than half of its hashes have it."""
    votes = bit_counts(h, offs) * 2 > np.diff(offs)[:, None]
    return (votes.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each range of ``offs``."""
    if len(offs) == 2:
        return values[offs[0] : offs[1]].sum(dtype=np.float64 if values.dtype.kind == "f" else np.int64, keepdims=True)
    c = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return c[offs[1:]] - c[offs[:-1]]


def chars(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many characters begin before each of the byte positions ``at``, in one pass however many there are."""
    each, where = np.unique(at, return_inverse=True)
    edges = np.concatenate([[0], each])
    n = np.zeros(len(edges), np.int64)
    for k in range(0, len(raw), GROUP):  # the count of a piece goes to the first edge behind it
        here = np.flatnonzero((raw[k : k + GROUP] & 0xC0) != 0x80) + k
        n += np.bincount(np.searchsorted(edges, here, "right"), minlength=len(edges) + 1)[: len(edges)]
    return np.cumsum(n)[1:][where]
