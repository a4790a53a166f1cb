"""Near-duplicate groups by SimHash, searched with the pigeonring principle.

A document has three 64-bit SimHashes: one of its case-folded words,
which is searched, and two of its adjacent word pairs, which confirm. A word is
a run of letters, digits and marks such as # or |; sentence punctuation is left
out. A word counts once for each power of two up to its number of occurrences.
Two documents are near duplicates if the word hashes differ in at most
``tau`` bits and the two pair hashes together in at most ``confirm`` bits.

Search. The word hash is cut into a ring of m = tau + 1 segments. If two hashes
differ in at most tau bits, some segment starts a chain of which every prefix of
l segments differs in at most floor(l * tau / m) bits (the pigeonring
principle). So the first segment must be equal. Documents meet by (start, first
segment); a meeting of more than ``MEET`` fingerprints is divided by the second
segment, which may differ in one bit, so each goes to its own second segment and, as
a guest, to those with one bit less; and where that is still too many, every pair of
blocks of it is a meeting. In a meeting the fingerprints are sorted by the next
segments, as many as their number makes worth while, and looked up under every
difference that the prefixes allow; longer prefixes prune what is found, and the
pairs that are left get the full check. The search is exact. A task holds ``MEET``
fingerprints at most, about 150 MB. Each distinct fingerprint is searched once, however often it
occurs. A meeting hands on a spanning forest, not pairs, and leaves out blocks that
are one component already, so groups of thousands of copies, equal or edited, stay cheap.

Defined results. Documents without a word (null, empty, punctuation only) and
rows without an id belong to no group. Rows that share a doc_id are one
document, repeated rows too. In a group the smallest doc_id stays, so there are no ties. Texts
are read whole, however long. An empty table has no groups. Columns other than the two named
are not looked at, and all are kept by ``drop_near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import BROADCAST_BYTES, cut, forget, texts

TAU, CONFIRM = 10, 38
#: Most fingerprints of a meeting, which one task holds.
MEET = 1 << 20
_SECOND = np.uint64(0x5851F42D4C957F2D)


def segments(tau: int) -> list[tuple[int, int]]:
    """(first bit, width) of the tau + 1 segments of 64 bits."""
    m = tau + 1
    edge = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:])]


def fingerprint_arrays(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word hash, pair hash, second pair hash) by document. A document of one word has its word for a pair."""
    s, e, toks = K.spans(raw, offs, K.WORD | K.MARK)
    h = K.hashes(raw, s, e)
    a = K.majority(*K.doubled(h, toks))
    two, pairs = K.bigrams(h, toks)
    lone = np.flatnonzero(np.diff(toks) == 1)
    if len(lone):
        two = np.insert(two, pairs[lone], h[toks[lone]])
        pairs = np.concatenate([[0], np.cumsum(np.maximum(np.diff(toks) - 1, 0) + (np.diff(toks) == 1))])
    two, at = K.doubled(two, pairs)
    return np.diff(toks), a, K.majority(two, at), K.majority(K.mix(two * _SECOND + np.uint64(1)), at)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, h1, h2, h3) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                n, *h = fingerprint_arrays(raw, offs)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in h)], names=["doc_id", "words", "h1", "h2", "h3"])

    return texts(df, id_col, text_col).mapInArrow(run, "doc_id long, words int, h1 long, h2 long, h3 long")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component under the edges a-b."""
    lab = np.arange(n)
    while len(a):
        x, y = lab[a], lab[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        if not len(a):
            break
        np.minimum.at(lab, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = lab[lab]
            if np.array_equal(up, lab):
                break
            lab = up
    return lab


@lru_cache(64)
def differences(start: int, depth: int, tau: int) -> np.ndarray:
    """What the segments 2 to ``depth`` of a chain from ``start`` may differ in, the second highest; fewest bits first."""
    seg = segments(tau)
    m = len(seg)
    found = [(0, 0)]
    for j in range(1, depth):
        w, budget = seg[(start + j) % m][1], (j + 1) * tau // m
        found = [((v << w) | x, n + x.bit_count()) for v, n in found for x in range(1 << w) if n + x.bit_count() <= budget]
    return np.array([v for v, _ in sorted(found, key=lambda f: (f[1], f[0]))], np.int64)


def _ring(start: int, h1: np.ndarray, tau: int) -> tuple[np.ndarray, list[int]]:
    """(hashes turned so that segment ``start`` is lowest, widths from there)."""
    seg = segments(tau)
    first = seg[start][0]
    turn = h1 if first == 0 else (h1 >> np.uint64(first)) | (h1 << np.uint64(64 - first))
    return turn, [seg[(start + j) % len(seg)][1] for j in range(len(seg))]


def _next(turn: np.ndarray, width: list[int], depth: int) -> np.ndarray:
    """Segments 2 to ``depth`` as one number, the second highest."""
    value, at = np.zeros(len(turn), np.int64), width[0]
    for w in width[1:depth]:
        value = (value << w) | ((turn >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64)
        at += w
    return value


def _ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first .. first + size - 1 of each, one after the other."""
    ends = np.cumsum(size)
    out = np.repeat((first - (ends - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


class _Sorted:
    """The fingerprints of a meeting, sorted by their next segments and divided in blocks: rows of one value, and of one large component or of none, ``tile`` at most."""

    def __init__(self, start: int, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, tau: int, confirm: int, home: np.ndarray | None, tile: int) -> None:
        self.turn, width = _ring(start, h1, tau)
        self.n, m, self.tile, self.confirm = len(h1), len(width), tile, confirm
        self.budget = [(j + 1) * tau // m for j in range(m)]
        self.masks = [np.uint64((1 << int(w)) - 1 if w < 64 else (1 << 64) - 1) for w in np.cumsum(width)]
        # the depth that costs least: nanoseconds for looking up blocks, for pairs of rows and for each difference
        least = None
        for depth in range(2, min(5, m) + 1):
            value = _next(self.turn, width, depth)
            sizes = np.unique(value, return_counts=True)[1].astype(np.float64)
            cost = len(differences(start, depth, tau)) * (60 * len(sizes) + 6 * float((sizes * sizes).sum()) + 60_000)
            if least is not None and cost >= least:
                break
            least, self.depth, self.value = cost, depth, value
        self.h2, self.h3, self.home = h2, h3, None if home is None or home.all() else home
        self.place, self.lab, self.held = np.arange(self.n), np.arange(self.n), 0
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.large = 0
        self.arrange()

    def arrange(self) -> None:
        """Sorts anew; to be called with no edges held."""
        n = self.n
        component = np.bincount(self.lab, minlength=n)[self.lab]
        big = np.where(component >= 64, self.lab, -1)
        by = np.lexsort((big, self.value))
        to = np.empty(n, np.int64)
        to[by] = np.arange(n)
        self.turn, self.h2, self.h3, self.value, self.place, big = (x[by] for x in (self.turn, self.h2, self.h3, self.value, self.place, big))
        self.lab = to[self.lab[by]]
        if self.home is not None:
            self.home = self.home[by]
        self.large = int((big >= 0).sum())
        low = self.turn & self.masks[self.depth] if self.depth < len(self.masks) else self.turn
        self.low = low.astype(np.uint32) if int(low.max()) >> 32 == 0 else low
        new = np.concatenate([[True], self.value[1:] != self.value[:-1]])
        head = np.flatnonzero(new)
        part = np.flatnonzero(new | np.concatenate([[True], big[1:] != big[:-1]]))
        within = np.arange(n) - np.repeat(part, np.diff(np.append(part, n)))
        self.first = np.flatnonzero(within % self.tile == 0)
        self.size = np.diff(np.append(self.first, n))
        self.known = self.value[head]
        self.block = np.append(np.searchsorted(self.first, head), len(self.first))  # of each value, its first block
        self.mark()

    def mark(self) -> None:
        """Which component all rows of a block are in; -1 if not in one."""
        low = np.minimum.reduceat(self.lab, self.first)
        self.same = np.where(np.maximum.reduceat(self.lab, self.first) == low, low, -1)

    def flush(self) -> None:
        if self.held:
            self.lab = roots(self.n, np.concatenate([np.arange(self.n), *self.a]), np.concatenate([self.lab, *self.b]))
            self.a, self.b, self.held = [], [], 0
            self.mark()

    def compare(self, x: np.ndarray, y: np.ndarray) -> None:
        """All rows of blocks x against those of blocks y, but blocks that are one component already."""
        ends = np.cumsum(self.size[x] * self.size[y])
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 19), "right")))
            p, q = x[lo:hi], y[lo:hi]
            lo = hi
            open_ = (self.same[p] < 0) | (self.same[p] != self.same[q])
            p, q = p[open_], q[open_]
            if not len(p):
                continue
            rows = _ranges(self.first[p], self.size[p])
            many = np.repeat(self.size[q], self.size[p])
            b = _ranges(np.repeat(self.first[q], self.size[p]), many)
            d = np.repeat(self.low[rows], many)
            d ^= self.low[b]
            k = np.flatnonzero(np.bitwise_count(d) <= self.budget[self.depth])
            self.check(rows[np.searchsorted(np.cumsum(many), k, "right")], b[k])

    def check(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keeps the pairs of rows that are near, an edge each."""
        keep = (a < b) & (self.lab[a] != self.lab[b])  # one component already: nothing to learn
        if self.home is not None:
            keep &= self.home[a]
        a, b = a[keep], b[keep]
        d = self.turn[a] ^ self.turn[b]
        for l in range(self.depth, len(self.masks)):
            keep = np.bitwise_count(d & self.masks[l]) <= self.budget[l]
            a, b, d = a[keep], b[keep], d[keep]
        # the last prefix is the whole ring: at most tau bits; then the pair hashes
        keep = np.bitwise_count(self.h2[a] ^ self.h2[b]).astype(np.int32) + np.bitwise_count(self.h3[a] ^ self.h3[b]) <= self.confirm
        if keep.any():
            self.a.append(a[keep])
            self.b.append(b[keep])
            self.held += len(self.a[-1])
            if self.held > max(4096, self.n // 8):
                self.flush()

    def settle(self) -> None:
        """Sorts anew once an eighth more of the rows are in large components."""
        if self.held > 64:
            self.flush()
            component = np.bincount(self.lab, minlength=self.n)[self.lab]
            if int((component >= 64).sum()) > self.large + self.n // 8:
                self.arrange()


def meeting(start: int, h1: np.ndarray, h2: np.ndarray, h3: np.ndarray, tau: int, confirm: int, home: np.ndarray | None = None, tile: int = 512) -> np.ndarray:
    """Component root by row, for fingerprints with an equal segment ``start``; two guests (rows not at home) are not compared."""
    t = _Sorted(start, h1, h2, h3, tau, confirm, home, tile)
    # the first row of each block against all others of it: a group of edited copies is one component after that, or nearly
    t.check(np.repeat(t.first, t.size), np.arange(t.n))
    t.settle()
    every = np.arange(len(t.first))
    t.compare(every, every)
    t.flush()
    t.arrange()
    for v in np.flatnonzero(np.diff(t.block) > 1).tolist():  # the first block against all others of its value, then the second ...
        for k in range(t.block[v], t.block[v + 1] - 1):
            others = np.arange(k + 1, t.block[v + 1])
            t.compare(np.full(len(others), k), others)
            t.flush()
    t.arrange()
    for diff in differences(start, t.depth, tau)[1:]:
        other = t.known ^ diff
        at = np.searchsorted(t.known, other)
        u = np.flatnonzero((other > t.known) & (t.known[np.minimum(at, len(t.known) - 1)] == other))
        if not len(u):
            continue
        v = at[u]
        nu, nv = t.block[u + 1] - t.block[u], t.block[v + 1] - t.block[v]
        x = _ranges(t.block[u], nu)
        many = np.repeat(nv, nu)
        t.compare(np.repeat(x, many), _ranges(np.repeat(t.block[v], nu), many))
        t.settle()
    t.flush()
    out = np.empty(t.n, np.int64)
    out[t.place] = t.place[t.lab]
    return out


class Meetings(NamedTuple):
    """Where fingerprints meet: by start and first segment, and for those that are divided, by the second too."""

    divided: np.ndarray  # start, first: whether
    blocks: np.ndarray  # start, first, second: blocks of a divided meeting, 1 if it stays whole
    base: np.ndarray  # start, first, second: its first number


def meetings(prints: DataFrame, tau: int, meet: int) -> Meetings:
    """Planned from counts by start, first and second segment: at most (tau + 1) * 4 ** (64 / (tau + 1)) numbers, whatever the corpus."""
    seg = segments(tau)
    m, wide = len(seg), max(w for _, w in seg)
    two = [F.shiftrightunsigned("h1", seg[j][0]).bitwiseAND(F.lit((1 << seg[j][1]) - 1)).cast("int") for j in range(m)]
    codes = F.array(*(two[j] * (1 << wide) + two[(j + 1) % m] for j in range(m)))
    n = np.zeros((m, 1 << wide, 1 << wide), np.int64)
    for r in prints.select(F.posexplode(codes).alias("start", "code")).groupBy("start", "code").count().collect():
        n[r["start"], r["code"] >> wide, r["code"] & ((1 << wide) - 1)] = r["count"]
    divided = n.sum(axis=2) > meet
    all_ = n.copy()
    v = np.arange(1 << wide)
    for k in range(wide):
        guests = v[v >> k & 1 == 1]
        all_[:, :, guests ^ (1 << k)] += n[:, :, guests]
    blocks = np.where(all_ > meet, -(-2 * all_ // meet), 1)
    room = (blocks * blocks).ravel()
    base = (np.cumsum(room) - room).reshape(blocks.shape) + m * (1 << wide)
    return Meetings(divided, blocks, base)


def invite(node: np.ndarray, h1: np.ndarray, plan: Meetings, tau: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(start, rows, the meeting each goes to, whether it is at home there) for every start."""
    m, wide = plan.divided.shape[:2]
    for start in range(m):
        turn, width = _ring(start, h1, tau)
        one = (turn & np.uint64((1 << width[0]) - 1)).astype(np.int64)
        heavy = plan.divided[start, one]
        rows = np.flatnonzero(~heavy)
        yield start, rows, start * wide + one[rows], np.ones(len(rows), bool)
        rows = np.flatnonzero(heavy)
        if not len(rows):
            continue
        two = _next(turn[rows], width, 2)
        parts = [(rows, two, np.ones(len(rows), bool))]
        for k in range(width[1]):
            g = np.flatnonzero(two >> k & 1)
            parts.append((rows[g], two[g] ^ (1 << k), np.zeros(len(g), bool)))
        rows, two, home = (np.concatenate(x) for x in zip(*parts))
        blocks, base = plan.blocks[start, one[rows], two], plan.base[start, one[rows], two]
        whole = blocks == 1
        yield start, rows[whole], base[whole], home[whole]
        own = (K.mix(node[rows].astype(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        for y in range(int(blocks.max())):
            k = np.flatnonzero(~whole & (y < blocks) & (own != y))
            yield start, rows[k], base[k] + np.minimum(own[k], y) * blocks[k] + np.maximum(own[k], y), home[k]


def edges(prints: DataFrame, tau: int, confirm: int, meet: int = MEET) -> DataFrame:
    """(a, b): a spanning forest of the near pairs of each meeting; prints: (node, h1, h2, h3), each fingerprint once."""
    plan = meetings(prints, tau, meet)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1 = b.column(1).to_numpy().view(np.uint64)
            for start, rows, where, home in invite(b.column(0).to_numpy(), h1, plan, tau):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.full(len(rows), start, np.int8)), pa.array(home), *(b.column(k).take(pa.array(rows)) for k in range(4))], names=["meeting", "start", "home", "node", "h1", "h2", "h3"])

    def solve(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        node = t.column("node").to_numpy()
        h = [t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2", "h3")]
        root = meeting(t.column("start")[0].as_py(), *h, tau, confirm, t.column("home").to_numpy())
        other = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column(0).to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            for lo, hi in zip(cuts, cuts[1:]):
                if held and key[lo] != now:
                    yield solve(held)
                    held = []
                now = key[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield solve(held)

    asked = prints.select("node", "h1", "h2", "h3").mapInArrow(ask, "meeting long, start byte, home boolean, node long, h1 long, h2 long, h3 long")
    return asked.repartition("meeting").sortWithinPartitions("meeting").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and small-star until nothing changes.

    Every round is written to the shared folder, so a lost executor costs one round.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        new = cut(small)
        sign = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        forget(e)
        e = new
        if sign == last or sign["n"] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = sign


def near_groups(df: DataFrame, tau: int = TAU, confirm: int = CONFIRM, id_col: str = "doc_id", text_col: str = "text", meet: int = MEET) -> DataFrame:
    """(doc_id, kept_doc_id) for every document of a group of two or more, the kept one included."""
    prints = cut(fingerprints(df, id_col, text_col).where("words > 0 and doc_id is not null").drop("words"))
    same = cut(prints.groupBy("h1", "h2", "h3").agg(F.min("doc_id").alias("node")))
    owned = cut(prints.join(same, ["h1", "h2", "h3"]).select("doc_id", "node").distinct())
    forget(prints)
    # a doc_id whose rows have different texts links their fingerprints
    several = owned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("doc_id", "a")
    links = edges(same.select("node", "h1", "h2", "h3"), tau, confirm, meet).unionByName(owned.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b")))
    comp = components(links)
    forget(same)
    docs = owned.join(comp, "node", "left").select("doc_id", F.coalesce("root", "node").alias("kept_doc_id")).distinct()
    moved = cut(docs.where("doc_id <> kept_doc_id"))
    forget(owned, comp)
    return moved.unionByName(moved.select(F.col("kept_doc_id").alias("doc_id"), "kept_doc_id").distinct())


def drop_near_duplicates(df: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` without the documents whose group keeps another one; all columns as they are.

    The identifiers that go are broadcast if their counted size allows; else they are joined.
    """
    id_col = how.get("id_col", "doc_id")
    gone = near_groups(df, **how).where("doc_id <> kept_doc_id").select(F.col("doc_id").alias("__gone"))
    small = gone.count() * 16 <= BROADCAST_BYTES
    return df.join(F.broadcast(gone) if small else gone, df[id_col].cast("long") == F.col("__gone"), "left_anti")
