"""Exact vector search by cosine. A zero or missing vector is similar to nothing; values are kept in [-1, 1].

One query vector: an expression and a top-k. Many against many: blocks of either side
meet, each pair of blocks once and packed, and NumPy multiplies them as matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bytes of a block's vectors at most, as doubles; of a packed row, about. Rows that one block holds, and the blocks that more are cut into at least.
BLOCK_BYTES, PACKED_BYTES, SMALL, GRID = 1 << 26, 1 << 20, 2048, 12
#: Rows multiplied at once, of either side.
STRIP, TILE = 256, 1024


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    n = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((n > 0) & (F.size(a) == F.size(b)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(a, b) / n)))


def knn(rows: DataFrame, query: Sequence[float], limit: int = 20, threshold: float = 0.3, key: str = "uuid", vector: str = "vector") -> DataFrame:
    """The ``limit`` rows most similar to ``query``, then of those the ones of at least ``threshold``, with their score."""
    q = [float(x) for x in query]
    norm = float(np.sqrt(np.dot(q, q)))
    v = F.col(vector)
    n = F.sqrt(_dot(v, v))
    score = F.when((n > 0) & (F.size(v) == len(q)), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(v, F.array(*map(F.lit, q))) / (n * norm)))) if norm > 0 else F.lit(None).cast("double")
    top = rows.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), key).limit(limit)
    return top.where(F.col("score") >= threshold)


def enrich(hits: DataFrame, rows: DataFrame, key: str = "uuid") -> DataFrame:
    """The full rows of search hits with their score, in its order."""
    return rows.join(hits.select(key, "score"), key).orderBy(F.desc("score"), key)


def among(rows: DataFrame, some: DataFrame, query: Sequence[float], limit: int = 20, threshold: float = 0.0, key: str = "uuid") -> DataFrame:
    """Search restricted to the keys of ``some``, before any similarity is computed."""
    return knn(rows.join(some.select(key).distinct(), key, "left_semi"), query, limit, threshold, key)


def _block_count(rows: DataFrame, vector: str, block: int | None, least: int) -> int:
    """Blocks of at most ``block`` rows, or BLOCK_BYTES of doubles; of a table of more than SMALL rows ``least`` or more, so that every core has work while what is shuffled grows as the rows."""
    n, dim = rows.agg(F.count("*"), F.max(F.size(vector))).first()
    return max(least if n > SMALL else 1, -(-n // (block or max(1, BLOCK_BYTES // (8 * max(dim or 1, 1))))))


def _packed(rows: DataFrame, key: str, vector: str, blocks: int) -> DataFrame:
    """(block, dim, keys, data): rows of one block and length of vector, thousands in one. Rows without a key or a vector go."""
    wide = "float" if rows.schema[vector].dataType.elementType.simpleString() == "float" else "double"
    kind = rows.schema[key].dataType.simpleString()
    each = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast(f"array<{wide}>").alias("vector"), F.pmod(F.xxhash64(key, vector), F.lit(blocks)).cast("int").alias("block"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size: dict[tuple[int, int], int] = {}

        def row(at: tuple[int, int]) -> pa.RecordBatch:
            size.pop(at)
            keys, data = zip(*held.pop(at), strict=True)
            keys = pa.concat_arrays(keys)
            return pa.RecordBatch.from_pydict({"block": pa.array([at[0]], pa.int32()), "dim": pa.array([at[1]], pa.int32()), "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), "data": pa.array([b"".join(data)], pa.binary())})

        for t in batches:
            values = pc.fill_null(t.column("vector").flatten(), float("nan")).to_numpy(zero_copy_only=False)
            dim = pc.list_value_length(t.column("vector")).to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(dim) - dim
            code = t.column("block").to_numpy().astype(np.int64) * (dim.max(initial=0) + 1) + dim
            order = np.argsort(code, kind="stable")
            for idx in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if not len(idx) or not dim[idx[0]]:
                    continue
                at = (int(t.column("block")[int(idx[0])].as_py()), int(dim[idx[0]]))
                data = values[start[idx][:, None] + np.arange(at[1])].tobytes()
                held.setdefault(at, []).append((t.column("key").take(pa.array(idx)), data))
                size[at] = size.get(at, 0) + len(data)
                if size[at] >= PACKED_BYTES:
                    yield row(at)
            if sum(size.values()) > 32 * PACKED_BYTES:
                for at in list(held):
                    yield row(at)
        for at in list(held):
            yield row(at)

    return each.mapInArrow(pack, f"block int, dim int, keys array<{kind}>, data binary").withColumn("wide", F.lit(wide))


def _met(packed: DataFrame, parts: int, meet: Callable[[dict[int, list], dict[int, list]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``meet`` of the two sides of every part, of which each is a partition: rows of (part, side, dim, keys, data, wide), side 0, 1, or 2 for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: dict[int, tuple[dict, dict]] = {}
        for t in batches:
            for r in range(t.num_rows):
                part, side, dim = (t.column(c)[r].as_py() for c in ("part", "side", "dim"))
                x = (t.column("keys")[r].values, np.frombuffer(t.column("data")[r].as_buffer(), np.float32 if t.column("wide")[r].as_py() == "float" else np.float64).reshape(-1, dim))
                sides.setdefault(part, (one := {}, one if side == 2 else {}))[side % 2].setdefault(dim, []).append(x)
        for part in list(sides):
            yield from meet(*sides.pop(part))

    return packed.select("part", "side", "dim", "keys", "data", "wide").repartitionById(parts, F.col("part")).mapInArrow(run, schema)


def _triangle(rows: DataFrame, key: str, vector: str, block: int | None) -> tuple[DataFrame, int]:
    """Every pair of blocks once, and their number."""
    n = _block_count(rows, vector, block, GRID)
    each = _packed(rows, key, vector, n).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    lo, hi = F.least("block", "i"), F.greatest("block", "i")
    side = F.when(lo == hi, 2).when(F.col("block") == lo, 0).otherwise(1)
    return each.withColumn("part", (F.floor(hi * (hi + 1) / 2) + lo).cast("int")).withColumn("side", side), n * (n + 1) // 2


class _Side:
    """The rows of a block that have a direction: keys, values, norms, and unit vectors in single precision."""

    def __init__(self, held: list) -> None:
        keys, raw = pa.concat_arrays([k for k, _ in held]), np.concatenate([m for _, m in held])
        norm = np.concatenate([np.linalg.norm(raw[k : k + 8192].astype(np.float64), axis=1) for k in range(0, len(raw), 8192)])
        ok = (norm > 0) & np.isfinite(norm)
        if not ok.all():
            keys, raw, norm = keys.filter(pa.array(ok)), raw[ok], norm[ok]
        self.keys, self.raw, self.norm, self.dim = keys, raw, norm, raw.shape[1]
        self.unit = np.empty(raw.shape, np.float32)
        for k in range(0, len(raw), 8192):
            self.unit[k : k + 8192] = raw[k : k + 8192] / norm[k : k + 8192, None]

    def __len__(self) -> int:
        return len(self.norm)


def _margin(dim: int) -> float:
    """More than a product of unit vectors in single precision can be off."""
    return (dim + 8) * 2.0**-23


def _exact(a: _Side, i: np.ndarray, b: _Side, j: np.ndarray) -> np.ndarray:
    """Similarity of rows i of a and j of b in double precision, the same for the same vectors wherever they are."""
    out = np.empty(len(i))
    for k in range(0, len(i), 1 << 15):
        x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
        out[k : k + (1 << 15)] = ((a.raw[x] / a.norm[x, None]) * (b.raw[y] / b.norm[y, None])).sum(axis=1)
    return np.clip(out, -1, 1)


def _ranked(a: _Side, b: _Side) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct keys of both in order, and the place of each row's key in them."""
    d = pa.concat_arrays([a.keys, b.keys]).dictionary_encode()
    order = pc.sort_indices(d.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    code = place[d.indices.to_numpy()]
    return d.dictionary.take(pa.array(order)), code[: len(a)], code[len(a) :]


def _sides(left: dict[int, list], right: dict[int, list]) -> Iterator[tuple[_Side, _Side]]:
    """Sides of vectors of one length; those of different lengths are similar to nothing."""
    for dim in left.keys() & right.keys():
        a = _Side(left[dim])
        b = a if left is right else _Side(right[dim])
        if len(a) and len(b):
            yield a, b


def pairs(rows: DataFrame, threshold: float = 0.7, key: str = "uuid", vector: str = "vector", block: int | None = None) -> DataFrame:
    """(a, b, score) with a < b of all pairs of at least ``threshold`` (over 0). All pairs are compared: in single precision with a margin, what passes again in double. Each row goes to as many tasks as there are blocks."""
    kind = rows.schema[key].dataType.simpleString()
    each, parts = _triangle(rows, key, vector, block)

    def meet(left: dict[int, list], right: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for a, b in _sides(left, right):
            keys, ca, cb = _ranked(a, b)
            floor = np.float32(threshold - _margin(a.dim))
            for x in range(0, len(a), STRIP):
                u = a.unit[x : x + STRIP]
                for y in range(0, len(b), TILE):
                    if a is b and y + TILE <= x:
                        continue
                    v = b.unit[y : y + TILE]
                    i, j = np.divmod(np.flatnonzero(u @ v.T >= floor), len(v))
                    i, j = i + x, j + y
                    ok = (ca[i] != cb[j]) & (j > i if a is b else True)
                    i, j = i[ok], j[ok]
                    s = _exact(a, i, b, j)
                    ok = s >= threshold - 1e-12
                    if ok.any():
                        i, j = ca[i[ok]], cb[j[ok]]
                        yield pa.RecordBatch.from_pydict({"a": keys.take(pa.array(np.minimum(i, j))), "b": keys.take(pa.array(np.maximum(i, j))), "score": pa.array(s[ok])})

    return _met(each, parts, meet, f"a {kind}, b {kind}, score double")


def _hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after i and j of each pair became one component; the label of a component is its least node."""
    up = np.arange(len(label))
    p, q = label[i], label[j]
    while True:
        x, y = up[p], up[q]
        apart = x != y
        if not apart.any():
            return up[label]
        p, q, x, y = p[apart], q[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def links(rows: DataFrame, threshold: float = 0.7, key: str = "uuid", vector: str = "vector", block: int | None = None) -> DataFrame:
    """(a, b): edges that connect what the ``pairs`` of ``threshold`` connect, and nothing else. Each two blocks hand on one edge a row at most, to the least key of its component among them, and what is connected already isn't compared again."""
    kind = rows.schema[key].dataType.simpleString()
    each, parts = _triangle(rows, key, vector, block)

    def meet(left: dict[int, list], right: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for a, b in _sides(left, right):
            keys, ca, cb = _ranked(a, b)
            label = np.arange(len(keys))
            floor, big = np.float32(threshold - _margin(a.dim)), -1
            for x in range(0, len(a), STRIP):
                for y in range(x // TILE * TILE if a is b else 0, len(b), TILE):
                    r, c = np.arange(x, min(x + STRIP, len(a))), np.arange(y, min(y + TILE, len(b)))
                    in_big = label[ca[r]] == big
                    for some, cols in ((r[~in_big], c), (r[in_big], c[label[cb[c]] != big])):
                        if not len(some) or not len(cols):
                            continue
                        i, j = np.divmod(np.flatnonzero(a.unit[some] @ b.unit[cols].T >= floor), len(cols))
                        i, j = some[i], cols[j]
                        apart = label[ca[i]] != label[cb[j]]
                        i, j = i[apart], j[apart]
                        ok = _exact(a, i, b, j) >= threshold - 1e-12
                        if ok.any():
                            label = _hooked(label, ca[i[ok]], cb[j[ok]])
                            big = int(np.bincount(label).argmax())
            far = np.flatnonzero(label != np.arange(len(label)))
            for k in range(0, len(far), 1 << 16):
                f = far[k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"a": keys.take(pa.array(f)), "b": keys.take(pa.array(label[f]))})

    return _met(each, parts, meet, f"a {kind}, b {kind}")


def _best(a: _Side, b: _Side, cb: np.ndarray, i: np.ndarray, j: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of the ``limit`` best of every i; of equals the lesser key."""
    s = _exact(a, i, b, j)
    o = np.lexsort((cb[j], -s, i))
    i, j, s = i[o], j[o], s[o]
    ok = np.arange(len(i)) - np.searchsorted(i, i) < limit
    return i[ok], j[ok], s[ok]


def knn_join(queries: DataFrame, base: DataFrame, limit: int = 25, threshold: float = 0.5, key: str = "uuid", vector: str = "vector", block: int | None = None, others: bool = False) -> DataFrame:
    """(query, match, score, rank): for every query its ``limit`` most similar base rows, then those of at least ``threshold``; others: not the row of its own key. Each pair of blocks keeps only its own best ``limit``: single precision with a margin drops what can't be among them, double precision ranks the rest. The base has fewer blocks, as each of them hands on its best."""
    nq, nb = _block_count(queries, vector, block, 2 * GRID), _block_count(base, vector, block, GRID // 2)
    q = _packed(queries, key, vector, nq).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nb - 1)))).withColumn("part", F.col("block") * nb + F.col("other")).withColumn("side", F.lit(0))
    m = _packed(base, key, vector, nb).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)))).withColumn("part", F.col("other") * nb + F.col("block")).withColumn("side", F.lit(1))
    kq, km = queries.schema[key].dataType.simpleString(), base.schema[key].dataType.simpleString()
    most = max(limit, 1)

    def meet(left: dict[int, list], right: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for a, b in _sides(left, right):
            keys, ca, cb = _ranked(a, b)
            slack = np.float32(2 * _margin(a.dim))
            same = others and np.isin(ca, cb).any()
            for x in range(0, len(a), STRIP):
                u = a.unit[x : x + STRIP]
                floor = np.full(len(u), max(threshold, -1.0) - _margin(a.dim), np.float32)
                got, n = [], 0
                for y in range(0, len(b), TILE):
                    v = b.unit[y : y + TILE]
                    s = u @ v.T
                    if same:
                        s[ca[x : x + STRIP, None] == cb[None, y : y + TILE]] = -2.0
                    hit = s >= floor[:, None]
                    if len(v) > most and np.count_nonzero(hit) > 4 * most * len(u):
                        floor = np.maximum(floor, np.partition(s, len(v) - most, axis=1)[:, len(v) - most] - slack)
                        hit = s >= floor[:, None]
                    i, j = np.divmod(np.flatnonzero(hit), len(v))
                    got.append((i, j + y, s[hit]))
                    n += len(i)
                    if n > 8 * most * len(u) or y + TILE >= len(b):
                        i, j, s = map(np.concatenate, zip(*got, strict=True))
                        o = np.argsort(4.0 * i - s)
                        first, size = np.searchsorted(i[o], np.arange(len(u))), np.bincount(i, minlength=len(u))
                        full = np.flatnonzero(size >= most)
                        floor[full] = np.maximum(floor[full], s[o[first[full] + most - 1]] - slack)
                        ok = s >= floor[i]
                        got, n = [(i[ok], j[ok], s[ok])], int(ok.sum())
                        if n > 4 * most * len(u):  # many equals
                            i, j, s = _best(a, b, cb, got[0][0] + x, got[0][1], most)
                            got, n = [(i - x, j, s.astype(np.float32))], len(i)
                i, j, s = _best(a, b, cb, got[0][0] + x, got[0][1], most)
                ok = s >= max(threshold, -1.0)
                if ok.any():
                    yield pa.RecordBatch.from_pydict({"query": keys.take(pa.array(ca[i[ok]])), "match": keys.take(pa.array(cb[j[ok]])), "score": pa.array(s[ok])})

    got = _met(q.unionByName(m), nq * nb, meet, f"query {kq}, match {km}, score double")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "match"))
    return got.withColumn("rank", rank).where(F.col("rank") <= limit)


def fused(a: DataFrame, b: DataFrame, key: str = "uuid", k: int = 60) -> DataFrame:
    """(key, score): reciprocal-rank fusion of two ranked lists (key, rank)."""
    both = a.select(key, "rank").unionByName(b.select(key, "rank"))
    return both.groupBy(key).agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))

