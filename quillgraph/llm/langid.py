"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a whole text from the left and from the right. A step is

    g = (1 + s(Wg[byte] + Ug h)) / 2,  c = s(Wc[byte] + Uc h),  h = h + g * (c - h)

with s(x) = x / (1 + |x|), a quick relative of tanh, and the two states of a position give, through one linear layer and a softmax, the
probability of each language there. Every byte of every text is labelled; a document's
probabilities are the mean over its positions. It is trained in numpy by
backpropagation through time on stretches of ``FIT_BYTES`` bytes of at most ``FIT_ROWS`` labelled documents,
up to ``FIT_STRETCHES`` from each, spread evenly over it, in classes of equal weight.

To use whole matrix products, a text is read in windows of ``WINDOW`` bytes side by side; its end is
filled with a symbol of its own. The state is carried from window to window: a window begins with the state
that its neighbour's last ``RUN_UP`` bytes lead to, and wherever that is off the neighbour's state by more than
``CLOSE``, the window is read again from the neighbour's, until none is off. So states are those of reading the text in one go, within ``CLOSE``.

Defined results. A null or empty text has no language and no probability, and 0
positions. Ties go to the first language by name. Without labelled text no language is
known, and every result is null. An empty table has no result. Rows without an id and repeated rows are each labelled,
and texts of any length are read whole. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import texts

WINDOW, RUN_UP, CLOSE, HIDDEN = 256, 64, 0.01, 8
FIT_ROWS, FIT_STRETCHES, FIT_BYTES, BATCH, STEPS, RATE = 2000, 6, 64, 384, 260, 0.03
#: Windows that go through the network at once.
TILE = 2048
_PAD = 256  # the byte after a text's end


class Model(NamedTuple):
    languages: tuple[str, ...]
    w: np.ndarray  # direction, byte, gate and candidate
    u: np.ndarray  # direction, state, gate and candidate
    out: np.ndarray  # both states and a one, language


def windows(raw: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by window and position, padded; first byte of each window; windows before each document)."""
    n = -(-np.diff(offs) // size)
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(offs[:-1], n) + size * (np.arange(at[-1]) - np.repeat(at[:-1], n))
    last = np.repeat(offs[1:], n)
    k = first[:, None] + np.arange(size)
    x = np.where(k < last[:, None], raw.astype(np.int16)[np.minimum(k, max(len(raw) - 1, 0))] if len(raw) else np.int16(0), np.int16(_PAD))
    return x, first, at


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def states(x: np.ndarray, m: Model, begin: np.ndarray | None = None, ends: bool = False) -> np.ndarray:
    """(position, both states, window): what each position knows of the bytes up to it from either side; begin: (direction, state, window) before the first byte. ends: only the last of either direction."""
    b, t = x.shape
    k = m.u.shape[1]
    h = np.empty((2, k, b) if ends else (t, 2 * k, b), np.float32)
    pre, got = np.empty((2 * k, b), np.float32), np.empty((2 * k, b), np.float32)
    g, c = pre[:k], pre[k:]
    columns = x.T.astype(np.intp)
    for d, order in enumerate((range(t), range(t - 1, -1, -1))):
        w, u = np.ascontiguousarray(m.w[d].T), np.ascontiguousarray(m.u[d].T)
        last = np.zeros((k, b), np.float32) if begin is None else np.ascontiguousarray(begin[d])
        for j in order:
            np.take(w, columns[j], axis=1, out=got, mode="clip")
            np.matmul(u, last, out=pre)
            pre += got
            np.abs(pre, out=got)
            got += 1
            pre /= got
            g += 1
            g *= 0.5
            c -= last
            c *= g
            now = h[d] if ends else h[j, d * k : (d + 1) * k]
            np.add(last, c, out=now)
            last = now
    return h


def label(x: np.ndarray, m: Model, begin: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label by position and window, probabilities by position, language and window, last states by direction and window)."""
    h = states(x, m, begin)
    k = m.u.shape[1]
    z = np.matmul(np.ascontiguousarray(m.out[:-1].T), h)
    z += m.out[-1][:, None]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z.argmax(axis=1), z, np.stack([h[-1, :k], h[0, k:]])


def read(x: np.ndarray, at: np.ndarray, m: Model, use: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> None:
    """Labels the windows of whole texts, with the state carried across; ``use`` gets their numbers, labels and probabilities, again for those that are read again."""
    k, n = m.u.shape[1], len(x)
    begin, end = np.zeros((2, k, n), np.float32), np.zeros((2, k, n), np.float32)
    inner = np.ones(n + 1, bool)  # window i - 1 and i are of one text
    inner[at] = False
    after = np.flatnonzero(inner[:n])
    for i in range(0, len(after), TILE):
        p = after[i : i + TILE]
        run = np.stack([x[p - 1, -RUN_UP:], x[p, :RUN_UP]])
        begin[0][:, p] = states(run[0], m, None, True)[0]
        begin[1][:, p - 1] = states(run[1], m, None, True)[1]
    todo = np.arange(n)
    while len(todo):
        for i in range(0, len(todo), TILE):
            w = todo[i : i + TILE]
            lab, p, end[:, :, w] = label(x[w], m, begin[:, :, w])
            use(w, lab, p)
        off = np.abs(end[0][:, after - 1] - begin[0][:, after]).max(axis=0, initial=0) > CLOSE
        back = np.abs(end[1][:, after] - begin[1][:, after - 1]).max(axis=0, initial=0) > CLOSE
        begin[0][:, after[off]] = end[0][:, after[off] - 1]
        begin[1][:, after[back] - 1] = end[1][:, after[back]]
        todo = np.unique(np.concatenate([after[off], after[back] - 1]))


def pooled(raw: np.ndarray, offs: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray]:
    """(mean probabilities by document and language, positions labelled by document and language)."""
    x, _, at = windows(raw, offs)
    n = len(m.languages)
    total, counts = np.zeros((len(x), n)), np.zeros((len(x), n), np.int64)

    def use(w: np.ndarray, lab: np.ndarray, p: np.ndarray) -> None:
        real = (x[w] != _PAD).T
        if not real.all():
            p *= real[:, None, :]
            lab[~real] = -1
        total[w] = p.sum(axis=0).T
        for k in range(n):
            counts[w, k] = (lab == k).sum(axis=0)

    read(x, at, m, use)
    docs = np.stack([K.sums(total[:, k], at) for k in range(n)], axis=1)
    return docs / np.maximum(np.diff(offs), 1)[:, None], np.stack([K.sums(counts[:, k], at) for k in range(n)], axis=1)


def backward(x: np.ndarray, y: np.ndarray, m: Model, grad: list[np.ndarray]) -> float:
    """Adds to ``grad`` the gradients of w, u and out of the mean cross-entropy over real positions, by backpropagation through time; gives the loss."""
    b, t = x.shape
    k = m.u.shape[1]
    cols = x.T.astype(np.intp)
    hs, gs, cs = np.zeros((2, t + 1, b, k)), np.zeros((2, t, b, k)), np.zeros((2, t, b, k))
    orders = (list(range(t)), list(range(t - 1, -1, -1)))
    for d, order in enumerate(orders):
        for i, j in enumerate(order):
            pre = m.w[d][cols[j]] + hs[d, i] @ m.u[d]
            act = soft(pre)
            g, c = (1 + act[:, :k]) / 2, act[:, k:]
            gs[d, i], cs[d, i] = g, c
            hs[d, i + 1] = hs[d, i] + g * (c - hs[d, i])
    both = np.concatenate([hs[0, 1:], hs[1, 1:][::-1], np.ones((t, b, 1))], axis=2)
    z = both @ m.out
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    real = (x.T != _PAD).astype(np.float64)
    real /= real.sum()
    picked = np.take_along_axis(p, np.broadcast_to(y[None, :, None], (t, b, 1)), axis=2)[..., 0]
    loss = float(-(np.log(np.maximum(picked, 1e-12)) * real).sum())
    dz = p
    np.put_along_axis(dz, np.broadcast_to(y[None, :, None], (t, b, 1)), picked[..., None] - 1, axis=2)
    dz = dz * real[:, :, None]
    grad[2] += both.reshape(-1, 2 * k + 1).T @ dz.reshape(-1, dz.shape[2])
    dboth = dz @ m.out[:-1].T
    for d, order in enumerate(orders):
        dh = np.zeros((b, k))
        for i in range(t - 1, -1, -1):
            j = order[i]
            dh = dh + dboth[j][:, d * k : (d + 1) * k]
            g, c, h = gs[d, i], cs[d, i], hs[d, i]
            dpre = np.concatenate([dh * (c - h) * 0.5 * (1 - np.abs(2 * g - 1)) ** 2, dh * g * (1 - np.abs(c)) ** 2], axis=1)
            np.add.at(grad[0][d], cols[j], dpre)
            grad[1][d] += h.T @ dpre
            dh = dh * (1 - g) + dpre @ m.u[d].T
    return loss


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = RATE, seed: int = 0) -> Model:
    """By Adam over balanced batches of windows; the same for the same windows."""
    rng = np.random.default_rng(seed)
    w, u = rng.normal(0, 0.3, (2, 257, 2 * hidden)), rng.normal(0, 0.3, (2, hidden, 2 * hidden))
    params = [w, u, rng.normal(0, 0.1, (2 * hidden + 1, len(languages)))]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    of = [np.flatnonzero(y == k) for k in range(len(languages))]
    for k in range(1, steps + 1):
        pick = np.concatenate([rng.choice(i, max(1, batch // len(of))) for i in of if len(i)])
        part = x[pick].copy()
        short = rng.random(len(pick)) < 0.3  # some windows are shortened, as short texts are
        part[short[:, None] & (np.arange(part.shape[1]) >= rng.integers(4, 40, len(pick))[:, None])] = _PAD
        grad = [np.zeros_like(p) for p in params]
        backward(part, y[pick], Model(languages, *params), grad)
        now = rate * (1 - 0.9 * k / steps)
        for p, g, a, b in zip(params, grad, m1, m2):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= now * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-8)
    return Model(languages, *(p.astype(np.float32) for p in params))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, fit_stretches: int = FIT_STRETCHES) -> Model | None:
    """Trained on the labelled documents with the smallest hashes of doc_id, equally many of each language at most; of more than ``fit_rows`` languages, on the most frequent."""
    of = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null and lang <> '' and text <> ''")
    given = of.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    names = [r["lang"] for r in given.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(fit_rows).collect()]
    if not names:
        return None
    # only the first rows of each partition go into a language's window
    first = W.partitionBy("lang").orderBy("h", "doc_id")
    ranked = given.where(F.col("lang").isin(names)).withColumn("k", F.dense_rank().over(first)).where(F.col("k") <= max(1, fit_rows // len(names)))
    chosen = ranked.select("doc_id", "lang").distinct().limit(2 * fit_rows)
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, lang string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                x, _, at = windows(raw, offs, FIT_BYTES)
                keep = [np.unique(np.linspace(a, z - 1, fit_stretches).astype(int)) for a, z in zip(at, at[1:]) if z > a]
                k = np.concatenate(keep) if keep else np.zeros(0, int)
                doc = np.searchsorted(at, k, "right") - 1
                part = [b.column(c).slice(lo, hi - lo).take(pa.array(doc)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(k - at[doc]), pa.array([r.tobytes() for r in x[k]], pa.binary())], names=["doc_id", "lang", "k", "x"])

    got = of.join(F.broadcast(wanted), ["doc_id", "lang"]).select("doc_id", "text", "lang").mapInArrow(cut, "doc_id long, lang string, k long, x binary")
    got = got.groupBy("doc_id", "lang", "k").agg(F.min("x").alias("x")).collect()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["k"]))
    languages = tuple(sorted({r["lang"] for r in got}))
    if not languages:
        return None
    x = np.stack([np.frombuffer(r["x"], np.int16) for r in got])
    return train(x, np.array([languages.index(r["lang"]) for r in got]), languages)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, probability, bytes, positions) of every row; positions: how many bytes are labelled with each language, in the order of their names."""
    m = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                n = np.diff(offs)
                ids = b.column(0).slice(lo, hi - lo)
                if m is None:
                    yield pa.RecordBatch.from_arrays([ids, pa.nulls(hi - lo, pa.string()), pa.nulls(hi - lo, pa.float64()), pa.array(n), pa.nulls(hi - lo, pa.list_(pa.int64()))], names=["doc_id", "language", "probability", "bytes", "positions"])
                    continue
                p, counts = pooled(raw, offs, m)
                best = p.argmax(axis=1)
                names = pa.array(m.languages).take(pa.array(best, mask=n == 0))
                at = pa.array(np.arange(len(n) + 1) * len(m.languages), pa.int32())
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(np.round(p[np.arange(len(n)), best].astype(np.float64), 6), mask=n == 0), pa.array(n), pa.ListArray.from_arrays(at, pa.array(counts.ravel()))], names=["doc_id", "language", "probability", "bytes", "positions"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, language string, probability double, bytes long, positions array<long>")


def segments(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(first byte, last byte + 1, language) of the maximal runs of equal labels of a text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return []
    x, _, at = windows(raw, np.array([0, len(raw)]))
    all_ = np.zeros(x.shape, np.int64)

    def use(w: np.ndarray, lab: np.ndarray, p: np.ndarray) -> None:
        all_[w] = lab.T

    read(x, at, model, use)
    flat = all_.ravel()[: len(raw)]
    cut = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
    return [(int(a), int(z), model.languages[flat[a]]) for a, z in zip(cut, cut[1:])]


def languages(docs: DataFrame, **how) -> DataFrame:
    cols = {k: v for k, v in how.items() if k in ("id_col", "text_col")}
    return identify(docs, fit(docs, **how), **cols)
