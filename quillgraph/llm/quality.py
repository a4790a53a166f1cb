"""Quality classifier from weak labels.

Nine heuristic labellers look at every document and vote good, bad or abstain.
Expectation-maximisation over the counts of all vote patterns (there are at most
3 ** 9, whatever the size of the corpus) estimates the share of good documents and,
for each labeller, the probability of a good and a bad vote given the hidden class;
abstaining says nothing about it. The
posterior of its pattern is a document's weak label. A linear scorer over hashed
features of token shapes, pairs of shapes, repetition and token length is then
trained on the posteriors of at most ``FIT_ROWS`` documents, and decides on every
document. A document is kept if its score is at least
``KEEP_FROM``, which leans to keeping: a clean document lost costs more than a poor one kept.

Defined results. A null or empty text, or one without a word, has no score and is
not kept. Rows without an id are judged like others, but not fitted on. Repeated rows are each judged, and all alike. A score of exactly ``KEEP_FROM`` is kept.
Of rows that share a doc_id, one is fitted on. Texts of any length are read whole. If no document has a word,
nothing is kept, and of an empty table there is no result. Only the named columns are read; ``keep_good`` keeps all.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import cut, forget, texts

#: Documents that the scorer is fitted on, at most; those with the smallest hashes of doc_id.
FIT_ROWS = 4000
KEEP_FROM = 0.2
DIMS, STEPS, RATE, DECAY = 1024, 300, 0.3, 1e-5
LABELLERS = ("marks", "capitals", "repeats", "nearby_repeats", "variety", "sentences", "short_words", "loud_tokens", "plain_tokens")
#: Tokens that every document is taken to have besides its own, of no feature: short texts lean to the scorer's bias.
SHRINK = 4
GOOD, BAD = 1, 2

_TOKEN = ~K.SPACE
_STOP = np.isin(np.arange(256), np.frombuffer(b".?:;,", np.uint8))
#: Bytes by kind for shapes: upper case, lower case, digit, else the byte itself.
_KIND = np.where(K.UPPER, 65, np.where(K.LOWERCASE | K.HIGH, 97, np.where(K.DIGIT, 48, np.arange(256)))).astype(np.uint8)


class Model(NamedTuple):
    share: float
    votes: np.ndarray  # labeller, vote, class (bad, good): probability
    weights: np.ndarray
    bias: float


def _spread(flag: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=c[1:])
    return c[ends] - c[starts]


def votes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, votes by document and labeller): 0 abstain, 1 good, 2 bad."""
    s, e, toks = K.spans(raw, offs, _TOKEN)
    n = np.diff(toks)
    some = np.maximum(n, 1)
    lo, hi = offs[:-1], offs[1:]
    wordy = _spread(K.WORD[raw], s, e)
    size = e - s
    words = K.sums(wordy > 0, toks)
    solid = np.maximum(_spread(_TOKEN[raw], lo, hi), 1)
    marks = _spread(K.MARK[raw], lo, hi) / solid
    upper, lower = _spread(K.UPPER[raw], lo, hi), _spread(K.LOWERCASE[raw], lo, hi)
    capitals = upper / np.maximum(upper + lower, 1)
    h = K.hashes(raw, s, e, K.FOLD)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    heads = toks[:-1][n > 0]
    same[heads] = False
    repeats = K.sums(same, toks) / np.maximum(n - 1, 1)
    doc = np.repeat(np.arange(len(n)), n)
    near = np.zeros(len(h), bool)
    for back in (1, 2, 3):
        near[back:] |= (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
    nearby = K.sums(near, toks) / some
    # distinct tokens of each full window of 32 tokens, by sorting the windows at once
    full = n // 32
    first = np.repeat(toks[:-1], full) + 32 * (np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full))
    w = np.sort(h[first[:, None] + np.arange(32)], axis=1) if len(first) else np.zeros((0, 32), np.uint64)
    fresh = 1 + (w[:, 1:] != w[:, :-1]).sum(axis=1)
    at = np.concatenate([[0], np.cumsum(full)])
    variety = K.sums(fresh, at) / np.maximum(full, 1) / 32
    final = raw[e - 1] if len(e) else np.zeros(0, np.uint8)
    stops = K.sums(_STOP[final], toks) / some
    short = K.sums((wordy == size) & (size <= 3), toks) / some
    loud = K.sums((wordy == 0) | (final == 33) | (final == 124), toks) / some
    plain = K.sums((wordy == size) | (wordy == size - 1) & _STOP[final], toks) / some

    def vote(x: np.ndarray, good: np.ndarray, bad: np.ndarray, least: int = 1) -> np.ndarray:
        return np.where(n < least, 0, np.where(bad, BAD, np.where(good, GOOD, 0)))

    out = np.stack(
        [
            vote(marks, marks < 0.01, marks > 0.04),
            vote(capitals, (capitals < 0.25) & (upper + lower > 0), (capitals > 0.4) & (upper + lower >= 12)),
            vote(repeats, repeats < 0.1, repeats > 0.25, 4),
            vote(nearby, nearby < 0.15, nearby > 0.35, 6),
            vote(variety, variety > 0.6, variety < 0.4, 32),
            vote(stops, (stops > 0.02) & (stops < 0.5), (stops < 0.005) | (stops > 0.8), 25),
            vote(short, short > 0.2, short < 0.04, 12),
            vote(loud, loud < 0.02, loud > 0.15),
            vote(plain, plain > 0.93, plain < 0.6),
        ],
        axis=1,
    )
    return words, out


def features(raw: np.ndarray, offs: np.ndarray, dims: int = DIMS) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, offsets by document): four for each token."""
    s, e, toks = K.spans(raw, offs, _TOKEN)
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _KIND[raw]
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[s] = True
    c = np.concatenate([[0], np.cumsum(turn)])
    shape = K.hashes(kind[turn], c[s], c[e], K.SAME)
    head = np.zeros(len(s), bool)
    head[toks[:-1][np.diff(toks) > 0]] = True
    before = np.where(head, np.uint64(1), np.concatenate([[np.uint64(1)], shape[:-1]]))
    h = K.hashes(raw, s, e, K.FOLD)
    again = np.concatenate([[False], h[1:] == h[:-1]]) & ~head
    length = np.minimum(e - s, 15) >> 2
    four = np.stack([shape, K.mix(before * np.uint64(0x9FB21C651E98DF25) + shape), np.where(again, np.uint64(11), np.uint64(12)), length.astype(np.uint64) + np.uint64(21)], axis=1)
    four[:, 2:] = K.mix(four[:, 2:])
    return (four.ravel() % np.uint64(dims)).astype(np.int64), toks * 4


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good, vote probabilities, posterior good of each pattern); patterns: votes by labeller."""
    w = counts.astype(np.float64)
    good, bad = (patterns == GOOD).sum(1), (patterns == BAD).sum(1)
    post = np.where(bad >= np.maximum(1, good / 4), 0.05, np.where(bad > 0, 0.7, np.where(good > 0, 0.95, 0.5)))
    share, table = 0.5, np.zeros((patterns.shape[1], 3, 2))
    for _ in range(rounds):
        total = np.array([(w * (1 - post)).sum(), (w * post).sum()])
        share = (total[1] + 1) / (total.sum() + 2)
        for v in (GOOD, BAD):
            hit = patterns == v
            table[:, v, 0] = ((w * (1 - post))[:, None] * hit).sum(0)
            table[:, v, 1] = ((w * post)[:, None] * hit).sum(0)
        table[:, 1:] += 0.1
        table[:, 1:] /= table[:, 1:].sum(axis=1, keepdims=True)
        table[:, 0] = 1.0
        new = posterior(patterns, share, table)
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return share, table, post


def posterior(patterns: np.ndarray, share: float, table: np.ndarray) -> np.ndarray:
    odds = np.full(len(patterns), np.log(share / (1 - share)))
    for j in range(patterns.shape[1]):
        odds += np.log(table[j, patterns[:, j], 1] / table[j, patterns[:, j], 0])
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> tuple[np.ndarray, float]:
    """Logistic scorer of dense feature means under soft labels, by Adam over the whole sample. Either class has half the weight."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    weight = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    weight /= weight.sum()
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = (p - y) * weight
        grad = np.append(x.T @ g + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _means(f: np.ndarray, at: np.ndarray, dims: int) -> np.ndarray:
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(doc * dims + f, minlength=n * dims).reshape(n, dims) / (np.diff(at) / 4 + SHRINK)[:, None]


def patterns_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, words, pattern) of every row; a pattern is the votes as digits to the base 3."""
    base = 3 ** np.arange(len(LABELLERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                words, v = votes(raw, offs)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(words.astype(np.int64)), pa.array((v @ base).astype(np.int32))], names=["doc_id", "words", "pattern"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, words long, pattern int")


def unpack(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, dims: int = DIMS) -> Model:
    pats = cut(patterns_of(docs, id_col, text_col))
    seen = pats.where("words > 0").groupBy("pattern").agg(F.count("*").alias("n")).collect()  # 3 ** 9 rows at most
    if not seen:
        forget(pats)
        return Model(0.0, np.ones((len(LABELLERS), 3, 2)), np.zeros(dims), -1.0)
    seen.sort(key=lambda r: r["pattern"])
    codes = np.array([r["pattern"] for r in seen])
    share, table, post = em(unpack(codes), np.array([r["n"] for r in seen]))
    # half of the sample from either side, so that a rare class is learned too; each side has at most half of the rows
    is_good = {int(c): bool(p >= 0.5) for c, p in zip(codes, post)}
    good = F.col("pattern").isin([c for c, g in is_good.items() if g])
    h = F.xxhash64("doc_id")
    ids = [pats.where("words > 0 and doc_id is not null").where(side).select("doc_id", h.alias("h")).distinct().orderBy("h", "doc_id").limit(fit_rows // 2) for side in (good, ~good)]
    wanted = docs.sparkSession.createDataFrame([(r["doc_id"],) for part in ids for r in part.collect()] or [(-1,)], "doc_id long")
    forget(pats)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = 3 ** np.arange(len(LABELLERS))
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                words, v = votes(raw, offs)
                x = _means(*features(raw, offs, dims), dims).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(words), pa.array((v @ base).astype(np.int32)), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "words", "pattern", "x"])

    rows = texts(docs, id_col, text_col).join(F.broadcast(wanted), "doc_id").mapInArrow(run, "doc_id long, words long, pattern int, x binary").where("words > 0").groupBy("doc_id").agg(F.min(F.struct("pattern", "x")).alias("r")).select("doc_id", "r.*").collect()
    rows.sort(key=lambda r: r["doc_id"])
    if not rows:
        return Model(share, table, np.zeros(dims), 1.0 if share >= 0.5 else -1.0)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    y = posterior(unpack(np.array([r["pattern"] for r in rows])), share, table)
    if (y >= 0.5).all() or (y < 0.5).all():
        return Model(share, table, np.zeros(dims), 1.0 if y[0] >= 0.5 else -1.0)
    return Model(share, table, *train(x, y))


def scores(raw: np.ndarray, offs: np.ndarray, model: Model) -> np.ndarray:
    """Probability of good by document; NaN without a word."""
    if len(offs) == 2 and len(raw) > 4 * K.GROUP:  # a long text by itself: in parts, each with the token before it
        s, e, _ = K.spans(raw, offs, _TOKEN)
        total, step = 0.0, max(1, len(s) * K.GROUP // len(raw))
        for k in range(0, len(s), step):
            lo, hi = max(0, k - 1), min(len(s), k + step)
            part = raw[s[lo] : e[hi - 1]]
            total += float(model.weights[features(part, np.array([0, len(part)]), len(model.weights))[0][4 * (k - lo) :]].sum())
        z = np.array([total / (len(s) + SHRINK) + model.bias])
    else:
        f, at = features(raw, offs, len(model.weights))
        z = K.sums(model.weights[f], at) / (np.diff(at) / 4 + SHRINK) + model.bias
    words = K.sums(K.WORD[raw], offs)
    return np.where(words > 0, 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.nan)


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, weak, score, keep) of every row: the posterior of its votes, its score and the decision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                s = scores(raw, offs, model)
                _, v = votes(raw, offs)
                none = np.isnan(s)
                weak = posterior(v, min(max(model.share, 1e-9), 1 - 1e-9), model.votes)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.round(weak, 6), mask=none), pa.array(np.round(s, 6), mask=none), pa.array(np.where(none, False, np.nan_to_num(s) >= KEEP_FROM))], names=["doc_id", "weak", "score", "keep"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, weak double, score double, keep boolean")


def classify(docs: DataFrame, **how) -> DataFrame:
    cols = {k: v for k, v in how.items() if k in ("id_col", "text_col")}
    return judge(docs, fit(docs, **how), **cols)


def keep_good(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are, without a shuffle."""
    model = fit(docs, text_col=text_col, **how)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for lo, hi, raw, offs in K.each_group(b.column(at)):
                keep[lo:hi] = np.nan_to_num(scores(raw, offs, model)) >= KEEP_FROM
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
