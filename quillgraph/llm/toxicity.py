"""Toxicity by compression distance between two trained zstandard dictionaries.

Both dictionaries are trained by zstandard (``train_dictionary``) on labelled text. The ordinary one is
trained on the words of ordinary documents; the toxic one holds the same and, before it, a dictionary
trained on toxic documents. Trained on these as they are, it would fill with the ordinary words that toxic documents
mostly consist of: then under 3 % of held-out toxic documents stand out at sf0.1. So its samples are the words of toxic
documents whose beginnings stand out, and the ordinary samples are the other words: those with beginnings (of ``SHORT`` to
``LONG`` bytes, blanks included) that occur at least ``CONTRAST`` times as often in toxic text. Distinct contexts are counted,
so that many copies of one text count once. zstandard itself finds what to keep of the samples, and how.

Every labelled row is counted: the words and their contexts, the words before them by 64 bits of a hash, over the whole tables. Pairs of both
go packed to blocks that the hashes divide them into, whose number grows with the text; a word with many contexts is in several. What zstandard is trained on are
texts that have each word as often as all labelled rows together have contexts of it, in a drawn order: as no match goes
beyond a word, only frequencies matter. Beyond ``TEXT_BYTES`` they are scaled, and no offered word becomes rarer than one. A dictionary can't hold
more words than its bytes; zstandard chooses from the most frequent words of ``OFFERED`` times as many bytes, ties by the word.

Every window of every document is compressed with each dictionary. Where nothing toxic occurs both parses are the same;
where it does, the toxic dictionary saves bytes. The score of a document is the sum of the bytes saved by
its windows over the square root of their number. Its best run is the most that
this is for any 1, 2, 4, ... neighbouring windows, so a passage counts alike in short
and long texts. A document is toxic if either reaches its threshold. Both are calibrated
on every row labelled clean: the hash of the text puts each row in one of two halves, and a row is scored with dictionaries
made of the other half, so copies of a text are held out together. The dictionaries that are used come from both halves.

The dictionaries have ``TOXIC_BYTES`` and ``ORDINARY_BYTES``. A match has five bytes at least, so a word of three letters tells
nothing by itself. Of longer words the first ``WINDOW`` bytes are counted, as a window compares few more.

Defined results. A null or empty text scores 0 and is never toxic; without an id it is scored without one. Labels other
than 0 and 1, and labels of unknown documents, are left out of training; a document labelled both ways is toxic. Without
toxic labels nothing is toxic. A score that equals its threshold is toxic. Of rows that share a doc_id
each is fitted on and scored, repeated rows alike. Texts of any length are read whole. An empty table has no
result. Only the named columns are read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import BROADCAST_BYTES, cut, forget, texts

#: Bytes of the words that zstandard chooses from, for each byte of a dictionary, and of the texts it is trained on.
OFFERED, TEXT_BYTES = 4, 8 << 20
#: The halves of the labelled rows that a pair of dictionaries is made of: either one, to calibrate on the other, and both.
FITS = ((0,), (1,), (0, 1))
#: By the name of a count, the classes that count in it: t0 is toxic rows of the first of ``FITS``, o0 ordinary ones. Class 2 * flag + half is a bit.
BITS = {f"{kind}{f}": sum(1 << 2 * flag + half for half in fit) for flag, kind in enumerate("ot") for f, fit in enumerate(FITS)}
#: Bytes of labelled text for each block of pairs.
SHARE = 16 << 20
WINDOW, OVERLAP, ORDINARY_BYTES, TOXIC_BYTES = 64, 16, 110_000, 4096
FALSE_RATE, LEAST = 0.001, 0.75
#: Lengths of the segments that zstandard picks for either dictionary, of the pieces of them it counts, and bytes of a sample.
TOXIC_SEGMENT, ORDINARY_SEGMENT, PIECE, SAMPLE, TOXIC_SAMPLE = 40, 64, 6, 4096, 256

_LETTER = K.UPPER | K.LOWERCASE | K.HIGH
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")
SHORT, LONG = 6, 12
_WHOLE = re.compile(rb" [A-Za-z\x80-\xff]+\0")
#: A sample's words end with a byte that no text has, so a match never takes the blank that begins the next word.
_END = b"\0"
#: Every window begins with the bytes that end both dictionaries, so even a short one compresses and is not stored as it is.
_FILL = bytes(range(1, 9)) * 2
#: How much more often than in ordinary text a word's beginning must occur in toxic text.
CONTRAST = 10


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    threshold: float
    run: float = math.inf


def _parts(text: bytes, limit: int = K.GROUP) -> Iterator[bytes]:
    """The text in parts of about ``limit`` bytes that end where a word does."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + limit)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _pieces(raw: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The group itself; one long text in parts."""
    if len(raw) <= 2 * K.GROUP:
        yield raw, offs
        return
    for part in _parts(raw.tobytes()):
        yield np.frombuffer(part, np.uint8), np.array([0, len(part)])


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The binary values of these sizes that lie one behind the other in ``data``."""
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(folded words, their offsets by document)."""
    starts, ends, toks = K.spans(raw, offs, _LETTER)
    ends = np.minimum(ends, starts + WINDOW)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    return _binary(K.FOLD[raw[inside]], ends - starts).dictionary_encode(), toks


def _hashes(words: pa.Array) -> np.ndarray:
    raw, offs = K.buffers(words)
    return K.hashes(raw, offs[:-1], offs[1:], K.SAME)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows begin to differ from the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


class _Pairs:
    """Pairs of a word and what is before it, with the classes that have them as bits; ``add`` as they come, ``distinct`` each once."""

    def __init__(self) -> None:
        self.held, self.n, self.words = [], 0, 0

    def add(self, words: pa.Array, word: np.ndarray, before: np.ndarray, bits: np.ndarray) -> None:
        self.held.append((words, word.astype(np.int32) + np.int32(self.words), before, bits.astype(np.uint8)))
        self.n, self.words = self.n + len(word), self.words + len(words)

    def distinct(self, block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(words, word of each pair, hash of what is before it, bits, block), in the order of the blocks and words. block: what (hashes of the words, hashes before them) belong to."""
        words, word, before, bits = zip(*self.held)
        each = pa.concat_arrays(words).dictionary_encode()
        word, before, bits = each.indices.to_numpy()[np.concatenate(word)], np.concatenate(before), np.concatenate(bits)
        at = block(_hashes(each.dictionary)[word], before) if block else np.zeros(len(word), np.int32)
        order = np.lexsort((before, word, at) if block else (before, word))
        word, before, at = word[order], before[order], at[order]
        first = _firsts(word, before)
        self.held, self.n, self.words = [], 0, 0
        return each.dictionary, word[first], before[first], np.bitwise_or.reduceat(bits[order], first), at[first]


def _pack(words: pa.Array, word: np.ndarray, before: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """Sizes and bytes of the words, how many pairs each has, gaps between their sorted hashes, and bits, all compressed."""
    new = _firsts(word)
    raw, offs = K.buffers(words.take(pa.array(word[new])))
    gaps = np.diff(before, prepend=np.uint64(0))
    gaps[new] = before[new]
    c = zs.ZstdCompressor(level=1)
    planes = (np.diff(offs).astype(np.uint8), raw, np.diff(np.append(new, len(word))).astype(np.uint32), gaps, bits)
    return [c.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T)) for x in planes]


def _unpack(packed: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word of each pair, hash of what is before it, bits) of what ``_pack`` made."""
    d = zs.ZstdDecompressor()
    sizes, raw, many, gaps, bits = (np.ascontiguousarray(np.frombuffer(d.decompress(x), np.uint8).reshape(np.dtype(t).itemsize, -1).T).reshape(-1).view(t) for x, t in zip(packed, (np.uint8, np.uint8, np.uint32, np.uint64, np.uint8)))
    at = np.cumsum(many, dtype=np.int64) - many
    run = np.cumsum(gaps, dtype=np.uint64)
    return _binary(raw, sizes), np.repeat(np.arange(len(many)), many), run - np.repeat(run[at] - gaps[at], many), bits


def counts(rows: DataFrame, share: int = SHARE, most: int = 1 << 21) -> DataFrame:
    """(word, for each of ``BITS`` the number of its contexts there) of rows (text, flag, half): how many different words are before it. The empty word has the different texts.

    ``share``: bytes of text for each block that the pairs are divided into; ``most``: pairs that a task holds at once before it sends them.
    """
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // share))
    spread = np.uint64(-(-blocks // 8))

    def block(word: np.ndarray, before: np.ndarray) -> np.ndarray:
        return ((word % np.uint64(blocks) + (before >> np.uint64(32)) % spread) % np.uint64(blocks)).astype(np.int32)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _Pairs()

        def out() -> pa.RecordBatch:
            words, word, before, bits, at = pairs.distinct(block)
            cuts = np.append(_firsts(at), len(at)).tolist()
            return pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]]), pa.array([_pack(words, word[x:y], before[x:y], bits[x:y]) for x, y in zip(cuts, cuts[1:])], pa.list_(pa.binary()))], names=["block", "packed"])

        for batch in batches:
            for lo, hi, raw, offs in K.each_group(batch.column(0)):
                folded, bits = K.FOLD[raw], np.left_shift(1, batch.column(1).slice(lo, hi - lo).to_numpy()).astype(np.uint8)
                whole = [blake2b(folded[x:y], digest_size=8).digest() for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
                pairs.add(pa.array([b""], pa.binary()), np.zeros(len(whole), np.int32), np.frombuffer(b"".join(whole), np.uint64), bits)
                last = np.uint64(0)
                for part, edges in _pieces(raw, offs):
                    found, toks = _words(part, edges)
                    word, n = found.indices.to_numpy().astype(np.int64), len(found.dictionary)
                    if not n:
                        continue
                    before = np.append(n, word[:-1])
                    before[toks[:-1][np.diff(toks) > 0]] = n
                    each = np.unique((word * (n + 1) + before) * 256 + np.repeat(bits, np.diff(toks)))
                    hashes = np.append(_hashes(found.dictionary), last)
                    pair = each >> 8
                    pairs.add(found.dictionary, pair // (n + 1), hashes[pair % (n + 1)], each & 255)
                    last = hashes[word[-1]]
                    if pairs.n >= most:
                        yield out()
        if pairs.n:
            yield out()

    def add(table: pa.Table) -> pa.Table:
        pairs = _Pairs()
        for packed in table.column("packed").to_pylist():
            pairs.add(*_unpack(packed))
        words, word, _, bits, _ = pairs.distinct()
        return pa.table([words, *(pa.array(np.bincount(word[bits & b > 0], minlength=len(words))) for b in BITS.values())], names=["word", *BITS])

    pairs = rows.select("text", (F.col("flag") * 2 + F.col("half")).cast("int").alias("class")).mapInArrow(send, "block int, packed array<binary>")
    summed = pairs.groupBy("block").applyInArrow(add, f"word binary, {', '.join(f'{c} long' for c in BITS)}")
    return summed.groupBy("word").agg(*(F.sum(c).alias(c) for c in BITS))


def trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """The dictionary that zstandard makes of the samples. From too few to train on it has their words, the most frequent last."""
    samples = [x for x in samples if len(x) > 8]
    try:
        made = zs.train_dictionary(size, samples, k=segment, d=PIECE).as_bytes()
        return b"".join(_WHOLE.findall(made))  # without its tables and the words that its segments cut
    except zs.ZstdError:
        words = Counter(w for x in samples for w in x.split(_END) if w)
        return b"".join(w + _END for w, _ in sorted(words.items(), key=lambda c: (c[1], c[0])))[-size:]


def drawn(words: list[bytes], times: list[int], piece: int) -> list[bytes]:
    """Texts of ``piece`` bytes that have the words in proportion to their times, in an order that is always the same."""
    n, size = np.array(times, float), np.array([len(w) + 2 for w in words], np.int64)
    whole = np.maximum(1, np.rint(n * min(1.0, TEXT_BYTES / max(1.0, float((n * size).sum()))))).astype(np.int64)
    order = np.random.default_rng(0).permutation(np.repeat(np.arange(len(words)), whole))
    text = b"".join(b" " + words[i] + _END for i in order.tolist())
    return [text[i : i + piece] for i in range(0, len(text), piece)]


def _joined(df: DataFrame, other: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """The join, by broadcast of what is joined if its counted size allows."""
    return df.join(F.broadcast(other) if other.count() * 64 <= BROADCAST_BYTES else other, on, how)


def dictionaries(rows: DataFrame, toxic_bytes: int = TOXIC_BYTES, ordinary_bytes: int = ORDINARY_BYTES) -> list[tuple[bytes, bytes]]:
    """(ordinary, toxic) dictionary contents for each of ``FITS`` from all rows (text, flag, half); the two are the same if nothing stands out."""
    every = cut(counts(rows))
    words = every.where("word != X''")
    total, texts_of = (x.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in BITS)).first() for x in (words, every.where("word = X''")))
    least = [max(3, min(12, texts_of[f"t{f}"] // 20)) for f in range(len(FITS))]

    beginnings = words.withColumn("g", F.expr(f"explode(transform(sequence(least({SHORT}, length(word) + 2), least(length(word) + 2, {LONG})), n -> substring(concat(X'20', word, X'20'), 1, n)))"))
    enough = beginnings.where("t2 > 0").groupBy("g").agg(*(F.sum(f"t{f}").alias(f"t{f}") for f in range(len(FITS)))).where(" or ".join(f"t{f} >= {n}" for f, n in enumerate(least))).select("g")
    strong = _joined(beginnings, enough, "g").groupBy("g").agg(*(F.sum(c).alias(c) for c in BITS))
    strong = strong.select("g", *(((F.col(f"t{f}") >= n) & (F.col(f"t{f}") / max(1, total[f"t{f}"]) > CONTRAST * (F.col(f"o{f}") + 0.5) / max(1, total[f"o{f}"]))).alias(f"loud{f}") for f, n in enumerate(least)))
    strong = cut(strong.where("loud0 or loud1 or loud2"))
    loud = _joined(beginnings, strong, "g").groupBy("word").agg(*(F.max(f"loud{f}").alias(f"loud{f}") for f in range(len(FITS))))
    marked = cut(words.join(loud, "word", "left"))

    def offered(kind: str, f: int, size: int, piece: int) -> list[bytes]:
        mine = marked.where((F.coalesce(f"loud{f}", F.lit(False)) == (kind == "t")) & (F.col(f"{kind}{f}") > 0)).select("word", F.col(f"{kind}{f}").alias("times"))
        best = mine.orderBy(F.desc("times"), "word").limit(OFFERED * size // 3).toArrow().to_pydict()  # a word has three bytes at least
        n = int(np.searchsorted(np.cumsum([len(w) + 2 for w in best["word"]]), OFFERED * size, "right"))
        return drawn(best["word"][:n], best["times"][:n], piece)

    made = []
    for f in range(len(FITS)):
        base = trained(offered("o", f, ordinary_bytes, SAMPLE), ordinary_bytes, ORDINARY_SEGMENT)
        made.append((base + _FILL, trained(offered("t", f, toxic_bytes, TOXIC_SAMPLE), toxic_bytes, TOXIC_SEGMENT) + base + _FILL))
    forget(every, strong, marked)
    return made


def compressors(ordinary: bytes, toxic: bytes) -> tuple[zs.ZstdCompressor, zs.ZstdCompressor]:
    p = zs.ZstdCompressionParameters(strategy=zs.STRATEGY_GREEDY, min_match=5, target_length=1, hash_log=18, chain_log=16, search_log=4, window_log=18, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = []
    for content in (ordinary, toxic):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=p)
        made.append(zs.ZstdCompressor(dict_data=d, compression_params=p))
    return made[0], made[1]


def score(folded: bytes, ordinary: zs.ZstdCompressor, toxic: zs.ZstdCompressor) -> tuple[float, int, int, float]:
    """(score, windows, best saving of a window, best run) of a text; windows overlap so that no word is cut in all of them."""
    if not folded:
        return 0.0, 0, 0, 0.0
    text = b" " + folded + b" "
    a, b = ordinary.compress, toxic.compress
    gains = []
    for i in range(0, len(text), WINDOW):
        part = _FILL + text[i : i + WINDOW + OVERLAP]
        gains.append(max(0, len(a(part)) - len(b(part))))
    saved, windows = sum(gains), len(gains)
    if not saved:
        return 0.0, windows, 0, 0.0
    ends, best, n = np.concatenate([[0], np.cumsum(gains)]), 0.0, 1
    while n <= windows:
        best = max(best, float((ends[n:] - ends[:-n]).max()) / math.sqrt(n))
        n *= 2
    return saved / math.sqrt(windows), windows, max(gains), best


def fold(text: str | None) -> bytes:
    return K.FOLD[np.frombuffer((text or "").encode(), np.uint8)].tobytes()


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "toxic") -> DataFrame:
    """(text, flag, half) of every row with a label. The labels are broadcast if their counted size allows; else they are joined."""
    given = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{flag_col}`").cast("int").alias("flag")).where("flag in (0, 1) and doc_id is not null")
    given = given.groupBy("doc_id").agg(F.max("flag").alias("flag"))
    rows = _joined(texts(docs, id_col, text_col).where("text is not null"), given, "doc_id")
    return rows.select("text", "flag", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"))


def thresholds(rows: DataFrame, halves: list[tuple[bytes, bytes]]) -> tuple[float, float]:
    """Bars for the score and the best run that at most ``FALSE_RATE`` of all clean rows exceed, each scored with the dictionaries of the half that it isn't in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [compressors(*x) for x in halves]
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(0)):
                folded, half = K.FOLD[raw].tobytes(), b.column(1).slice(lo, hi - lo).to_pylist()
                found = [score(folded[x:y], *pairs[1 - h]) for x, y, h in zip(offs[:-1].tolist(), offs[1:].tolist(), half)]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found]), pa.array([x[3] for x in found])], names=["score", "run"])

    clean = cut(rows.where("flag = 0").select("text", "half").mapInArrow(run, "score double, run double"))
    n = clean.count()

    def bar(name: str) -> float:
        at = clean.orderBy(F.desc(name)).limit(int(n * FALSE_RATE) + 1).agg(F.min(name)).first()[0]
        return max(LEAST, round((at or 0.0) + 0.01, 6))

    found = bar("score"), bar("run")
    forget(clean)
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "toxic") -> Model:
    """Dictionaries and thresholds from every labelled row."""
    rows = labelled(docs, labels, id_col, text_col, flag_col)
    *halves, (ordinary, toxic) = dictionaries(rows)
    if len(toxic) == len(ordinary):
        return Model(ordinary, toxic, math.inf)
    return Model(ordinary, toxic, *thresholds(rows, halves))


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, windows, most, toxic) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = compressors(model.ordinary, model.toxic)
        for b in batches:
            for lo, hi, raw, offs in K.each_group(b.column(1)):
                folded = K.FOLD[raw].tobytes()
                found = [score(folded[x:y], *pair) for x, y in zip(offs[:-1].tolist(), offs[1:].tolist())]
                s = np.array([x[0] for x in found])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.round(s, 6)), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int32()), pa.array((s >= model.threshold) | (np.array([x[3] for x in found]) >= model.run))], names=["doc_id", "score", "windows", "most", "toxic"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, windows int, most int, toxic boolean")


def toxic_documents(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``scan`` that are toxic."""
    return scan(docs, fit(docs, labels, **how)).where("toxic")
