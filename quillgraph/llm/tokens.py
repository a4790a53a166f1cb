"""Token counts by offset-mapped attribution.

Every document is encoded once, as a whole. The encoding is lossless over bytes,
so the lengths of the tokens give the span of each. The sections of a document
are its lines, each with the newline that ends it; a newline at the very end
opens no further section. Token spans are interval-joined to sections by binary
search over the boundaries.

Allocation rule. A token inside one section counts there. A token that crosses
boundaries counts whole in the section that holds most of its bytes, and in the
earliest of those that hold equally many; it is also counted as crossing there.
So the tokens of a document's sections add up to those of the document.

Defined results. A null or empty text is one empty section of no tokens. Rows
without an id have sections without one. Repeated rows each have their sections. A
text is encoded whole however long it is. An empty table has no sections. Offsets
count characters. Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from quillgraph.llm import kernel as K
from quillgraph.llm.common import texts

#: Ranks of a public byte-level vocabulary: a base64 token and its id a line.
VOCABULARY = os.environ.get("QUILLGRAPH_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space of the pattern, in runs that are too long for its engine's stack.
_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")
COLUMNS = "doc_id long, section int, start int, `end` int, tokens int, crossing int"

_loaded: dict[tuple[str, str], tuple[tiktoken.Encoding, np.ndarray]] = {}


def encoder(vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> tuple[tiktoken.Encoding, np.ndarray]:
    """(encoding, bytes of each token); kept by process."""
    if (vocabulary, pattern) not in _loaded:
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in (x.split() for x in f if x.strip())}
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            size[i] = len(t)
        _loaded[vocabulary, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size
    return _loaded[vocabulary, pattern]


def encode(text: str, enc: tiktoken.Encoding, pattern: str = PATTERN) -> list[int]:
    """The tokens of a whole text. The pattern takes a run of white space up to its last character as one piece, or to the end
    of the text; where such a run would overflow the stack of the pattern's engine, that piece is handed to the encoder as it is."""
    if len(text) < 100_000 or pattern != PATTERN:
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[at : m.start()])
        out += enc._encode_single_piece(text[m.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:]) if at else enc.encode_ordinary(text)


def attribute(raw: np.ndarray, offs: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, section, first byte, last byte + 1, tokens, crossing) of all sections of a group; sizes: bytes of all its tokens."""
    docs = len(offs) - 1
    line = np.flatnonzero(raw == 10) + 1
    line = line[~np.isin(line, offs)]
    first = np.concatenate([offs[:-1], line])
    doc = np.concatenate([np.arange(docs), np.searchsorted(offs, line, "right") - 1])
    by = np.lexsort((first, doc))
    first, doc = first[by], doc[by]
    last = np.append(first[1:], offs[-1])
    base = np.searchsorted(doc, np.arange(docs))
    # boundaries that token positions are looked up in must not hold empty documents twice
    full = np.flatnonzero(last > first)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    a = np.searchsorted(first[full], starts, "right") - 1
    z = np.searchsorted(first[full], ends - 1, "right") - 1
    over = np.flatnonzero(a != z)
    for t in over.tolist():
        k = np.arange(a[t], z[t] + 1)
        a[t] = k[np.argmax(np.minimum(last[full[k]], ends[t]) - np.maximum(first[full[k]], starts[t]))]
    count = np.bincount(full[a], minlength=len(first)) if len(a) else np.zeros(len(first), np.int64)
    crossing = np.bincount(full[a[over]], minlength=len(first)) if len(over) else np.zeros(len(first), np.int64)
    return doc, np.arange(len(first)) - base[doc], first, last, count, crossing


def sections(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, start, end, tokens, crossing) of every section of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, size = encoder(vocabulary, pattern)
        for b in batches:
            column = b.column(1).fill_null("")
            for lo, hi, raw, offs in K.each_group(column):
                ids = [encode(t, enc, pattern) for t in column.slice(lo, hi - lo).to_pylist()]
                flat = np.fromiter(chain.from_iterable(ids), np.int64, sum(map(len, ids)))
                doc, section, first, last, count, crossing = attribute(raw, offs, size[flat])
                c = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(doc)), *(pa.array(x.astype(np.int32)) for x in (section, c[first] - c[offs[doc]], c[last] - c[offs[doc]], count, crossing))], names=["doc_id", "section", "start", "end", "tokens", "crossing"])

    return texts(docs, id_col, text_col).mapInArrow(run, COLUMNS)
