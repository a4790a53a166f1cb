"""Secret scan with a linear-chain conditional random field.

A line is a chain of tokens: runs of letters, digits and the signs _ - + / & ! # $ % ^ * ~, between which
other bytes separate. Each token is tagged O (outside), B (begins a secret) or I (goes on with
it). Its features are the kinds of characters it has, its length, how often kinds
change in it, its shares of digits and of hexadecimal digits, the cue among the two
words before it (token, password, key ...), the separators on either side, its place
after an equals sign or colon, and features of the file: whether it has
assignments at all, whether it has a private key's frame, and its length. Tags are decoded by Viterbi, over whole lines of
whole texts, with all lines of a batch side by side; a line of over ``LONG`` tokens is decoded in blocks, for each
tag that may stand before the block, which gives the same path in time in proportion to its length. The weights are trained by
forward-backward on lines made from a bounded sample of the corpus: the corpus's own
lines with what looks like a credential taken out, and secrets of known forms planted
in them by a seeded generator (hexadecimal, prefixed and base64 keys, dotted tokens, passwords short and long,
passwords in addresses, private keys), next to decoys (card and telephone numbers, mail
addresses, plain words after a cue).

Bounds of the training set, all parameters: ``FIT_ROWS`` documents, those with the smallest hashes of doc_id, of each the first
``FIT_LINES`` - 1 lines and the last, ``FIT_CHARS`` characters of each and ``FIT_WORDS`` words of these. The scan itself reads whole texts.

Defined results. A null or empty text has no secret. Each line of a private key is a secret of its own. Of paths that score alike
the one with the first tag by the order above wins. Offsets count characters. Rows without an id have their secrets without one.
Repeated rows repeat their secrets. An empty table has none. Only the named columns are read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import kernel as K
from quillgraph.llm.common import texts

#: Documents that lines are taken from to train on, at most, and lines of each.
FIT_ROWS, FIT_LINES, FIT_CHARS, FIT_WORDS, STEPS, RATE, DECAY = 800, 2, 400, 60, 120, 0.12, 1e-4
#: Tokens that features are made of at once, and tokens of a line that is decoded in blocks.
PART, LONG = 1 << 17, 4096
TAGS = ("O", "B", "I")
_TOKEN = K.WORD | np.isin(np.arange(256), np.frombuffer(b"_-+/&!#$%^*~", np.uint8))
_CUES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "api_key", "api-key", "auth", "bearer", "access_key", "secret_key", "private_key", "credential", "credentials", "access_token", "client_secret", "auth_token", "pass")
_HEX = K.DIGIT | np.isin(np.arange(256), np.frombuffer(b"abcdefABCDEF", np.uint8))
_KIND = np.where(K.UPPER, 1, np.where(K.LOWERCASE | K.HIGH, 2, np.where(K.DIGIT, 3, 0))).astype(np.int8)
#: Values of each feature, in the order of ``featurise``.
SIZES = (16, 8, 6, 5, 3, 3, 8, 6, 6, 4, 4, 3, 24)


class Model(NamedTuple):
    emit: tuple[np.ndarray, ...]
    move: np.ndarray
    start: np.ndarray


def _cue_hashes() -> np.ndarray:
    raw, offs = K.buffers(pa.array(list(_CUES)))
    return np.sort(K.hashes(raw, offs[:-1], offs[1:]))


def tokenise(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, tokens before each document, tokens before each line) of a group; lines without a token are left out."""
    s, e, toks = K.spans(raw, offs, _TOKEN)
    if not len(s):
        return s, e, toks, np.zeros(1, np.int64)
    line = np.searchsorted(np.flatnonzero(raw == 10), s)
    head = np.concatenate([[True], line[1:] != line[:-1]])
    del line
    head[toks[:-1][np.diff(toks) > 0]] = True
    return s, e, toks, np.append(np.flatnonzero(head), len(s))


def _count(flag: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=c[1:])
    return c[e] - c[s]


def files(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(1 for an assignment, 2 for the frame of a private key, 3 for both; bytes) of every document."""
    equals = np.diff(np.searchsorted(np.flatnonzero(raw == 61), offs)) > 0
    framed = np.zeros(len(offs) - 1, np.int64)
    for m in re.finditer(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", raw):
        framed[np.searchsorted(offs, m.start(), "right") - 1] = 2
    return equals + framed, np.diff(offs)


def featurise(raw: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray, toks: np.ndarray, lines: np.ndarray, of_files: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """One array of small numbers for each feature of ``SIZES``. offs: where documents begin and end; raw may hold less than whole ones."""
    n = len(s)
    size = e - s
    kind = _KIND[raw]
    up, low, dig = (_count(kind == k, s, e) for k in (1, 2, 3))
    other = size - up - low - dig
    turn = np.zeros(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turns = _count(turn, np.minimum(s + 1, e), e)
    hexa = _count(_HEX[raw], s, e)
    mix = (up > 0) * 1 + (low > 0) * 2 + (dig > 0) * 4 + (other > 0) * 8
    length = np.searchsorted([4, 8, 12, 16, 20, 28, 40], size, "right")
    change = np.searchsorted([1, 2, 4, 8, 14], turns, "right")
    digits = np.minimum(dig * 5 // np.maximum(size, 1), 4)
    allhex = np.where(hexa < size, 0, np.where(size >= 16, 2, 1))
    dense = np.where(turns * 8 >= size, 1, 0) + (turns * 3 >= size)
    place = np.arange(n) - np.repeat(lines[:-1], np.diff(lines))
    cue = np.isin(K.hashes(raw, s, e), _cue_hashes())
    back1, back2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
    back1[1:], back2[2:] = cue[:-1], cue[:-2]
    cues = np.where(place > 0, back1, 0) + 2 * np.where(place > 1, back2, 0) + 4 * cue
    # what stands before and after: 0 line or text edge, 1 blank, 2 quote, 3 equals, 4 colon, 5 other
    code = np.full(256, 5)
    code[[32, 9, 13]], code[10], code[[34, 39, 96]], code[61], code[58] = 1, 0, 2, 3, 4
    before = np.where(np.isin(s, offs), 0, code[raw[np.maximum(s - 1, 0)]])
    after = np.where(np.isin(e, offs), 0, code[raw[np.minimum(e, len(raw) - 1)]])
    # an assignment between this token and the one before: none, equals or colon, with a quote as well
    gap_a, gap_z = np.concatenate([[0], e[:-1]]), s
    gap_a = np.where(place > 0, gap_a, s)
    assign = _count((raw == 61) | (raw == 58), gap_a, gap_z) > 0
    quote = _count((raw == 34) | (raw == 39), gap_a, gap_z) > 0
    sep = assign * 1 + quote * 2
    doc = np.repeat(np.arange(len(toks) - 1), np.diff(toks))
    kind_of_file, long_file = of_files[0], np.searchsorted([500, 5000], of_files[1], "right")
    shape = np.minimum(allhex, 2) * 8 + sep * 2 + (cues & 3 > 0)  # the conjunction that tells most
    return [mix, length, change, digits, allhex, dense, cues, before, after, sep, kind_of_file[doc], long_file[doc], shape]


def emissions(f: list[np.ndarray], emit: tuple[np.ndarray, ...]) -> np.ndarray:
    """Scores by token and tag."""
    out = np.zeros((len(f[0]), 3), np.float32)
    for x, w in zip(f, emit):
        out += w.astype(np.float32)[x]
    return out


def scored(raw: np.ndarray, offs: np.ndarray, s: np.ndarray, e: np.ndarray, toks: np.ndarray, lines: np.ndarray, m: Model) -> np.ndarray:
    """Scores by token and tag of a group. A long document, which is a group of its own, goes in parts: a token looks back over two others."""
    about = files(raw, offs)
    if len(s) <= PART or len(offs) > 2:
        return emissions(featurise(raw, offs, s, e, toks, lines, about), m.emit)
    out = np.empty((len(s), 3), np.float32)
    for i in range(0, len(s), PART):
        k, j = max(0, i - 2), min(i + PART, len(s))
        lo, hi = max(0, int(s[k]) - 1), min(len(raw), int(e[j - 1]) + 1)
        cuts = np.concatenate([[k], lines[np.searchsorted(lines, k, "right") : np.searchsorted(lines, j, "left")], [j]]) - k
        out[i:j] = emissions(featurise(raw[lo:hi], offs - lo, s[k:j] - lo, e[k:j] - lo, np.array([0, j - k]), cuts, about), m.emit)[i - k :]
    return out


def _in_blocks(score: np.ndarray, move: np.ndarray, start: np.ndarray, block: int = 1024) -> np.ndarray:
    """Best tags of one line. Every block of moves is solved for each tag before it, all blocks side by side; then the blocks are joined."""
    n = len(score) - 1  # moves
    blocks = max(1, -(-n // block))
    steps = np.zeros((blocks * block, 3))
    steps[:n] = score[1:]
    steps = steps.reshape(blocks, block, 3)
    none = np.where(np.eye(3, dtype=bool), 0.0, -np.inf)  # a move that isn't there
    best = np.broadcast_to(none, (blocks, 3, 3)).copy()  # block, tag before it, tag so far
    back = np.empty((block, blocks, 3, 3), np.int8)
    left = n - (blocks - 1) * block  # moves of the last block
    for t in range(block):
        every = best[:, :, :, None] + (move + steps[:, t, None, :])[:, None]
        if t >= left:
            every[-1] = best[-1][:, :, None] + none
        back[t] = every.argmax(axis=2)
        best = every.max(axis=2)
    v, came = start + score[0].astype(np.float64), np.empty((blocks, 3), np.int8)
    for b in range(blocks):
        every = v[:, None] + best[b]
        came[b] = every.argmax(axis=0)
        v = every.max(axis=0)
    leave, enter = np.empty(blocks, np.int64), np.empty(blocks, np.int64)
    tag = int(v.argmax())
    for b in range(blocks - 1, -1, -1):
        leave[b], tag = tag, int(came[b, tag])
        enter[b] = tag
    out = np.empty((block, blocks), np.int8)
    at = np.arange(blocks)
    for t in range(block - 1, -1, -1):
        out[t] = leave
        leave = back[t][at, enter, leave].astype(np.int64)
    return np.concatenate([enter[:1].astype(np.int8), out.T.ravel()[:n]])


def viterbi(score: np.ndarray, lines: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best tag of each token; all lines advance together, the longest first, so those that have ended drop off the end."""
    size = np.diff(lines)
    out = np.zeros(len(score), np.int8)
    for k in np.flatnonzero(size > LONG).tolist():
        out[lines[k] : lines[k + 1]] = _in_blocks(score[lines[k] : lines[k + 1]], move, start)
    by = np.argsort(-size, kind="stable")
    by = by[size[by] <= LONG]
    first, size = lines[:-1][by], size[by]
    if not len(size):
        return out
    back = np.zeros((len(score), 3), np.int8)
    live = np.searchsorted(-size, -np.arange(size[0]), "left")  # lines of more than k tokens
    v = score[first] + start.astype(np.float32)
    final = np.zeros((len(size), 3), np.float32)
    final[:] = v
    m = move.astype(np.float32)
    for k in range(1, int(size[0])):
        n = live[k]
        v = v[:n]
        at = first[:n] + k
        new = np.empty((n, 3), np.float32)
        for tag in range(3):
            c0, c1, c2 = v[:, 0] + m[0, tag], v[:, 1] + m[1, tag], v[:, 2] + m[2, tag]
            best = np.maximum(np.maximum(c0, c1), c2)
            back[at, tag] = np.where(best == c0, 0, np.where(best == c1, 1, 2))
            new[:, tag] = best
        v = new + score[at]
        final[:n] = v
    tag = final.argmax(axis=1).astype(np.int8)
    for k in range(int(size[0]) - 1, -1, -1):
        n = live[k]
        at = first[:n] + k
        out[at] = tag[:n]
        if k:
            tag[:n] = back[at, tag[:n]]
    return out


def quick(score: np.ndarray, lines: np.ndarray, m: Model) -> np.ndarray:
    """The same tags as ``viterbi``. A line in which no token can be anything but O is settled beforehand: even with the best moves to and from, its other tags stay below O."""
    gain = np.maximum(score[:, 1], score[:, 2]) - score[:, 0]
    # most that a path can win by moves around one token that isn't O
    most = 2 * float(m.move.max() - m.move[0, 0]) + max(0.0, float(m.start.max() - m.start[0]))
    open_ = np.maximum.reduceat(gain, lines[:-1]) + max(0.0, most) >= 0 if len(gain) else np.zeros(0, bool)
    out = np.zeros(len(score), np.int8)
    pick = np.flatnonzero(open_)
    if len(pick):
        size = np.diff(lines)[pick]
        at = np.concatenate([[0], np.cumsum(size)])
        rows = np.arange(at[-1]) - np.repeat(at[:-1], size) + np.repeat(lines[pick], size)
        out[rows] = viterbi(score[rows], at, m.move, m.start)
    return out


def tagged(raw: np.ndarray, offs: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first byte, last byte + 1 in the group) of every secret: a B and the I that follow it; an I alone begins one too."""
    s, e, toks, lines = tokenise(raw, offs)
    if not len(s):
        return s, s, s
    tags = quick(scored(raw, offs, s, e, toks, lines, m), lines, m)
    hit = np.flatnonzero(tags)
    begins = np.ones(len(hit), bool)
    begins[1:] = (tags[hit[1:]] != 2) | (hit[1:] != hit[:-1] + 1) | (lines[np.searchsorted(lines, hit[1:])] == hit[1:])
    first = np.flatnonzero(begins)
    last = np.append(first[1:], len(hit)) - 1 if len(first) else first
    return np.searchsorted(offs, s[hit[first]], "right") - 1, s[hit[first]], e[hit[last]]


# training


def _batched(score: np.ndarray, real: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tag marginals, expected moves, log partition by line) of padded lines (line, place, tag) by forward-backward, all lines at once."""
    b, t, _ = score.shape
    al, be = np.zeros((b, t, 3)), np.zeros((b, t, 3))
    al[:, 0] = start + score[:, 0]
    for k in range(1, t):
        x = al[:, k - 1, :, None] + move
        top = x.max(axis=1)
        new = top + np.log(np.exp(x - top[:, None]).sum(axis=1)) + score[:, k]
        al[:, k] = np.where(real[:, k, None], new, al[:, k - 1])
    for k in range(t - 2, -1, -1):
        x = move + (score[:, k + 1] + be[:, k + 1])[:, None, :]
        top = x.max(axis=2)
        new = top + np.log(np.exp(x - top[..., None]).sum(axis=2))
        be[:, k] = np.where(real[:, k + 1, None], new, 0.0)
    top = al[:, -1].max(axis=1)
    z = top + np.log(np.exp(al[:, -1] - top[:, None]).sum(axis=1))
    both = al[:, :-1, :, None] + move + (score[:, 1:] + be[:, 1:])[:, :, None, :] - z[:, None, None, None]
    moves = (np.exp(np.minimum(both, 0)) * real[:, 1:, None, None]).sum(axis=(0, 1))
    return np.exp(np.minimum(al + be - z[:, None, None], 0)) * real[:, :, None], moves, z


def train(lines: list[tuple[str, list[tuple[int, int]]]], steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> Model:
    """Weights from texts of one line and the byte spans of their secrets, by Adam on the whole set."""
    lines = [x for x in lines if x[0]]
    raw, offs = K.buffers(pa.array([t for t, _ in lines], pa.large_string()))
    s, e, toks, starts = tokenise(raw, offs)
    f = featurise(raw, offs, s, e, toks, starts, files(raw, offs))
    gold = np.zeros(len(s), np.int64)
    for d, (_, spans) in enumerate(lines):
        for lo, hi in spans:
            k = np.flatnonzero((s >= offs[d] + lo) & (e <= offs[d] + hi)) if hi > lo else np.zeros(0, int)
            gold[k] = 2
            gold[k[:1]] = 1
    size = np.diff(starts)
    place = np.arange(len(s)) - np.repeat(starts[:-1], size)
    # lines of about the same length go side by side, padded to the longest of them
    parts = []
    for some in np.array_split(np.argsort(size, kind="stable"), min(12, len(size))):
        rows = np.arange(size[some].sum()) - np.repeat(np.cumsum(size[some]) - size[some], size[some]) + np.repeat(starts[:-1][some], size[some])
        parts.append((rows, np.repeat(np.arange(len(some)), size[some]), place[rows], np.arange(size[some].max()) < size[some][:, None]))
    inner = np.flatnonzero(place > 0)
    seen = np.zeros((3, 3))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1)
    began = np.bincount(gold[starts[:-1]], minlength=3)
    params = [*(np.zeros((n, 3)) for n in SIZES), np.zeros((3, 3)), np.zeros(3)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for k in range(1, steps + 1):
        score = np.zeros((len(s), 3))
        for x, w in zip(f, params):
            score += w[x]
        miss, moves = np.empty((len(s), 3)), np.zeros((3, 3))
        for rows, line, at, real in parts:
            padded = np.zeros((*real.shape, 3))
            padded[line, at] = score[rows]
            marginal, m, _ = _batched(padded, real, params[-2], params[-1])
            miss[rows] = marginal[line, at]
            moves += m
        first = miss[starts[:-1]].sum(axis=0)
        miss[np.arange(len(s)), gold] -= 1
        grads = [np.stack([np.bincount(x, miss[:, g], n) for g in range(3)], axis=1) for x, n in zip(f, SIZES)]
        grads += [moves - seen, first - began]
        for q, g, a, b in zip(params, grads, m1, m2):
            g = g / len(size) + decay * q
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            q -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.999**k)) + 1e-8)
    return Model(tuple(params[: len(SIZES)]), params[-2], params[-1])


_SUSPECT = re.compile(r"[A-Za-z0-9+/_=\-]*[0-9][A-Za-z0-9+/_=\-]{11,}|[A-Za-z0-9+/_=\-]{11,}[0-9][A-Za-z0-9+/_=\-]*")
_ALPHA = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def planted(lines: list[str], seed: int = 0, fit_words: int = FIT_WORDS) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with secrets and decoys put in at a word boundary, and the byte spans of the secrets."""
    rng = np.random.default_rng(seed)

    def some(chars: str, lo: int, hi: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), rng.integers(lo, hi + 1)))

    def secret() -> str:
        return [
            lambda: some("0123456789abcdef", 32, 32), lambda: some("0123456789abcdef", 40, 40), lambda: some("0123456789abcdef", 64, 64), lambda: "AKIA" + some(_ALPHA[:26] + "0123456789", 16, 16),
            lambda: "ghp_" + some(_ALPHA, 36, 36), lambda: "sk-" + some(_ALPHA, 32, 48), lambda: "xoxb-" + some("0123456789", 11, 12) + "-" + some(_ALPHA, 24, 24),
            lambda: base64.b64encode(rng.bytes(int(rng.integers(15, 33)))).decode().rstrip("="), lambda: some(_ALPHA + "_-+", 14, 24),
            lambda: ".".join(base64.urlsafe_b64encode(rng.bytes(int(rng.integers(15, 40)))).decode().rstrip("=") for _ in range(3)),
        ][rng.integers(0, 10)]()

    def password() -> str:
        if rng.random() < 0.5:
            return some(_ALPHA[26:52], 4, 9) + some("0123456789", 1, 4)
        return some(_ALPHA[:52], 1, 1) + some(_ALPHA + "!#$%&*^~", 6, 14) + some("0123456789", 1, 1) + some("!#$%&*x", 0, 1)

    def assigned(value: str) -> tuple[str, str, str]:
        cue = _CUES[rng.integers(0, len(_CUES))] if rng.random() < 0.8 else ["password", "passwd", "pwd", "pass"][rng.integers(0, 4)]
        cue = cue.upper() if rng.random() < 0.2 else cue
        link = [" = ", "=", ": ", ":", " "][rng.integers(0, 5)]
        quote = ['"', "'", ""][rng.integers(0, 3)]
        return cue + link + quote, value, quote

    out: list[tuple[str, list[tuple[int, int]]]] = []
    for text in lines:
        words = _SUSPECT.sub(" ", text).split(" ")[:fit_words]
        spans: list[tuple[int, int]] = []
        at = int(rng.integers(0, len(words) + 1))
        kind = rng.random()
        if kind < 0.45:
            form = rng.random()
            if form < 0.06:  # a private key: lines of base64 between those of its frame
                body = [base64.b64encode(rng.bytes(48)).decode() for _ in range(int(rng.integers(2, 6)))] + [base64.b64encode(rng.bytes(int(rng.integers(12, 40)))).decode()]
                name = ["RSA ", "EC ", "OPENSSH ", ""][rng.integers(0, 4)]
                text = " ".join(words) + f"\n-----BEGIN {name}PRIVATE KEY-----\n"
                for x in body:
                    n = len(text.encode())
                    spans.append((n, n + len(x)))
                    text += x + "\n"
                out.append((text + f"-----END {name}PRIVATE KEY-----\n", spans))
                continue
            if form < 0.12:  # a password in an address
                a, v, z = ["https", "postgres", "mysql", "ftp", "redis"][rng.integers(0, 5)] + "://" + some(_ALPHA[26:52], 3, 8) + ":", password().replace("#", "x"), "@" + some(_ALPHA[26:52], 3, 8) + ".example.com/" + some(_ALPHA[26:52], 2, 6)
            elif form < 0.27:
                a, v, z = assigned(password())
            elif form < 0.87:
                a, v, z = assigned(secret())
            else:
                a, v, z = "", secret(), ""
            left = " ".join(words[:at] + [""]) if at else ""
            n = len((left + a).encode())
            spans.append((n, n + len(v)))
            out.append((left + a + v + z + " " + " ".join(words[at:]), spans))
            continue
        plain = words[int(rng.integers(0, len(words)))] or "none"
        decoy = [
            "", " ".join(assigned(plain)), some("0123456789", 12, 19), "+" + some("0123456789", 9, 13), f"{plain}.{some('0123456789', 2, 3)}@mail.example.com", "https://example.com/" + plain + "/" + some("0123456789", 3, 6),
            f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}", plain.upper() + "!! " + plain.upper() + "!!", plain * 5, f"{some('0123456789', 3, 3)}-{some('0123456789', 2, 2)}-{some('0123456789', 4, 4)}",
        ][rng.integers(0, 10)]
        out.append((" ".join([*words[:at], decoy, *words[at:]]), spans))
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS, fit_lines: int = FIT_LINES, fit_chars: int = FIT_CHARS, fit_words: int = FIT_WORDS) -> Model:
    """Trained on lines of the documents with the smallest hashes of doc_id; without text, on lines of its own."""
    rows = texts(docs, id_col, text_col).where("doc_id is not null and text <> ''")
    chosen = [r["doc_id"] for r in rows.select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().orderBy("h", "doc_id").limit(fit_rows).collect()]
    wanted = docs.sparkSession.createDataFrame([(i,) for i in chosen] or [(-1,)], "doc_id long")
    some = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    line = rows.join(F.broadcast(wanted), "doc_id").select("doc_id", F.array_union(F.slice(some, 1, fit_lines - 1), F.slice(F.reverse(some), 1, 1)).alias("l"))
    got = line.select("doc_id", F.posexplode("l").alias("k", "t")).select("doc_id", "k", F.substring("t", 1, fit_chars).alias("t")).groupBy("doc_id", "k").agg(F.min("t").alias("t")).collect()  # fit_rows * fit_lines rows at most
    lines = [r["t"] for r in sorted(got, key=lambda r: (r["doc_id"], r["t"]))] or ["a line of plain words without more"] * 200
    if len(lines) < 400:
        lines = (lines * (1 + 400 // len(lines)))[:400]
    return train(planted(lines, fit_words=fit_words))


def scan(docs: DataFrame, m: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, secret) of every secret."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, raw, offs in K.each_group(b.column(1)):
                d, first, last = tagged(raw, offs, m)
                if len(d):
                    at = K.chars(raw, np.concatenate([offs[d], first, last])).reshape(3, -1)
                    made = [raw[a:z].tobytes().decode() for a, z in zip(first.tolist(), last.tolist())]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(lo + d)), *(pa.array((at[k] - at[0]).astype(np.int32)) for k in (1, 2)), pa.array(made, pa.string())], names=["doc_id", "start", "end", "secret"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start int, `end` int, secret string")


def secrets(docs: DataFrame, **how) -> DataFrame:
    cols = {k: v for k, v in how.items() if k in ("id_col", "text_col")}
    return scan(docs, fit(docs, **how), **cols)
