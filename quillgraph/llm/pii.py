"""Personal data by anchor expansion.

One Aho-Corasick automaton finds every anchor of a text in one pass: at-signs,
URL schemes, plus signs, digits, IBAN countries and, in any case, cue words of
telephone, card, account, routing and social security numbers. At each anchor a deterministic parser expands to the exact boundaries
and validates:

- email: local part of at most 64 characters to the left, dotted domain with an alphabetic last label to the right;
- url: scheme to the first delimiter, trailing punctuation given back, a host with a dot is required;
- phone: a plus sign followed by 8 to 15 digits, at most as many as its country has, with single separators or parentheses and
  no more than ``GAP`` signs between two digits, up to the start of another number;
- ip: four numbers of at most 255 joined by dots, not part of a longer dotted number;
- ssn: 3-2-4 digits joined by hyphens, none of the impossible groups;
- iban: two letters and check digits, 15 to 34 characters, remainder 97 checked;
- account: 12 to 19 digits, together or in fours with single blanks or hyphens; kind "card" if there are 13 and the Luhn
  check holds. Grouped otherwise (4-6-5, 4-6-4, or any whole run with one separator), only cards are found;
- after a cue word ("tel", "phone", "account", "acct", "routing", "ssn", "card"; "no.", "number", "is", a colon or # may
  follow): 7 to 12 digits of a telephone number, 6 to 19 of an account, 9 of a routing number (kind "account"), 12 to 19 of a
  card in any groups, 3-2-4 of an ssn with or without single separators.

Digits are their own cue: an anchor is then the first digit of a run. Spans of a
text do not overlap: the earliest wins, then the longest, then the first kind in
the order above.

Defined results. A null or empty text has no span. A text of any length is read whole, in
time in proportion to it: what the anchors of one unbroken run have in common is found once.
Rows without an id have spans without one. Repeated rows repeat their spans. An empty table
has none. Offsets count characters. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import texts

KINDS = ("email", "url", "phone", "ip", "ssn", "iban", "card", "account")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_DIGITS = frozenset("0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_DOMAIN = _ALNUM | frozenset(".-")
_URL_END = re.compile("[ \\t\\r\\n\"'<>`{}|\\\\^]")
_AUTHORITY_END = re.compile("[/?]")
_NOT_DOMAIN = re.compile("[^A-Za-z0-9.-]")
_SCHEMES = ("http://", "https://", "ftp://", "www.")
#: What may follow a plus sign, and the most signs between two digits of a telephone number.
_OPENS, GAP = tuple("0123456789( -./"), 4
#: Most digits of a telephone number by country code, the code included.
_LONGEST = {"1": 11, "7": 11, "31": 11, "32": 11, "33": 11, "34": 11, "39": 13, "41": 11, "44": 12, "45": 10, "46": 12, "47": 10, "48": 11, "52": 13, "55": 13, "61": 11, "81": 12, "86": 13, "91": 12}
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split()


def email(t: str, at: int) -> tuple[int, int] | None:
    lo = at
    while lo > 0 and t[lo - 1] in _LOCAL:
        lo -= 1
    while lo < at and t[lo] in ".-%+":
        lo += 1
    hi, n = at + 1, len(t)
    while hi < n and t[hi] in _DOMAIN:
        hi += 1
    while hi > at + 1 and t[hi - 1] in ".-":
        hi -= 1
    if lo == at or t[at - 1] == "." or ".." in t[lo:hi]:
        return None
    labels = t[at + 1 : hi].split(".")
    if len(labels) < 2 or any(not x or x[0] == "-" or x[-1] == "-" or len(x) > 63 for x in labels) or not labels[-1].isalpha() or len(labels[-1]) < 2 or at - lo > 64:
        return None
    return lo, hi


class _Run:
    """What the anchors of one unbroken run of a text share, so that each costs the same however long the run is."""

    __slots__ = ("end", "last", "authority", "sign", "colon", "stray", "dot")

    def __init__(self) -> None:
        self.end = self.last = self.authority = self.sign = self.colon = self.stray = self.dot = -1


def url(t: str, at: int, scheme: str, run: _Run) -> tuple[int, int] | None:
    """``run`` holds what earlier anchors of the text found; anchors come from left to right."""
    if at > 0 and t[at - 1] in _ALNUM or scheme.lower() == "www." and t[max(0, at - 3) : at] == "://":
        return None
    lo = at + len(scheme)
    if run.end < lo:
        run.end = m.start() if (m := _URL_END.search(t, lo)) else len(t)
        hi = run.end
        while hi > lo and t[hi - 1] in ".,;:!?)]*#$%&":
            hi -= 1
        run.last = hi  # the end of every address in this run, if it lies behind its host's beginning
        run.authority = -1
    hi = run.last
    if hi <= lo:
        return None
    if run.authority < lo:  # the first slash or question mark, and the last at-sign before it
        run.authority = m.start() if (m := _AUTHORITY_END.search(t, lo, hi)) else hi
        run.sign = t.rfind("@", lo, run.authority)
        run.colon = run.stray = run.dot = -1
    host = max(lo, run.sign + 1)
    if run.colon < host:
        run.colon = x if (x := t.find(":", host, run.authority)) >= 0 else run.authority
    if run.stray < host:
        run.stray = m.start() if (m := _NOT_DOMAIN.search(t, host, run.authority)) else run.authority
    if run.dot < host:
        run.dot = x if (x := t.find(".", host, run.authority)) >= 0 else run.authority
    end = run.colon
    return (at, hi) if host < end <= run.stray and t[host] in _ALNUM and run.dot < end else None


def phone(t: str, at: int) -> tuple[int, int] | None:
    if at > 0 and t[at - 1] in _ALNUM or t[at + 1 : at + 2] not in _OPENS:
        return None
    most = next((m for c, m in _LONGEST.items() if t.startswith(c, at + 1)), 15)
    return _telephone(t, at, most) or (_telephone(t, at, 15) if most < 15 else None)


def _telephone(t: str, at: int, most: int, least: int = 8) -> tuple[int, int] | None:
    """The longest span of ``least`` to ``most`` digits behind ``at`` that ends where digits end."""
    i, n, digits, end, depth, gap = at + 1, len(t), 0, None, 0, 0
    while i < n:
        c = t[i]
        gap = 0 if c in _DIGITS else gap + 1
        if gap > GAP:
            break
        if c in _DIGITS:
            if end and t[i - 1] not in _DIGITS and number(t, i):
                break
            digits += 1
            if digits > most:
                break
            if digits >= least and not (i + 1 < n and t[i + 1] in _ALNUM):
                end = i + 1
        elif c == "(" and not depth:
            depth = 1
        elif c == ")" and depth:
            depth = 0
        elif c not in " -./" or t[i - 1] in "-./" or c == " " and t[i - 1] == " ":
            break
        i += 1
    return (at, end) if end else None


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _rest(t: str, at: int, sep: str, runs: dict[int, tuple[int, int]]) -> tuple[int, int]:
    """(digits, end) from the group of digits at ``at`` to the end of the groups that ``sep`` joins; a run is walked once and kept in ``runs`` by group."""
    if at in runs:
        return runs[at]
    n, i, heads = len(t), at, []
    while i < n and t[i] in _DIGITS:
        j = i
        while j < n and t[j] in _DIGITS:
            j += 1
        heads.append((i, j - i))
        if j + 1 < n and t[j] == sep and t[j + 1] in _DIGITS:
            i = j + 1
        else:
            i = j
            break
    total = 0
    for head, size in reversed(heads):
        total += size
        if head != heads[-1][0]:  # the last group may begin a run of the other sign
            runs[head] = (total, i)
    return runs[at]


def number(t: str, at: int, runs: dict[int, tuple[int, int]] | None = None) -> tuple[int, int, str] | None:
    """The span and kind of the number that starts at the digit ``at``, which no word character, dot or hyphen with digits before it precedes."""
    n, i = len(t), at
    while i < n and t[i] in _DIGITS:
        i += 1
    first = i - at
    sep = t[i] if i < n else ""
    if sep == "." and first <= 3:
        m = _IP.match(t, at)
        if m and all(int(x) <= 255 for x in m.group().split(".")):
            return at, m.end(), "ip"
        return None
    if sep == "-" and first == 3:
        m = _SSN.match(t, at)
        if m:
            a, b, c = m.group().split("-")
            if a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000":
                return at, m.end(), "ssn"
    if first < 12 and sep in (" ", "-") and t[i + 1 : i + 2] in _DIGITS_:
        m = _CARD.match(t, at)
        if m and luhn(_plain(m.group())):
            return at, m.end(), "card"
        many, end = _rest(t, at, sep, {} if runs is None else runs)
        whole = end == n or not (t[end] in _ALNUM or t[end] in " -" and t[end + 1 : end + 2] in _DIGITS_)
        if whole and 13 <= many <= 19 and luhn(_plain(t[at:end])):
            return at, end, "card"
    m = _ACCOUNT.match(t, at)
    if m:
        digits = _plain(m.group())
        return at, m.end(), "card" if 13 <= len(digits) and luhn(digits) else "account"
    return None


def _plain(s: str) -> str:
    return "".join(c for c in s if c in _DIGITS)


def cued(t: str, at: int, word: str) -> tuple[int, int, str] | None:
    """The span and kind of the number that the cue word at ``at`` announces."""
    if at > 0 and t[at - 1] in _ALNUM:
        return None
    m = _CUE[word].match(t, at)
    if not m:
        return None
    lo = m.end()
    if word in ("tel", "phone"):
        first = lo + (t[lo : lo + 1] == "(")
        if t[first : first + 1] not in _DIGITS_ or number(t, first):
            return None
        most = 12 if t[first] == "0" else 11 if t[first] == "1" else 10
        got = _telephone(t, lo - 1, most, 7) or _telephone(t, lo - 1, 12, 7)
        return (lo, got[1], "phone") if got else None
    if t[lo : lo + 1] not in _DIGITS_:
        return None
    if word == "ssn":
        m = _SSN_CUED.match(t, lo)
        if m and (d := _plain(m.group())) and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000":
            return lo, m.end(), "ssn"
        return None
    m = (_CUED_CARD if word == "card" else _CUED_ROUTING if word == "routing" else _CUED_ACCOUNT).match(t, lo)
    if not m or word == "card" and not 12 <= len(_plain(m.group())) <= 19 or not 6 <= len(_plain(m.group())) <= 19:
        return None
    digits = _plain(m.group())
    return lo, m.end(), "card" if 13 <= len(digits) and luhn(digits) else "account"


_DIGITS_ = tuple("0123456789")
_CARD = re.compile(r"[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9A-Za-z]|-[0-9])")
_FILL = r"(?:[ \t]*(?:numbers?\b|num\b|no\b|nr\b|is\b|[.:#=]|-(?![0-9]))){0,5}[ \t]*"
_CUE = {w: re.compile(x + _FILL, re.I) for w, x in {"tel": "tel(?:ephone)?", "phone": "phones?", "account": "accounts?", "acct": "accts?", "routing": "routing", "ssn": "ssn", "card": "cards?"}.items()}
_SSN_CUED = re.compile(r"[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![0-9A-Za-z]|-[0-9])")
_CUED_ROUTING = re.compile(r"[0-9]{9}(?![0-9A-Za-z]|-[0-9])|[0-9]{4}([ -])[0-9]{4}\1[0-9](?![0-9A-Za-z]|-[0-9])")
_CUED_CARD = re.compile(r"[0-9]+(?:([ -])[0-9]+(?:\1[0-9]+)*)?(?![0-9A-Za-z]|-[0-9])")
#: One run, or groups of a shorter first one.
_CUED_ACCOUNT = re.compile(r"(?:[0-9]{6,19}(?:-[0-9]+)*|[0-9]{1,5}(?:([ -])[0-9]+(?:\1[0-9]+)*))(?![0-9A-Za-z]|-[0-9])")
_IP = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])")
_ACCOUNT = re.compile(r"(?:[0-9]{12,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?)(?![0-9A-Za-z]|[-][0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


def iban(t: str, at: int) -> tuple[int, int] | None:
    if at > 0 and t[at - 1] in _ALNUM:
        return None
    m = _IBAN.match(t, at)
    if not m:
        return None
    s = m.group().replace(" ", "")
    if not 15 <= len(s) <= 34:
        return None
    return (at, m.end()) if int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None


def _cases(s: str) -> list[str]:
    return ["".join(x) for x in product(*({c, c.upper()} for c in s))]


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for s in _SCHEMES:
        for x in _cases(s):
            a.add_word(x, ("url", len(s)))
    for s in _CUE:
        for x in _cases(s):
            a.add_word(x, ("cue " + s, len(s)))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("number", 1))
        for c in IBAN_COUNTRIES:
            a.add_word(c + d, ("iban", 3))
    a.make_automaton()
    return a


def spans(t: str | None, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of a text, in order, without overlaps."""
    if not t:
        return []
    found: list[tuple[int, int, str]] = []
    digit = -2
    past = 0  # end of the digit run that was parsed last
    run, runs = _Run(), {}
    for end, (kind, size) in anchors.iter(t):
        at = end - size + 1
        if kind == "number":
            fresh = end != digit + 1
            digit = end
            if not fresh or at < past:
                continue
            if at > 0 and (t[at - 1] in _ALNUM or t[at - 1] in ".-" and at > 1 and t[at - 2] in _DIGITS):
                continue
            if got := number(t, at, runs):
                found.append(got)
                past = got[1]
        elif kind.startswith("cue "):
            if got := cued(t, at, kind[4:]):
                found.append(got)
                past = max(past, got[1])
        else:
            got = email(t, at) if kind == "email" else phone(t, at) if kind == "phone" else iban(t, at) if kind == "iban" else url(t, at, t[at : end + 1], run)
            if got:
                found.append((*got, kind))
                if kind in ("phone", "url"):  # the numbers inside are part of it
                    past = max(past, got[1])
    if len(found) > 1:
        found.sort(key=lambda s: (s[0], -s[1], KINDS.index(s[2])))
        kept: list[tuple[int, int, str]] = []
        for s in found:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
        return kept
    return found


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, start, end, value) of every span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            ids, kinds, lo, hi, values = [], [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                for x, y, kind in spans(t, anchors):
                    ids.append(i)
                    kinds.append(kind)
                    lo.append(x)
                    hi.append(y)
                    values.append(t[x:y])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(values, pa.string())], names=["doc_id", "kind", "start", "end", "value"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, kind string, start int, `end` int, value string")


def redact_text(t: str | None, anchors: ahocorasick.Automaton) -> str | None:
    """The text with every span replaced by its kind in angle brackets."""
    found = spans(t, anchors)
    if not found:
        return t
    out, at = [], 0
    for lo, hi, kind in found:
        out += (t[at:lo], f"<{kind.upper()}>")
        at = hi
    return "".join(out) + t[at:]


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` with spans replaced, and the character count made to agree where there is one. Column order and all other columns stay."""
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        for b in batches:
            new = [redact_text(t.as_py(), anchors) for t in b.column(at)]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if count >= 0:
                columns[count] = pa.array([None if t is None else len(t) for t in new], b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
