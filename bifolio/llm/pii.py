"""Personal data, also in disguise, at offsets of the unchanged text.

Base rules find plain identifiers. Then a chain of transducers rewrites the
text as a reader would undo common disguises: full-width, Cyrillic and Greek
look-alikes and digits of other scripts become ASCII, invisible characters
go, "(at)", "[dot]" and the bare words in the frame "name at host dot top"
become signs, and runs of spelled digits become digits. Each transducer keeps,
for every character it writes, the span of source characters it stands for, so
a find in the rewritten text maps back to the source. Such a find is added
when no base span of its kind overlaps it; base spans always stay. Every text goes
through all transducers.

Null and empty texts have no spans. Texts of any length are scanned whole in
about linear time. Repeated rows get equal results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .text_kernel import sliced

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # start, end, place in KINDS


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @, host with a dot, found from the @ signs: linear where a scan would not be."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All plain identifiers, by start, then by kind."""
    found: list[Span] = []
    if "@" in text:
        found += [(a, b, 0) for a, b in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() <= 64 and 12 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
        if "+" in text:
            found += [(m.start(), m.end(), 3) for m in _PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# Letters of other scripts that look like a Latin letter or sign.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ԛ": "q",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "υ": "u",
    "․": ".", "。": ".", "｡": ".", "﹒": ".", "﹫": "@", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "﹢": "+",
}
# Names of the digits in four languages, and of the plus sign.
DIGITS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "zwo": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
AT_WORDS = "at|arroba|arobase|klammeraffe"
DOT_WORDS = "dot|punkt|point|punto"
#: Runs of fewer spelled digits are left as words.
LEAST_SPELLED = 3

#: A run of blanks is entered at its first one only, and once: else each blank of a long run would scan the rest of it.
_BLANKS_BEFORE = r"(?:(?<![ \t])[ \t]++)?+"
_AT_FRAMED = re.compile(rf"{_BLANKS_BEFORE}[(\[{{<][ \t]*+(?:{AT_WORDS}|@)[ \t]*+[)\]}}>][ \t]*+", re.I)
_DOT_FRAMED = re.compile(rf"{_BLANKS_BEFORE}[(\[{{<][ \t]*+(?:{DOT_WORDS}|\.)[ \t]*+[)\]}}>][ \t]*+", re.I)
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++( ++(?:{AT_WORDS}) ++|@)[A-Za-z0-9-]++(?:(?: ++(?:{DOT_WORDS}) ++|\.)[A-Za-z0-9-]++)+", re.I)
_BARE_DOT = re.compile(rf" +(?:{DOT_WORDS}) +", re.I)
_DIGIT_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:(?:{_DIGIT_WORD}|[0-9])(?!\w)[ ,/-]{{0,3}}){{{LEAST_SPELLED},}}", re.I)
_ONE_DIGIT = re.compile(rf"{_DIGIT_WORD}|[0-9]", re.I)
_DOTTED_WORDS = re.compile(rf"(?<=[0-9]) +(?:{DOT_WORDS}) +(?=[0-9])", re.I)
_PLUS_WORD = re.compile(r"(?<!\w)(?:plus|más)[ ]+(?=[0-9])", re.I)
#: Letters that re.I takes for these, though lower() doesn't make them so.
_FOLDED = str.maketrans("ſıİ\u212a", "siik")


@lru_cache(1 << 16)
def plain_char(c: str) -> str:
    """The ASCII sign that a character stands for; empty if it is invisible, itself if it is ordinary."""
    if c < "\x80":
        return c
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    folded = unicodedata.normalize("NFKC", c) if "\U0001d400" <= c <= "\U0001d7ff" else c
    return folded if len(folded) == 1 and folded < "\x80" else c


class Tape:
    """A text with, for each of its characters, the source span it stands for."""

    def __init__(self, text: str, starts: list[int] | range | None = None, ends: list[int] | range | None = None) -> None:
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewritten(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """Each edit replaces [a, b) by characters that stand for [x, y) of this tape."""
        if not edits:
            return self
        text, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            for c, x, y in new:
                text.append(c)
                starts.append(self.starts[x])
                ends.append(self.ends[y - 1])
            at = b
        text.append(self.text[at:])
        return Tape("".join(text), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]])

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def undisguised(text: str) -> Tape:
    """The transducers, one after the other."""
    tape = Tape(text)
    odd = {c: plain_char(c) for c in set(text) if plain_char(c) != c} if not text.isascii() else {}
    if odd:
        tape = tape.rewritten([(i, i + 1, [(odd[c], i, i + 1)] if odd[c] else []) for i, c in enumerate(text) if c in odd])
    edits = []
    for m in _SPELLED.finditer(tape.text):
        end = m.start() + len(m[0].rstrip(" ,/-"))
        digits = list(_ONE_DIGIT.finditer(tape.text, m.start(), end))
        if any(d[0].isalpha() for d in digits):
            edits.append((m.start(), end, [(str(DIGITS.get(d[0].translate(_FOLDED).lower(), d[0])), d.start(), d.end()) for d in digits]))
    tape = tape.rewritten(edits)
    for pattern, sign in ((_AT_FRAMED, "@"), (_DOT_FRAMED, "."), (_DOTTED_WORDS, "."), (_PLUS_WORD, "+")):
        tape = tape.rewritten([(m.start(), m.end(), [(sign, m.start(), m.end())]) for m in pattern.finditer(tape.text)])
    edits = []
    for m in _BARE.finditer(tape.text):
        if " " in m[0]:
            edits.append((*m.span(1), [("@", *m.span(1))]))
            edits += [(*d.span(), [(".", *d.span())]) for d in _BARE_DOT.finditer(tape.text, m.end(1), m.end())]
    return tape.rewritten(edits)


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    tape = undisguised(text)
    if tape.text == text:
        return base, base
    taken = [[s for s in base if s[2] == kind] for kind in range(len(KINDS))]  # by start; those of a kind don't overlap
    added = []
    for a, b, kind in base_spans(tape.text):
        a, b = tape.source(a, b)
        before = bisect_left(taken[kind], (b,)) - 1  # the last that starts before b
        if before < 0 or taken[kind][before][1] <= a:
            added.append((a, b, kind))
    return base, sorted([*base, *added], key=lambda s: (s[0], s[2], s[1])) if added else base


def listed(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long"


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts of all spans by kind, a digest of the base spans, all spans, the number of base spans."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        none = hashlib.sha256(b"").hexdigest()
        for whole in batches:
            for batch in sliced(whole, "text"):
                rows = []
                for text in batch.column(1).to_pylist():
                    base, every = spans(text or "")
                    counts = [0, 0, 0, 0]
                    for s in every:
                        counts[s[2]] += 1
                    rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest() if base else none, listed(every), len(base)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(find), SCHEMA)
