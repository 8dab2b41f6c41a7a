"""Personal data, also behind disguises, at its place in the original text.

Base patterns are searched in the text itself.  Then transducers rewrite it, and
each keeps, for every character it writes, the span it was read from:

1. look-alikes: compatibility forms (full width, styled letters and digits),
   Cyrillic and Greek letters that look Latin, and invisible characters;
2. spelled digits of four languages, in runs of at least seven digits of which some
   are words, or as the four parts of an address;
3. "at" and "dot" (or the signs themselves) in brackets, between words where both are
   present, between the parts of an address, as entities, or set apart by spaces.

The same patterns are searched in what was written, and spans are mapped back to
source characters.  A found span counts unless it lies within one of the base: a
base span may be only a fragment of what is disguised, and both stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ["email", "ip", "card", "phone"]
Span = tuple[str, int, int]

_AT = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: the local part is the run of its characters before an @, after the last match."""
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            last = m.end()


def _ips(text: str) -> Iterator[Span]:
    at = 0
    while m := _IP.search(text, at):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
        at = m.end()


def _cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() < 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            yield "phone", m.start(), m.end()


_DIGIT = re.compile("[0-9]")


def identifiers(text: str) -> list[Span]:
    """Matches of all kinds, by start, then in the order of ``KINDS``; code points, end exclusive."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        found += [*_ips(text), *_cards(text)]
        if "+" in text:
            found += _phones(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like a Latin one.
LOOK_ALIKES = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοινɑɡı",
        "ABEKMHOPCTXaeopcyxijsdhABEZHIKMNOPTYXaoivagi",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿"
# Digits in English, German, French and Spanish, from zero on.
_DIGITS_IN = [
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
]
DIGIT_WORDS = {w: str(k) for words in _DIGITS_IN for k, w in enumerate(words.split())} | {"oh": "0", "zwo": "2", "fuenf": "5"}
PLUS_WORD = "plus"

_LETTER = "A-Za-z0-9\u00C0-\u024F"
_ONE_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_DIGIT_WORD = f"{_ONE_DIGIT}|{PLUS_WORD}"
_SPELLED = re.compile(rf"(?<![{_LETTER}])(?:(?:{_DIGIT_WORD}|\+?[0-9]+)(?:[\x20,.-]{{1,2}}|(?![{_LETTER}]))){{4,}}", re.I)
_THREE_WORDS = re.compile(rf"(?<![{_LETTER}])(?:{_DIGIT_WORD})(?:[\x20,.+0-9-]{{1,12}}(?:dot\x20)?(?:{_DIGIT_WORD})(?![{_LETTER}])){{2}}", re.I)
_ADDRESS_PART = rf"(?:{_ONE_DIGIT}|[0-9]+)(?:[\x20-](?:{_ONE_DIGIT}|[0-9]+)){{0,2}}"
_ADDRESS = re.compile(rf"(?<![{_LETTER}.]){_ADDRESS_PART}(?:\x20(?:dot|punkt|point|punto)\x20{_ADDRESS_PART}){{3}}(?![{_LETTER}])", re.I)
_ADDRESS_TOKEN = re.compile(rf"\x20(?P<dot>dot|punkt|point|punto)\x20|(?P<word>{_ONE_DIGIT})(?![{_LETTER}])|(?P<gap>[\x20-])", re.I)
_SPELLED_PART = re.compile(rf"({_DIGIT_WORD})|([0-9+]+)|([\x20,.-]+)", re.I)
#: Bracketed marks, and plain words of an address written out.
_BRACKETED = re.compile(r"[\x20]?[\[({<][\x20]?(at|dot|punkt|punto|point|arroba|@|\.)[\x20]?[\])}>][\x20]?", re.I)
_ENTITY = re.compile(r"&(?:#0*(64|46)|#x0*(40|2e)|(commat|period));", re.I)
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20@\x20[A-Za-z0-9-]+(?:\x20\.\x20[a-z][a-z0-9-]+)+(?![A-Za-z0-9-])")
_SPACED_MARK = re.compile(r"\x20([@.])\x20")
_WRITTEN_OUT = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\x20at\x20[A-Za-z0-9-]+(?:\x20dot\x20[A-Za-z0-9-]+)+(?![A-Za-z0-9-])", re.I
)
_WRITTEN_MARK = re.compile(r"\x20(at|dot)\x20", re.I)
_MARK_HINT = re.compile(r"[\[({<]\x20?(?:at|dot|punkt|punto|point|arroba|@|\.)\x20?[\])}>]|\x20(?:dot|punkt|point|punto|@)\x20|&[#cp]", re.I)
_SIGN = {"at": "@", "arroba": "@", "@": "@", "64": "@", "40": "@", "commat": "@"}


_DOTS = (" dot ", " punkt ", " point ", " punto ")


class Tape:
    """A text being rewritten: its characters, and the source span of each."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans, in ascending order; what is written stands for the whole span."""
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.start, self.end = start + self.start[at:], end + self.end[at:]


def look_alikes(tape: Tape) -> None:
    edits = []
    for k, ch in enumerate(tape.text):
        if ch < "\x80":
            continue
        new = LOOK_ALIKES.get(ch)
        if new is None and ch in INVISIBLE:
            new = ""
        if new is None:
            plain = unicodedata.normalize("NFKC", ch)
            new = plain if plain != ch and plain.isascii() and plain.strip() else None
        if new is not None:
            edits.append((k, k + 1, new))
    if edits:
        tape.rewrite(edits)


def spelled_digits(tape: Tape) -> None:
    edits = []
    for run in _SPELLED.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, run.start(), run.end()))
        while parts and parts[-1][3]:
            parts.pop()
        words = sum(bool(p[1]) for p in parts)
        digits = sum(len(_NOT_DIGIT.sub("", p[2])) if p[2] else bool(p[1]) for p in parts)
        if words < 3 or digits < 7:
            continue
        for p in parts:
            if p[1]:
                edits.append((p.start(), p.end(), "+" if p[1].lower() == PLUS_WORD else DIGIT_WORDS[p[1].lower()]))
            elif p[3] and p[3] != ".":
                edits.append((p.start(), p.end(), ""))
    if edits:
        tape.rewrite(edits)


def spelled_addresses(tape: Tape) -> None:
    """Four parts of up to three digits, written as words or digits, with the dots as words."""
    edits = []
    for m in _ADDRESS.finditer(tape.text):
        for token in _ADDRESS_TOKEN.finditer(tape.text, m.start(), m.end()):
            new = "." if token["dot"] else DIGIT_WORDS[token["word"].lower()] if token["word"] else ""
            edits.append((token.start(), token.end(), new))
    if edits:
        tape.rewrite(edits)


def entities(tape: Tape) -> None:
    edits = [(m.start(), m.end(), _SIGN.get((m[1] or m[2] or m[3]).lower(), ".")) for m in _ENTITY.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)


def marks(tape: Tape) -> None:
    edits = [(m.start(), m.end(), _SIGN.get(m[1].lower(), ".")) for m in _BRACKETED.finditer(tape.text)]
    if edits:
        tape.rewrite(edits)
    edits = []
    for m in _WRITTEN_OUT.finditer(tape.text):
        edits += [(k.start(), k.end(), _SIGN.get(k[1].lower(), ".")) for k in _WRITTEN_MARK.finditer(tape.text, m.start(), m.end())]
    if edits:
        tape.rewrite(edits)
    edits = []
    for m in _SPACED.finditer(tape.text):
        edits += [(k.start(), k.end(), k[1]) for k in _SPACED_MARK.finditer(tape.text, m.start(), m.end())]
    if edits:
        tape.rewrite(edits)


def disguised(text: str) -> list[Span]:
    """Identifiers that only show after rewriting, as spans of the source."""
    foreign = not text.isascii() and any(
        ch in LOOK_ALIKES or ch in INVISIBLE or ord(ch) > 0x2000 for ch in set(text) if ch >= "\x80"
    )
    lower = text.lower()
    spelled = bool(_THREE_WORDS.search(lower))
    marked = (any(w in lower for w in _DOTS) or any(ch in text for ch in "[({<@&")) and bool(_MARK_HINT.search(text))
    if not (foreign or spelled or marked):
        return []
    tape = Tape(text)
    if foreign:
        look_alikes(tape)
    entities(tape)
    spelled_addresses(tape)
    spelled_digits(tape)
    marks(tape)
    if tape.text == text:
        return []
    return [(kind, tape.start[a], tape.end[b - 1]) for kind, a, b in identifiers(tape.text)]


def found(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = identifiers(text)
    more = disguised(text)
    if more:
        starts, reach = [], []
        for _, a, b in sorted(base, key=lambda s: s[1]):
            starts.append(a)
            reach.append(max(b, reach[-1] if reach else 0))
        # A span lies within a base span if one that begins no later reaches as far.
        within = lambda a, b: (k := bisect_right(starts, a)) > 0 and reach[k - 1] >= b
        more = [(kind, a, b) for kind, a, b in more if not within(a, b)]
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def personal_data(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` with ``base`` and ``spans``: arrays of (kind, start, end) in code points.

    NULL and empty texts have none; rows are kept as they are.
    """
    span = T.ArrayType(
        T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    )
    schema = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.add("base", span).add("spans", span)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            column = batch.column(len(columns))
            for first in range(0, len(column), 256):
                results = [found(t or "") for t in column.slice(first, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(first, 256) for c in batch.columns[: len(columns)]],
                        pa.array([as_rows(b) for b, _ in results], type=kind),
                        pa.array([as_rows(a) for _, a in results], type=kind),
                    ],
                    names=schema.names,
                )

    return docs.select(*[F.col(f"`{c}`") for c in columns], F.col(text)).mapInArrow(run, schema)


def pii_report(docs: DataFrame) -> DataFrame:
    """One row per document: base matches by kind, their digest, and all spans."""
    rows = personal_data(docs, ["doc_id"])
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(kind) for kind in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
