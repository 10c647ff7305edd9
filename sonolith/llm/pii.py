"""Personal data in texts, also behind disguises, with offsets into the source text.

Base detectors run on the text as it is. Then small transducers undo homoglyphs, spelled digits and at/dot disguises;
each normalised character keeps the span it came from, so what the same detectors find in the normalised text maps
back to the source. Every detector is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match always starts where its run of digits does, so the look-behind only saves restarts inside long runs.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ backwards: its local part is the run before it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        else:
            last = at + 1
        at = text.find("@", last)


def detect(text: str) -> list[Span]:
    """Base spans by kind, then start; ends are exclusive, offsets are code points."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if any(c in text for c in "0123456789"):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


#: Letters of other scripts that look like one of ours, and signs that vanish.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјкорсухԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαιν",
        "ABESIJKMHOPCTXYaesijkopcyxdhqwABEZHIKMNOPTYXoaiv",
        strict=True,
    )
)
_VANISH = "­​‌‍⁠﻿"
_DASHES = "‐‑‒–−"
#: With the styled letters of mathematics and circles, and the decimal digits of every script.
_STRANGE = re.compile(f"[{''.join(_LOOKALIKES)}{_VANISH}{_DASHES}！-～﹫。․Ⓐ-ⓩ\U0001d400-\U0001d7ff]|[^\\D0-9]")
_DIGITS = {w: str(i) for i, w in enumerate(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"))}
_NUMBER = "|".join(_DIGITS)
# Spelled digits, also among real ones; runs without a spelled digit or of under 7 digits in all stay.
_SPELLED = re.compile(rf"(?i)(?<![a-z0-9])(?:(plus)[ -]+)?((?:{_NUMBER}|[0-9]{{1,19}})(?:[ ,-]+(?:{_NUMBER}|[0-9]{{1,19}}))*)(?![a-z0-9])")
_WORDS = re.compile(rf"(?i){_NUMBER}|[0-9]")
_DOTTED = re.compile(r"(?i)(?<=[0-9]) dot (?=[0-9])")
_AT = re.compile(r"(?i)[ ]?[\[({<][ ]?(?:at|@)[ ]?[\])}>][ ]?")
_DOT = re.compile(r"(?i)[ ]?[\[({<][ ]?(?:dot|\.)[ ]?[\])}>][ ]?")
#: Without brackets only these ends make an address, as "at" and "dot" are words of prose too. Country
#: codes that are words of prose count only after a real dot or a real @.
_ENDS = "com|org|net|edu|gov|mil|info|biz|io|dev|app|name|pro|xyz|online|site|shop|tech|cloud|ai|eu|uk|de|fr|es|pt|nl|lu|ch|ie|dk|se|fi|pl|cz|sk|hu|ro|bg|gr|hr|si|rs|lt|lv|ee|ru|ua|tr|il|ae|sa|eg|za|ng|ke|pk|bd|lk|cn|hk|tw|jp|kr|sg|th|vn|ph|au|nz|ca|mx|br|ar|cl|co|pe|uy|ve"
_WORDLIKE = "in|is|it|to|so|no|my|me|as|be|by|do|am|at|us|tv|id"
_L, _D = "[a-z0-9._%+-]{1,64}", "[a-z0-9-]{1,63}"
_BARE = re.compile(
    rf"(?i)(?<![a-z0-9._%+-])({_L}(?: dot {_L}){{0,3}})(?:( at )({_D}(?:(?: dot |\.){_D}){{0,4}}(?: dot (?:{_ENDS})|\.(?:{_ENDS}|{_WORDLIKE})))|@({_D}(?:(?: dot |\.){_D}){{0,4}}(?: dot |\.)(?:{_ENDS}|{_WORDLIKE})))(?![a-z0-9-])"
)


class Traced:
    """A text with the source span of each character."""

    def __init__(self, text: str):
        self.text = text
        self.start = list(range(len(text)))
        self.end = list(range(1, len(text) + 1))
        self.changed = False

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply (start, end, new text) edits in order; new characters stand for the whole replaced span."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            start += self.start[at:a] + [self.start[a]] * len(new)
            end += self.end[at:a] + [self.end[b - 1]] * len(new)
            at = b
        self.text = "".join(text) + self.text[at:]
        self.start, self.end, self.changed = start + self.start[at:], end + self.end[at:], True


def _plain(c: str) -> str:
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    if c in _VANISH:
        return ""
    if c in _DASHES:
        return "-"
    if c in "。․":
        return "."
    digit = unicodedata.decimal(c, None)
    return str(digit) if digit is not None else unicodedata.normalize("NFKC", c)


def _spelled(text: str) -> list[tuple[int, int, str]]:
    edits = []
    for m in _SPELLED.finditer(text):
        tokens = _WORDS.findall(m[2])
        dotted = text[m.end() : m.end() + 5].lower() == " dot " or text[max(0, m.start() - 5) : m.start()].lower() == " dot "
        if any(len(w) > 1 for w in tokens) and (len(tokens) >= 7 or dotted):
            edits.append((m.start(), m.end(), "+" * bool(m[1]) + "".join(_DIGITS.get(w.lower(), w) for w in tokens)))
    return edits


def normalise(text: str) -> Traced | None:
    """The text without disguises, or None where there are none."""
    low = text.lower()
    words = sum(map(low.count, _DIGITS))
    bracket = any(c in text for c in "[({<")
    dots = "dot" in low or (bracket and _DOT.search(text) is not None)
    spelled = words >= 7 or (words and (dots or any(c in text for c in "0123456789")))
    ats = dots or (bracket and _AT.search(text) is not None) or (" at " in low and (not text.isascii() or _BARE.search(text) is not None))
    strange = not text.isascii() and _STRANGE.search(text)
    if not (spelled or ats or strange):
        return None
    t = Traced(text)
    if strange:
        t.replace([(m.start(), m.end(), _plain(m[0])) for m in _STRANGE.finditer(text)])
    if spelled:
        t.replace(_spelled(t.text))
    if ats:
        t.replace([(m.start(), m.end(), "@") for m in _AT.finditer(t.text)])
        t.replace([(m.start(), m.end(), ".") for m in _DOT.finditer(t.text)])
        t.replace([(m.start(), m.end(), ".") for m in _DOTTED.finditer(t.text)])
        edits = []
        for m in _BARE.finditer(t.text):
            found = [(m.start() + d.start(), m.start() + d.end(), ".") for d in re.finditer(r"(?i) dot (?=[a-z0-9._%+-])", m[0])]
            edits += sorted(found + [(*m.span(2), "@")] * bool(m[2]))
        t.replace(edits)
    return t if t.changed else None


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base, added): added spans come from the normalised text and lie within no base span of their kind."""
    text = text or ""
    base = detect(text)
    t = normalise(text)
    if t is None:
        return base, []
    taken: dict[str, list[tuple[int, int]]] = {}
    for kind, a, b in base:
        taken.setdefault(kind, []).append((a, b))
    added = []
    for kind, a, b in detect(t.text):
        a, b = t.start[a], t.end[b - 1]
        if not any(x <= a and b <= y for x, y in taken.get(kind, ())):
            added.append((kind, a, b))
    return base, added


def joined(spans: list[Span]) -> str:
    order = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added.

    Null texts count as empty and have no spans. Rows are searched one by one, so repeated rows get equal results.
    """

    def run(batches):
        for part in C.pieces(batches):
            found = [find(x) for x in part.column(1).to_pylist()]
            columns = [part.column(0)]
            columns += [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            columns.append(pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([joined(base + added) for base, added in found], pa.string()))
            columns.append(pa.array([len(added) for _, added in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    counts = "".join(f", n_{k} long" for k in KINDS)
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}{counts}, base_sha256 string, spans string, n_added long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact(text: str | None) -> str | None:
    """The text with each span, base or added, as its kind in brackets; overlapping spans become one."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(sum(find(text), []), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with personal data in ``text`` replaced; other columns, null and empty texts stay."""
    at = docs.columns.index(text)

    def run(batches):
        for part in C.pieces(batches):
            clean = pa.array([redact(x) for x in part.column(at).to_pylist()], part.schema.field(at).type)
            yield part.set_column(at, part.schema.field(at), clean)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))
