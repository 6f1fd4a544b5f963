"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their score.

Base kinds, leftmost and non-overlapping each: e-mail addresses, IPv4 addresses (parts up to 255), card
numbers (14 to 19 digits that pass Luhn) and phone numbers (10 to 15 digits). They always stay. Added kinds
are account numbers (IBAN, length of their country, remainder 1 modulo 97) and US social security numbers;
these stay if their score reaches ``threshold``. A score starts from the kind, gains from a word of the kind within
``REACH`` characters and loses from a word that speaks against it.

Every pattern is written so that a text is read in linear time, whatever it holds: an address is found from
its ``@``, dotted numbers from whole chains of them.

Spans count code points, end exclusive. Defined cases: null text is empty and has no span; repeated rows are
scanned each; spans of equal start come in the order of ``KINDS``; kinds may overlap each other; an empty table
gives an empty result; a column named ``spans`` is replaced, other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds in listed order, patterns, characters.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){13,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
WORD = re.compile(r"[^\W\d_]+")
# Characters of an account number by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# Parameters of the score.
START = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
FOR = {
    "email": {"email", "mail", "contact", "write", "correo", "courriel"},
    "ip": {"ip", "host", "server", "client", "address", "login", "logged"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "payment", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "whatsapp"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
AGAINST = {
    "email": {"noreply", "example"}, "ip": {"version", "release", "section", "chapter"},
    "card": {"order", "tracking", "serial", "isbn"}, "phone": {"order", "serial"},
    "iban": {"serial", "model", "part"}, "ssn": {"order", "part", "serial", "tracking"},
}
REACH, GAIN, LOSS = 40, 0.25, 0.2
THRESHOLD = 0.6
MASK = "<{}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")  # the next address begins at ``free`` or later
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, free
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for chain in DOTTED.finditer(text):
        parts = chain[0].split(".")
        at = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _alone(text: str, start: int, end: int) -> bool:
    """No letter or digit touches the span."""
    return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())


def accounts(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        taken = [i for i, c in enumerate(m[0]) if c != " "]
        if length and len(taken) >= length:
            end = m.start() + taken[length - 1] + 1
            if _alone(text, m.start(), end) and mod97(text[m.start() : end].replace(" ", "")):
                yield m.start(), end


def social(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        touching = text[m.start() - 1 : m.start()] == "-" or text[m.end() : m.end() + 1] == "-"
        if _alone(text, *m.span()) and not touching and area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, addresses, cards, phones, accounts, social)))


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    words = {w.lower() for w in WORD.findall(near)}
    return min(1.0, max(0.0, START[kind] + GAIN * bool(words & FOR[kind]) - LOSS * bool(words & AGAINST[kind])))


def find(text: str | None, threshold: float = THRESHOLD) -> list[tuple[int, int, str, int, float]]:
    """(start, place of the kind, kind, end, score) of all spans, in order."""
    out = []
    for rank, (kind, finder) in enumerate(FINDERS.items()):
        for start, end in finder(text or ""):
            worth = round(score(text, kind, start, end), 3)
            if kind in BASE or worth >= threshold:
                out.append((start, rank, kind, end, worth))
    return sorted(out)


def scan(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans``: per span kind, start, end and score, in order of start and kind."""
    at = docs.columns.index(text_col)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [
                [{"kind": k, "start": s, "end": e, "score": w} for s, _, k, e, w in find(t, threshold)]
                for t in b.column(at).to_pylist()]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns) if n != "spans"]
            yield pa.RecordBatch.from_arrays(
                [*[c for _, c in kept], pa.array(found, pa.list_(span))], [*[n for n, _ in kept], "spans"])

    spans = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double"))
    kept = [f for f in docs.schema.fields if f.name != "spans"]
    return docs.mapInArrow(run, T.StructType([*kept, T.StructField("spans", spans)]))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of its text replaced by their kind in angle brackets; overlapping spans share the first's."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(at).to_pylist():
                pieces, done = [], 0
                for start, _, kind, end, _ in find(text, threshold):
                    if start >= done:
                        pieces += [text[done:start], MASK.format(kind)]
                    done = max(done, end)
                out.append(text if not pieces else "".join(pieces) + text[done:])
            columns = list(b.columns)
            columns[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
