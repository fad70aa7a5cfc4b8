"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Four base kinds (``email``, ``ip``, ``card``, ``phone``) are found leftmost and
without overlap per kind; a proposal whose check fails is dropped and not tried
again. They always stay. Further proposals stay if their score reaches
``THRESHOLD``: ``iban`` (as long as its country's are, and mod-97), short cards of 13 to 15
digits that pass Luhn, local phone numbers and hexadecimal secrets, the last
three only beside a word of their context.

Nulls count as the empty text, which has no spans. A long text is scanned
whole; every pattern is linear (possessive runs), so a run of a million digits
or letters costs no more than other text. Rows are independent: ties, repeated
rows, empty tables and further columns change nothing, and a null doc_id stays.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import prepare, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_short", "phone_local", "secret")
#: Least score of a span of a further kind.
THRESHOLD = 0.6
#: Code points before and after a span in which a context word counts.
CONTEXT = 40

# The optional tail after a possessive run finds what the plain pattern finds, leftmost, in linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
IP = re.compile(r"[0-9]++((?:\.[0-9]+){3})?")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
LOCAL = re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])")
SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])")

# Lengths of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: What follows the check digits of an IBAN, by its length.
IBAN_REST = {n: re.compile(rf"(?: ?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(IBAN_LENGTH.values())}

#: Kind: prior score after its check, what a context word adds, the words.
EVIDENCE = {
    "email": (0.9, 0.05, re.compile(r"mail|contact|write|kontakt|correo|courriel", re.I)),
    "ip": (0.7, 0.2, re.compile(r"\bip\b|address|host|server|login", re.I)),
    "card": (0.8, 0.15, re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.I)),
    "phone": (0.8, 0.15, re.compile(r"phone|tel|call|mobile|fax|anruf|appel", re.I)),
    "iban": (0.9, 0.05, re.compile(r"iban|account|konto|compte|cuenta", re.I)),
    "card_short": (0.4, 0.4, re.compile(r"card|visa|master|amex|credit|karte|carte|tarjeta", re.I)),
    "phone_local": (0.3, 0.4, re.compile(r"phone|\btel\b|call|mobile|fax", re.I)),
    "secret": (0.3, 0.5, re.compile(r"token|secret|passw|api.?key|private.?key", re.I)),
}


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        digit <<= place & 1
        total += digit - 9 if digit > 9 else digit
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(match: str) -> str:
    return re.sub("[^0-9]", "", match)


def _proposals(text: str, has_at: bool) -> Iterator[tuple[str, int, int]]:
    """Spans that pass their check, by kind and start."""
    if has_at:
        for m in EMAIL.finditer(text):
            if m[1]:
                yield "email", m.start(), m.end()
    for m in IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card" if len(digits) >= 16 else "card_short", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    past = 0
    for m in IBAN.finditer(text):
        length = IBAN_LENGTH.get(m[0][:2])
        rest = IBAN_REST[length].match(text, m.end()) if length and m.start() >= past else None
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            past = rest.end()
            yield "iban", m.start(), past
    for m in LOCAL.finditer(text):
        if 8 <= len(_digits(m[0])) <= 12:
            yield "phone_local", m.start(), m.end()
    for m in SECRET.finditer(text):
        if not m[0].isalpha():
            yield "secret", m.start(), m.end()


def find_spans(raw: bytes | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start; code points, end exclusive."""
    has_at = bool(raw) and b"@" in raw
    if not raw or not has_at and len(raw.translate(None, b"0123456789")) == len(raw):
        return []
    text = raw.decode("utf-8", "replace")
    found: list[tuple[str, int, int, float]] = []
    for kind, start, end in _proposals(text, has_at):
        prior, gain, words = EVIDENCE[kind]
        score = prior + gain * bool(words.search(text, max(0, start - CONTEXT), start) or words.search(text, end, end + CONTEXT))
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, start, end, round(score, 4)))
    base = [(s, e) for kind, s, e, _ in found if kind in BASE_KINDS]
    kept = [x for x in found if x[0] in BASE_KINDS or not any(s < x[2] and x[1] < e for s, e in base)]
    return sorted(kept, key=lambda x: (KINDS.index(x[0]), x[1]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("scores", pa.list_(pa.float64()))])


def _scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        rows = []
        for doc_id, raw in zip(part.column(0).to_pylist(), texts(part.column(1))):
            spans = find_spans(raw)
            said = [f"{k}:{s}:{e}" for k, s, e, _ in spans]
            base = ",".join(x for x, s in zip(said, spans) if s[0] in BASE_KINDS)
            rows.append((doc_id, *(sum(s[0] == k for s in spans) for k in BASE_KINDS), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [s[3] for s in spans]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_ARROW)], schema=_ARROW)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, digests and spans of personal data in each row's text, one row for each row."""
    prepare(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")


def _redacted(raw: bytes | None) -> str | None:
    if raw is None:
        return None
    text, out, at = raw.decode("utf-8", "replace"), [], 0
    for kind, start, end, _ in sorted(find_spans(raw), key=lambda x: (x[1], -x[2])):
        if end > at:
            out += [text[at:start], f"<{kind}>" if start >= at else ""]
            at = end
    return "".join([*out, text[at:]])


def redact(text: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap count as one."""

    @F.arrow_udf(T.StringType())
    def replace(column: pa.Array) -> pa.Array:
        return pa.array([_redacted(raw) for raw in texts(column)], pa.string())

    return replace(text)
