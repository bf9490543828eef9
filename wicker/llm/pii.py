"""Personal data in texts (operator 5).

Regular expressions propose spans. Validators confirm them: Luhn for card
numbers, mod-97 for bank accounts (IBAN), ranges for addresses, digit counts for
phones. Words near a span move its score up or down. The kinds of the base set
keep every validated span whatever its score; the added kinds (iban, ssn) are
kept from `threshold` on.

An account number is cut to the length its country has, as words that follow it can
look like a part of it.

All scans are linear in the text: local parts of mail addresses are found from
their @ backwards, and numbers are only tried where a run of digits begins. Texts
without a digit or an @ can hold nothing and are told apart a batch at a time. Patterns
begin with the characters they can start at, which the regex engine skips to, and look
behind from there.

Defined cases: NULL text counts as empty and has no spans; repeated rows are each
reported; NULL ids stay NULL; an empty table gives no rows; other columns are
not read. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn")
KINDS = BASE + ADDED

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9](?<![0-9]{2})[0-9]*\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z](?<!\w[A-Z])[A-Z][0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"[0-8](?<![0-9-][0-8])(?!(?<=0)00|(?<=6)66)[0-9]{2}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

# characters of an account by country, as registered
IBAN_LENGTH = {
    code: length
    for length, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for code in codes.split()
}

START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
NEAR = 48
STEP = 0.3
FOR = {
    "email": ("mail", "email", "e-mail", "contact", "contacto", "kontakt", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
AGAINST = {
    "email": ("example", "noreply"),
    "ip": ("version", "release", "section", "chapter"),
    "card": ("order", "invoice", "isbn", "sku", "tracking"),
    "phone": ("version", "isbn", "part"),
    "iban": ("sku", "serial"),
    "ssn": ("part", "sku", "serial", "model"),
}
_CUES = {
    kind: (
        re.compile(r"\b(?:" + "|".join(map(re.escape, FOR[kind])) + r")\b", re.IGNORECASE),
        re.compile(r"\b(?:" + "|".join(map(re.escape, AGAINST[kind])) + r")\b", re.IGNORECASE),
    )
    for kind in KINDS
}


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international bank account numbers, letters standing for 10 to 35."""
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(done, at + 1))


def _accounts(text: str) -> Iterator[tuple[str, int, int]]:
    """The proposed span takes in words that follow, so its end is looked for: see `_account_end`."""
    m = _IBAN.search(text)
    while m:
        end = _account_end(m)
        if end:
            yield "iban", m.start(), end
        # a span that fails may hide an account that begins inside it
        m = _IBAN.search(text, end or m.start() + 1)


def _account_end(m: re.Match) -> int | None:
    """Where a valid account that begins with the match ends.

    Ends lie before a space or at the end of the match. The length of the country
    goes first, then the whole match; where the country is not known, every end
    from the longest to the shortest.
    """
    parts = m[0].split(" ")
    ends, size, at = [], 0, m.start()
    for part in parts:
        size, at = size + len(part), at + len(part)
        ends.append((size, at))
        at += 1
    ends.reverse()
    length = IBAN_LENGTH.get(m[0][:2])
    tried = ends if length is None else [e for e in ends if e[0] == length] + ends[:1]
    for size, at in tried:
        if 15 <= size <= 34 and mod97(m[0].replace(" ", "")[:size]):
            return at
    return None


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    yield from _accounts(text)
    for m in _SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    """Trust in a validated span: its kind's start value, moved by words nearby."""
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    up, down = (any(cue.search(x) for x in (before, after)) for cue in _CUES[kind])
    return round(min(1.0, max(0.0, START[kind] + STEP * up - STEP * down)), 2)


def find(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """All spans of a text, by start, then kind in the order of KINDS."""
    found = [("email", s, e) for s, e in _emails(text)]
    found += _numbers(text)
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    scored = [(k, s, e, score(text, k, s, e)) for k, s, e in found]
    return [x for x in scored if x[0] in BASE or x[3] >= threshold]


def may_hold(texts: pa.Array) -> pa.Array:
    """Whether a text can hold any span: mail has an @, all other kinds have digits."""
    return pc.match_substring_regex(texts, "[0-9@]")


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])


def find_pii(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with one row per row; spans are structs of kind, start, end and score."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ("kind", "start", "end", "score")
            texts = batch.column("text")
            spans = [
                [dict(zip(names, s)) for s in find(x.as_py(), threshold)] if held else []
                for x, held in zip(texts, may_hold(texts).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
