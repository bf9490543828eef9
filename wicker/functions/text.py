"""Text columns: markup removal, catalogue normalisation, tokens."""

from __future__ import annotations

import sys
import unicodedata
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: whitespace as web scripts see it
SPACE = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"

# fixed values: Spanish filler words that carry no product meaning
STOP_WORDS = [
    "a", "al", "con", "de", "del", "el", "en", "hacer", "la", "las", "los", "para", "por", "que",
    "quiero", "un", "una", "unas", "unos", "busco", "necesito",
]

# fixed values: spelled units and their short form, longest spelling first
UNITS = [
    ("kilogramos|kilogramo|kilos|kilo|kgs|kg", "kg"),
    ("milimetros|milimetro|mms|mm", "mm"),
    ("centimetros|centimetro|cms|cm", "cm"),
    ("metros|metro|mts|mt|m", "m"),
]
NUMBER = r"\d+(?:[.,]\d+)?"
UNIT_TOKEN = rf"\b{NUMBER}{SPACE}*(?:kg|mm|cm|m)\b"


def _accent_table() -> tuple[str, str]:
    """Accented letters and their base letters, then the bare marks to drop, from all characters."""
    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))
    marks = regex.findall(r"\p{Diacritic}", every)
    dropped = set(marks)
    accented, plain = [], []
    for letter in every:
        if letter in dropped:
            continue
        parts = unicodedata.normalize("NFD", letter)
        base = "".join(p for p in parts if p not in dropped)
        if len(parts) > 1 and len(base) == 1:
            accented.append(letter)
            plain.append(base)
    return "".join(accented + marks), "".join(plain)


_ACCENTED, _PLAIN = _accent_table()


def strip_accents(c: Column) -> Column:
    """Letters without their marks; marks that stand alone go, spacing ones too."""
    return F.translate(c, _ACCENTED, _PLAIN)


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"{SPACE}+", " "), "^ | $", "")


def html_to_text(c: Column) -> Column:
    """Visible text of a fragment; NULL for NULL or empty input."""
    steps = [
        (r"(?is)<script\b.*?</script>", " "),
        (r"(?is)<style\b.*?</style>", " "),
        (r"<[^>]+>", " "),
        (r"(?i)&nbsp;", " "),
        (r"(?i)&amp;", "&"),
        (r"(?i)&quot;", '"'),
        (r"(?i)&#039;", "'"),
    ]
    out = F.when(c != "", c)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return collapse_spaces(out)


def normalise_text(c: Column) -> Column:
    """Lower case without accents, units in short form, single spaces."""
    out = F.lower(strip_accents(F.coalesce(c, F.lit(""))))
    for spelled, unit in UNITS:
        out = F.regexp_replace(out, rf"(?i)\b({NUMBER}){SPACE}*({spelled})\b", f"$1 {unit}")
    return collapse_spaces(out)


def tokens(normalised: Column) -> Column:
    """Words and numbers, filler words removed; repeats stay."""
    parts = F.split(normalised, "[^a-z0-9.,]+")
    return F.filter(parts, lambda t: (t != "") & ~t.isin(STOP_WORDS))


def unit_tokens(normalised: Column) -> Column:
    found = F.regexp_extract_all(normalised, F.lit(UNIT_TOKEN), F.lit(0))
    return F.transform(found, lambda t: F.regexp_replace(t, f"{SPACE}+", " "))
