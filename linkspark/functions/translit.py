"""Indic scripts to Latin (ITRANS, folded).

The nine blocks from U+0900 to U+0D7F are laid out alike, so a character's place in its block tells its sound. A
consonant carries an a unless a vowel sign or a virama follows. The result is folded: no case, no marks.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import blank, has_nonlatin

# ITRANS by place in the block (letters, vowel signs, other signs).
VOWELS = dict(enumerate("a A i I u U RRi LLi E e e ai O o o au".split(), 0x05))
CONSONANTS = dict(enumerate("k kh g gh ~N ch Ch j jh ~n T Th D Dh N t th d dh n nn p ph b bh m y r rr l L zh v sh Sh s h".split(), 0x15))
NUKTA = dict(enumerate("q K G z .D .Dh f Y".split(), 0x58))
SIGNS = dict(enumerate("A i I u U RRi RRI E e e ai O o o au".split(), 0x3E)) | {0x62: "LLi", 0x63: "LLI", 0x56: "ai", 0x57: "au"}
OTHER = {0x01: ".N", 0x02: "M", 0x03: "H", 0x3D: ".a", 0x50: "OM", 0x60: "RRI", 0x61: "LLI", 0x64: ".", 0x65: "..", 0x70: "M", 0x71: ""} | {0x66 + d: str(d) for d in range(10)}
CHILLU = {0x7A: "N", 0x7B: "n", 0x7C: "r", 0x7D: "l", 0x7E: "L", 0x7F: "k"}  # Malayalam
VIRAMA, NUKTA_SIGN, ADDAK = 0x4D, 0x3C, 0x71
WITH_NUKTA = {"k": "q", "kh": "K", "g": "G", "j": "z", "D": ".D", "Dh": ".Dh", "ph": "f", "y": "Y"}
RUNS = re.compile("|".join(f"[{chr(0x900 + 0x80 * k)}-{chr(0x97F + 0x80 * k)}]+" for k in range(9)))


# The scripts of the nine blocks in order.
SCRIPTS = ("DEVANAGARI", "BENGALI", "GURMUKHI", "GUJARATI", "ORIYA", "TAMIL", "TELUGU", "KANNADA", "MALAYALAM")


def script_of(c: Column) -> Column:
    """(script, scheme) of the first character of a text, both null if it is of none of the nine scripts."""
    block = F.floor((F.ascii(c) - 0x900) / 0x80)
    name = F.get(F.array(*map(F.lit, SCRIPTS)), F.when((block >= 0) & (c != ""), block).cast("int"))
    return F.struct(name.alias("script"), F.lower(name).alias("scheme"))


def itrans(run: str) -> str:
    """One run of one script, not folded."""
    malayalam = ord(run[0]) >= 0xD00
    out, i, double = [], 0, False
    while i < len(run):
        p = ord(run[i]) & 0x7F
        i += 1
        sound = CONSONANTS.get(p) or NUKTA.get(p)
        if sound is None:
            double = p == ADDAK and 0xA00 <= ord(run[0]) < 0xA80
            out.append(CHILLU[p] if malayalam and p in CHILLU else "" if double else VOWELS.get(p) or SIGNS.get(p) or OTHER.get(p, ""))
            continue
        after = ord(run[i]) & 0x7F if i < len(run) else -1
        if after == NUKTA_SIGN:
            sound = WITH_NUKTA.get(sound, sound)
            i += 1
            after = ord(run[i]) & 0x7F if i < len(run) else -1
        if double:
            out.append(sound[0])
            double = False
        out.append(sound)
        if after == VIRAMA:
            i += 1
        elif after in SIGNS:
            out.append(SIGNS[after])
            i += 1
        else:
            out.append("a")
    return "".join(out)


def folded(s: str) -> str:
    plain = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))
    return " ".join(plain.split()).casefold()


def transliterate(value: str | None) -> str:
    """Runs of Indic scripts in Latin letters, the rest as it is; null as ''."""
    return RUNS.sub(lambda m: folded(itrans(m[0])), value or "")


@F.pandas_udf(StringType())
def _transliterate(values: pd.Series) -> pd.Series:
    seen = {v: transliterate(v) for v in set(values.dropna())}
    return pd.Series([seen.get(v) for v in values], dtype=object)


def transliterated(c: Column) -> Column:
    """Only values with Indic characters go through Python."""
    return F.coalesce(_transliterate(F.when(has_nonlatin(c) == 1, c)), blank(c))
