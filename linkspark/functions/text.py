"""General text functions (Column -> Column)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def blank(c: Column) -> Column:
    """Null as ''."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{R.S}+|{R.S}+$", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(strip(c), f"{R.S}+", " ")


def _icu(cls: str, method: str, c: Column) -> Column:
    return F.reflect(F.lit(f"com.ibm.icu.{cls}"), F.lit(method), c, F.lit(True))


def casefold(c: Column) -> Column:
    """Full case folding; ASCII text takes the short way. Materialise the result before filters or joins: the
    optimizer treats the call into ICU as nondeterministic."""
    return F.when(c.rlike(r"[^\x00-\x7F]"), _icu("lang.UCharacter", "foldCase", c)).otherwise(F.lower(c))


def norm_text(c: Column) -> Column:
    """NFKC, & as and, case folding, stripped, white space collapsed; null as ''."""
    c = blank(c)
    composed = F.when(c.rlike(r"[^\x00-\x7F]"), _icu("text.Normalizer", "compose", c)).otherwise(c)
    return collapse(casefold(F.replace(composed, F.lit("&"), F.lit("and"))))


def all_matches(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def tokens(clean: Column) -> Column:
    return all_matches(clean, R.WORD)


def numbers(raw: Column) -> Column:
    """Number runs; ranges such as 24/7 stay whole."""
    return all_matches(blank(raw), R.NUMBER)


def parse_list(c: Column) -> Column:
    """A list written as text, such as ['a', 'b']: brackets and quotes go, what is between commas is stripped. An empty
    list gives one empty element."""
    inner = F.regexp_replace(F.regexp_replace(strip(c), r"^[\[\]]+|[\[\]]+$", ""), "['\"]", "")
    return F.transform(F.split(inner, ","), strip)


def char_grams(c: Column, n: int = 4) -> Column:
    """The different runs of n characters of a text; of a shorter one the text itself, of a blank one nothing."""
    c = blank(c)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def has_nonlatin(c: Column) -> Column:
    """1 if an Indic character occurs (other scripts don't count), else 0."""
    return blank(c).rlike(R.INDIC).cast("int")
