"""Business-address features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import all_matches, blank, norm_text

FIELDS = ("address_clean", "address_numbers", "street_number", "unit_number", "postal_code", "state_code", "city_tokens")


def address_numbers(raw: Column) -> Column:
    """Number runs with ranges split at - and /."""
    return F.flatten(F.transform(all_matches(blank(raw), R.NUMBER), lambda x: F.split(x, "[-/]")))


def street_number(numbers: Column) -> Column:
    """The first number of one to four digits, else the first number, else ''."""
    return F.coalesce(F.get(F.filter(numbers, lambda x: F.length(x) <= 4), F.lit(0)), F.get(numbers, F.lit(0)), F.lit(""))


def postal_code(raw: Column) -> Column:
    return F.upper(F.regexp_replace(F.regexp_extract(blank(raw), R.POSTAL, 0), f"-|{R.S}", ""))


def unit_number(raw: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(blank(raw), R.UNIT, 0), R.UNIT_LABEL, ""))


def state_code(raw: Column) -> Column:
    """The first state key, in the order of the list, that occurs as a whole word; upper case, or ''."""
    rank = F.create_map(*[F.lit(x) for place, s in enumerate(R.STATES) for x in (s, place)])
    first = F.array_min(F.transform(all_matches(blank(raw), R.STATE), lambda hit: F.try_element_at(rank, F.lower(hit))))
    return F.upper(F.coalesce(F.get(F.array(*map(F.lit, R.STATES)), first), F.lit("")))


def city_text(raw: Column) -> Column:
    """The address without numbers, postal codes, state words and units, removed in this order."""
    out = blank(raw)
    for pattern in (R.NUMBER, R.POSTAL, R.STATE, R.UNIT):
        out = F.regexp_replace(out, pattern, "")
    return norm_text(out)


def city_tokens(city: Column) -> Column:
    """Words of a materialised city_text, without non-word characters at their ends, longer than one character."""
    bare = F.transform(F.split(city, " "), lambda x: F.regexp_replace(x, R.EDGES, ""))
    return F.filter(bare, lambda x: F.length(x) > 1)


def address_features(raw: Column, clean: Column, city: Column) -> dict[str, Column]:
    """All features of an address; clean and city are its materialised norm_text and city_text."""
    found = address_numbers(raw)
    return {
        "address_clean": clean, "address_numbers": found, "street_number": street_number(found), "unit_number": unit_number(raw),
        "postal_code": postal_code(raw), "state_code": state_code(raw), "city_tokens": city_tokens(city),
    }
