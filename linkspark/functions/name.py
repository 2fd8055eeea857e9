"""Business-name features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import blank, collapse, numbers, tokens

FIELDS = ("name_clean", "name_tokens", "name_core", "legal_suffix", "domain", "domain_core", "has_dba", "has_fka", "has_aka", "name_numbers", "is_domain_like")
VARIANT_FIELDS = tuple(f for f in FIELDS if not f.startswith(("has_", "is_")))


def legal_suffix(clean: Column) -> Column:
    """Canonical form of the one trailing legal suffix of a normalised name, or ''."""
    bare = F.regexp_replace(F.regexp_extract(clean, R.SUFFIX, 1), r"^\.+|\.+$", "")
    known = F.create_map(*[F.lit(x) for pair in R.LEGAL_SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, bare), bare)


def name_core(clean: Column) -> Column:
    return collapse(F.regexp_replace(clean, R.SUFFIX, ""))


def domain(raw: Column) -> Column:
    """The first domain-like run of the text as written, in lower case, or ''."""
    return F.lower(F.regexp_extract(blank(raw), R.DOMAIN, 0))


def domain_core(found: Column) -> Column:
    return F.regexp_replace(found, r"\.[^.]*$", "")


def flag(raw: Column, pattern: str) -> Column:
    return blank(raw).rlike(pattern).cast("int")


def name_features(raw: Column, clean: Column) -> dict[str, Column]:
    """All features of a name; clean is its materialised norm_text."""
    found = domain(raw)
    return {
        "name_clean": clean, "name_tokens": tokens(clean), "name_core": name_core(clean), "legal_suffix": legal_suffix(clean),
        "domain": found, "domain_core": domain_core(found), "has_dba": flag(raw, R.DBA), "has_fka": flag(raw, R.FKA),
        "has_aka": flag(raw, R.AKA), "name_numbers": numbers(raw), "is_domain_like": found != "",
    }
