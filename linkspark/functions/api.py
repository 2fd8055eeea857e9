"""The features of one text as a struct, for use in any select."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import address, name
from .address import address_features, city_text
from .name import name_features
from .text import blank, bound, norm_text

NORMALIZED_NAME = ("name_clean", "legal_suffix", "name_core")
COMPONENTS = tuple(f for f in address.FIELDS if f != "address_clean")


def _struct(features: dict[str, Column], fields: tuple[str, ...]) -> Column:
    return F.struct(*(features[k].alias(k) for k in fields))


def normalize_text(text: Column) -> Column:
    return norm_text(text)


def normalize_name(text: Column) -> Column:
    """name_clean, legal_suffix, name_core."""
    return bound(norm_text(text), lambda clean: _struct(name_features(text, clean), NORMALIZED_NAME))


def extract_name_features(text: Column) -> Column:
    """All eleven features of a name."""
    return bound(norm_text(text), lambda clean: _struct(name_features(text, clean), name.FIELDS))


def extract_address_features(text: Column) -> Column:
    """The six components of an address."""
    return bound(city_text(text), lambda city: _struct(address_features(text, blank(text), city), COMPONENTS))


def normalize_address(text: Column) -> Column:
    """The six components and address_clean."""
    both = F.struct(norm_text(text).alias("clean"), city_text(text).alias("city"))
    return bound(both, lambda b: _struct(address_features(text, b["clean"], b["city"]), (*COMPONENTS, "address_clean")))
