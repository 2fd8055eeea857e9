"""Country codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R
from .text import strip


def encode_country(c: Column) -> Column:
    """"0", "1" or "2" for a known country, the value itself otherwise, null for null."""
    codes = F.create_map(*[F.lit(x) for pair in R.COUNTRIES.items() for x in pair])
    return F.coalesce(F.try_element_at(codes, F.lower(strip(c))), c)
