"""Key and whitespace normalisation shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: every character that counts as white space, for a Java character class.
WS = r"\s\p{Z}\x0B\x1C-\x1F\x85"


def strip(text: Column) -> Column:
    """Without outer white space of any kind; null stays null."""
    return F.regexp_replace(text, rf"^[{WS}]+|[{WS}]+$", "")


def norm_key(text: Column) -> Column:
    """A key for comparison: outer spaces and case do not count, and a blank key is null."""
    key = F.lower(strip(text))
    return F.when(F.length(key) > 0, key)


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only texts."""
    return F.coalesce(~F.rlike(text, F.lit(rf"[^{WS}]")), F.lit(True))
