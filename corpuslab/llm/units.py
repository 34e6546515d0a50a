"""Units of the existing tokenizer: its normalisation and pre-splitting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslab.functions.keys import WS

#: A unit is a maximal run of letters, digits and underscores, or any other single character that is not white space.
UNIT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{WS}]"


def units(text: Column) -> Column:
    """The units of a text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(UNIT), F.lit(0)), F.array().cast("array<string>"))


def unit_count(text: Column) -> Column:
    """The number of units of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(UNIT)), F.lit(0)).cast("long")
