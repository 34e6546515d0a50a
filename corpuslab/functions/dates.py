"""Dates in several notations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English month names by their first three letters.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

_NAME = r"((?i:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?))"
_TIME = r"(?:[T ]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)? *(?:(?i:z|utc|am|pm)|[+-]\d{2}:?\d{2})?)?"
_YMD = rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
_DMY = rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}){_TIME}$"
_D_MONTH_Y = rf"^(\d{{1,2}})\.? +{_NAME}\.?,? +(\d{{4}})$"
_MONTH_D_Y = rf"^{_NAME}\.? +(\d{{1,2}}),? +(\d{{4}})$"


def _month(name: Column) -> Column:
    short = F.lower(F.substring(name, 1, 3))
    return F.array_position(F.array(*[F.lit(m) for m in MONTHS]), short).cast("string")


def date_as_written(text: Column, is_number: Column) -> Column:
    """The calendar date a text names, as YYYY-MM-DD; null if it names none.

    Year first or day before month when the year is last; English month names; a time of day after the date is dropped
    without any change of zone. Where `is_number` is true the value is seconds since 1970 in UTC. Dates that do not exist
    (31 February) give null.
    """
    t = F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")

    def group(pattern: str, i: int) -> Column:
        return F.regexp_extract(t, pattern, i)

    def iso(y: Column, m: Column, d: Column) -> Column:
        return F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))

    written = (
        F.when(t.rlike(_YMD), iso(group(_YMD, 1), group(_YMD, 2), group(_YMD, 3)))
        .when(t.rlike(_COMPACT), iso(group(_COMPACT, 1), group(_COMPACT, 2), group(_COMPACT, 3)))
        .when(t.rlike(_DMY), iso(group(_DMY, 3), group(_DMY, 2), group(_DMY, 1)))
        .when(t.rlike(_D_MONTH_Y), iso(group(_D_MONTH_Y, 3), _month(group(_D_MONTH_Y, 2)), group(_D_MONTH_Y, 1)))
        .when(t.rlike(_MONTH_D_Y), iso(group(_MONTH_D_Y, 3), _month(group(_MONTH_D_Y, 1)), group(_MONTH_D_Y, 2)))
    )
    seconds = t.try_cast("double")
    days = F.floor(seconds / 86400).cast("int")
    near = seconds.between(-1e11, 1e11)
    from_number = F.when(near, F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.when(near, days)), "yyyy-MM-dd"))
    valid = F.when(F.try_to_timestamp(written, F.lit("yyyy-MM-dd")).isNotNull(), written)
    return F.when(is_number, from_number).otherwise(valid)
