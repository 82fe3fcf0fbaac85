"""Dates from page text, kept as ``YYYY-MM-DD`` strings; ``YYYY-01-01`` means unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_NAMED = r"(?i)\b(" + "|".join(MONTHS) + r")[a-z]*\.? +([0-9]{1,2})(?:[a-z]{2})?(?:,? +([0-9]{4}))?"
_SLASHED = r"([0-9]{1,2})/([0-9]{1,2})(?:/([0-9]{4}|[0-9]{2}))?"


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_date(text: Column, year: Column) -> Column:
    """ISO date, then month/day[/year], then month name and day [and year], then 1 January of ``year``."""
    return parse_plain(without_notes(text), year)


def without_notes(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\([^)]*\)", " ")


def parse_plain(plain: Column, year: Column) -> Column:
    """``parse_date`` of a text without notes in brackets."""
    default = year.cast("string")
    iso = _found(plain, r"([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
    short = _found(plain, _SLASHED, 3)
    slash_year = F.when(F.length(short) == 2, F.concat(F.lit("20"), short)).otherwise(F.coalesce(short, default))
    slashed = F.concat_ws("-", slash_year, F.lpad(F.regexp_extract(plain, _SLASHED, 1), 2, "0"), F.lpad(F.regexp_extract(plain, _SLASHED, 2), 2, "0"))
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.regexp_extract(plain, _NAMED, 1)))
    named = F.concat_ws("-", F.coalesce(_found(plain, _NAMED, 3), default), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(plain, _NAMED, 2), 2, "0"))
    return F.coalesce(iso, F.when(plain.rlike(_SLASHED), slashed), F.when(month > 0, named), F.concat(default, F.lit("-01-01")))


def is_known(date: Column) -> Column:
    return ~F.endswith(date, F.lit("-01-01"))


def season(date: Column, fallback: str = "unknown") -> Column:
    found = F.substring_index(date, "-", 1)
    return F.when(F.coalesce(found, F.lit("")) == "", F.lit(fallback)).otherwise(found)


def utc_date(instant: Column) -> Column:
    """The date in UTC of an instant with an offset; null where it is none (the session runs in UTC)."""
    return F.date_format(F.try_to_timestamp(instant), "yyyy-MM-dd")


def before_time(text: Column) -> Column:
    return F.substring_index(text, "T", 1)
