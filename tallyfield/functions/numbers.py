"""Numbers from text, and the derived metrics of a player."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trimmed


def parse_int(text: Column) -> Column:
    """The leading integer, null where there is none."""
    digits = F.regexp_extract(F.coalesce(text, F.lit("")), f"^[{WS}]*([+-]?[0-9]+)", 1)
    return F.nullif(digits, F.lit("")).try_cast("bigint")  # a failed cast costs an exception


def int_or_zero(text: Column) -> Column:
    return F.coalesce(parse_int(text), F.lit(0).cast("bigint"))


def to_number(text: Column) -> Column:
    """The whole text as a number; an empty text is 0, anything else null."""
    return F.when(trimmed(text) == "", F.lit(0.0)).otherwise(trimmed(text).try_cast("double"))


def minutes(text: Column) -> Column:
    """``MM:SS`` in minutes, else the number left without other characters, else 0."""
    clock = F.split(trimmed(text), ":")
    timed = int_or_zero(F.get(clock, F.lit(0))) + int_or_zero(F.get(clock, F.lit(1))) / F.lit(60.0)
    plain = F.regexp_replace(text, "[^0-9.]", "").try_cast("double")
    return F.coalesce(F.when(F.contains(text, F.lit(":")), timed).otherwise(plain), F.lit(0.0))


def or_one(x: Column) -> Column:
    return F.when(F.coalesce(x, F.lit(0)) == 0, F.lit(1)).otherwise(x)


def per_90(count: Column, played: Column) -> Column:
    return count.cast("double") / or_one(played) * 90


def conversion(goals: Column, shots: Column) -> Column:
    """Goals of shots in percent; 0 without shots."""
    return F.when(shots > 0, goals.cast("double") / shots * 100).otherwise(F.lit(0.0))


def points(goals: Column, assists: Column) -> Column:
    return 2 * goals + assists


def grouped(x: Column) -> Column:
    return F.format_number(x, 0)


def fixed(x: Column, digits: int) -> Column:
    """Exact binary value, ties away from zero; for the edge only, results keep raw doubles."""
    step = Decimal(1).scaleb(-digits)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if pd.isna(v) else str(Decimal(v).quantize(step, ROUND_HALF_UP)))

    return run(x.cast("double"))


def duration(ms: Column) -> Column:
    """``HH:MM:SS`` of milliseconds, rounded down."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
