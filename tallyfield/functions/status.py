"""Status, side and score of a game as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import parse_int


def status_of_code(code: Column, result: Column) -> Column:
    """Platform codes: O or any result is final, P postponed, C canceled."""
    return (
        F.when((code == "O") | (F.coalesce(result, F.lit("")) != ""), "final")
        .when(code == "P", "postponed")
        .when(code == "C", "canceled")
        .otherwise("scheduled")
    )


def status_of_text(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.rlike(r"[0-9]+\s*-\s*[0-9]+") | F.contains(low, F.lit("final")), "final")
        .when(F.contains(low, F.lit("post")), "postponed")
        .when(F.contains(low, F.lit("canc")), "canceled")
        .otherwise("scheduled")
    )


def location(indicator: Column) -> Column:
    return F.when(indicator == "H", "home").when(indicator == "A", "away").when(indicator == "N", "neutral").otherwise("unknown")


def scores(text: Column, context_is_home: Column) -> Column:
    """struct(home, away) of ``a-b``, where the context team's score comes first."""
    first, second = (parse_int(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"([0-9]+)\s*-\s*([0-9]+)", i), F.lit(""))) for i in (1, 2))
    return F.struct(F.when(context_is_home, first).otherwise(second).alias("home"), F.when(context_is_home, second).otherwise(first).alias("away"))
