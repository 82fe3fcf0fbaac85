"""Which parser reads a page: parsers by key, teams mapped to keys, and one output for all of them.

A parser is a pair of functions of the same columns, for schedules and for box scores; parsers
without box scores of their own hand them to another one. Pages of teams whose platform or key
has no parser aren't lost: they come out with the outcome ``no parser``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.operators.identity import small_side

from . import box, schedule

#: Fixed platform name that the parser at hand reads.
SUPPORTED = "sidearm"


@dataclass(frozen=True)
class Parser:
    """``schedules``: rows of raw pages to ``read_pages`` rows; ``boxes``: raw box pages to ``read_boxes`` rows; None: what ``delegate`` has."""

    schedules: Callable[[DataFrame], DataFrame]
    boxes: Callable[[DataFrame], DataFrame] | None = None
    delegate: str | None = None


@dataclass
class Registry:
    parsers: dict[str, Parser] = field(default_factory=lambda: {SUPPORTED: Parser(schedule.read_pages, box.read_boxes)})
    teams: dict[str, str] = field(default_factory=dict)
    default: str = "not-implemented"

    def register(self, key: str, parser: Parser) -> None:
        self.parsers[key] = parser

    def map_team(self, team_id: str, key: str) -> None:
        self.teams[team_id] = key

    def boxes_of(self, key: str) -> Callable[[DataFrame], DataFrame] | None:
        """The box-score function of a key, through its delegates; None where there is none, or they go in a circle."""
        passed = set()
        while key in self.parsers and key not in passed:
            passed.add(key)
            parser = self.parsers[key]
            if parser.boxes:
                return parser.boxes
            key = parser.delegate or ""
        return None

    def key_of(self, team_id: Column, parser_key: Column | None = None) -> Column:
        """A team's own key, else the one its row names, else the default."""
        mapped = F.create_map(*[F.lit(x) for pair in self.teams.items() for x in pair]) if self.teams else None
        own = F.lit(None).cast("string") if mapped is None else F.try_element_at(mapped, team_id)
        return F.coalesce(own, parser_key if parser_key is not None else F.lit(None).cast("string"), F.lit(self.default))


def routed(pages: DataFrame, teams: DataFrame, registry: Registry, platforms: tuple[str, ...] = (SUPPORTED,)) -> DataFrame:
    """``pages`` (with team_id) and ``route``: the parser's key, null where no parser reads them.

    ``teams``: team_id, platform_guess, parser_key. A page without a team, or of a team on
    another platform, has no parser.
    """
    side = teams.select("team_id", F.col("platform_guess").alias("_platform"), F.col("parser_key").alias("_key"))
    rows = pages.join(small_side(side), "team_id", "left")
    key = registry.key_of(F.col("team_id"), F.col("_key"))
    known = F.coalesce(F.col("_platform").isin(*platforms) & key.isin(*registry.parsers), F.lit(False))
    return rows.withColumn("route", F.when(known, key)).drop("_platform", "_key")


def read_routed(pages: DataFrame, registry: Registry) -> DataFrame:
    """What ``read_pages`` finds, with ``route``; each page goes to its own parser once, those without one come out empty."""
    parts = [parser.schedules(pages.where(F.col("route") == key)).withColumn("route", F.lit(key)) for key, parser in registry.parsers.items()]
    none = pages.where(F.col("route").isNull()).select("page_id", "team_name", "source_url", F.col("source_url").alias("base_url"), F.col("default_year").cast("string").alias("year"), F.lit(None).cast("string").alias("error"), F.array().cast(schedule.of_html_type()).alias("found"), F.lit(None).cast("string").alias("route"))
    return reduce(DataFrame.unionByName, [*parts, none])


def outcomes(read: DataFrame) -> DataFrame:
    """As ``schedule.outcomes``, with ``no parser`` for pages that have none."""
    said = F.when(F.col("route").isNull(), "no parser").otherwise(F.col("outcome"))
    return schedule.outcomes(read, "route").select("page_id", "source_url", "games", said.alias("outcome"), "route")
