"""Season totals, KPIs and dashboard pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.numbers import conversion, per_90, points

COUNTERS = ["minutes", "goals", "assists", "shots", "shots_on_goal", "saves"]


def season_totals(rows: DataFrame, key: str, sums: Mapping[str, Column], first: Sequence[str], order: Column, game: str | None = "game_id") -> DataFrame:
    """games_played counts rows, distinct_games games (not at all without ``game``, which saves the shuffle of all rows); ``first`` columns come from the first row."""
    return rows.groupBy(key).agg(
        *[F.min_by(F.struct(c), order)[c].alias(c) for c in first],
        F.count("*").alias("games_played"),
        *([F.count_distinct(game).alias("distinct_games")] if game else []),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(name) for name, c in sums.items()],
    )


def stats_columns(rows: DataFrame, key: str, stats: Column, most: int = 200) -> DataFrame:
    """An open-ended map of statistics as one column for each name (``stat_`` and the name), by name.

    The names are found in a pass of their own; more than ``most`` of them are an error, as each is a column.
    """
    found = rows.select(F.explode(F.map_keys(stats)).alias("name")).distinct().limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} names of statistics")
    return rows.select(key, *[F.try_element_at(stats, F.lit(n)).alias(f"stat_{n}") for n in sorted(r.name for r in found)])


def team_cards(teams: DataFrame) -> DataFrame:
    """What a team's card shows: name, id and conference."""
    return teams.select(F.col("name_canonical").alias("name"), F.col("team_id").alias("id"), "conference")


def first_rows(rows: DataFrame, order: str, many: int = 5) -> DataFrame:
    """The first rows in file order, as a sample of a report."""
    return rows.orderBy(order).limit(many)


def legacy_sorted(rows: DataFrame, field: str, order: str, descending: bool = True) -> DataFrame:
    """The older dashboard's order: text by the code units of its lower case, ties in file order; an unknown field sorts nothing."""
    if field not in rows.columns:
        return rows.orderBy(order)
    value = F.lower(field) if dict(rows.dtypes)[field] == "string" else F.col(field)
    return rows.orderBy(value.desc() if descending else value.asc(), order)


def with_rates(totals: DataFrame) -> DataFrame:
    return totals.withColumns(
        {
            "g_per_90": per_90(F.col("goals"), F.col("minutes")),
            "a_per_90": per_90(F.col("assists"), F.col("minutes")),
            "conversion_rate": conversion(F.col("goals"), F.col("shots")),
        }
    )


def by_points(totals: DataFrame, *ties: str) -> DataFrame:
    return totals.orderBy(points(F.col("goals"), F.col("assists")).desc(), F.col("minutes").desc(), *ties)


def kpis(totals: DataFrame) -> DataFrame:
    """One row even without players."""
    average = F.when(F.count("*") > 0, F.sum("goals").cast("double") / F.count("*")).otherwise(F.lit(0.0))
    return totals.agg(F.count("*").alias("players"), F.coalesce(F.sum("goals"), F.lit(0)).alias("goals"), average.alias("goals_per_player"))


def best(rows: DataFrame, by: Column, *ties: str) -> DataFrame:
    return rows.orderBy(by.desc(), *ties).limit(1)


def searched(rows: DataFrame, term: str = "", team: str = "all", name: str = "player_name", team_col: str = "team_id") -> DataFrame:
    """Case-insensitive substring of the name or team, and an exact team; an empty term matches all."""
    if term:
        rows = rows.where(F.contains(F.lower(name), F.lit(term.lower())) | F.contains(F.lower(team_col), F.lit(term.lower())))
    return rows if team == "all" else rows.where(F.col(team_col) == team)


def page(rows: DataFrame, by: Sequence[Column], number: int = 1, size: int = 15) -> DataFrame:
    """A page with ``rank`` in the current order; the limit comes first, so only the page's rows are ranked."""
    chosen = rows.orderBy(*by).limit(number * size)
    return chosen.withColumn("rank", F.row_number().over(Window.orderBy(*by))).where(F.col("rank") > (number - 1) * size)


def collated(column: str) -> Column:
    """Locale order, as the dashboard sorts text."""
    return F.collate(F.col(column), "UNICODE")


def dashboard(totals: DataFrame, term: str = "", team: str = "all", sort: str = "goals", descending: bool = True, number: int = 1, size: int = 15) -> dict[str, DataFrame]:
    """KPIs, chart series and one page of the filtered players."""
    rows = with_rates(searched(totals, term, team))
    column = collated(sort) if dict(rows.dtypes)[sort] == "string" else F.col(sort)
    return {
        "kpis": kpis(rows),
        "teams": totals.select("team_id").distinct().orderBy("team_id"),
        "top_scorer": best(rows, F.col("goals"), "player_key"),
        "most_efficient": best(rows.where("goals >= 3"), F.col("conversion_rate"), "player_key"),
        "top_goals": rows.orderBy(F.desc("goals"), "player_key").limit(10),
        "top_contributors": rows.orderBy((F.col("goals") + F.col("assists")).desc(), "player_key").limit(10),
        "efficiency": rows.where("shots >= 5").select("player_name", "shots", "goals", (F.col("goals") / F.col("shots") > 0.2).alias("efficient")),
        "per_90": rows.where("minutes > 300").select("player_name", "g_per_90", "a_per_90"),
        "page": page(rows, [column.desc() if descending else column.asc(), F.col("player_key")], number, size),
        "pages": rows.agg(F.ceil(F.count("*") / size).alias("pages")),
    }
