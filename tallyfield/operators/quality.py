"""Data-quality filters, profiles and inventory checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfield.functions.text import collapsed, dedupe_key

from .merge import last_values_first_place

PLATFORMS = ["sidearm", "presto", "wmt", "custom", "unknown"]


def is_placeholder_team(name: Column) -> Column:
    name = F.coalesce(name, F.lit(""))
    return (name == "") | name.rlike("(?i)unknown|home team|away team")


def profile(games: DataFrame, date: Column, home_score: Column, away_score: Column, status: Column) -> DataFrame:
    scored = home_score.isNotNull() & away_score.isNotNull()
    return games.agg(
        F.count("*").alias("total"),
        F.count_if(F.endswith(date, F.lit("-01-01"))).alias("unknown_dates"),
        F.count_if(scored).alias("scored"),
        F.count_if((status == "final") & ~scored).alias("final_without_score"),
    )


def report(games: DataFrame, order: str, samples: int = 5) -> DataFrame:
    """One row: the profile, percentages with one digit, and the first games of two kinds in file order."""
    scored = F.col("home_score").isNotNull() & F.col("away_score").isNotNull()
    line = F.concat(F.col("date"), F.lit(" - "), F.col("home_team_name"), F.lit(" vs "), F.col("away_team_name"))
    kinds = {"with_scores": scored, "final_without": (F.col("status") == "final") & ~scored}
    out = profile(games, F.col("date"), F.col("home_score"), F.col("away_score"), F.col("status"))
    share = lambda c: F.round(F.when(F.col("total") > 0, F.col(c) * 100 / F.col("total")).otherwise(F.lit(0.0)), 1)
    out = out.withColumns({"unknown_dates_percent": share("unknown_dates"), "scored_percent": share("scored")})
    for name, kind in kinds.items():
        first = games.where(kind).orderBy(order).limit(samples)
        lines = first.agg(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]).alias(name))
        out = out.crossJoin(F.broadcast(lines))  # one row each
    return out


def clean_games(games: DataFrame, order: str, placeholders: dict[str, str] | None = None) -> DataFrame:
    """Without placeholder teams and placeholder dates (team pattern to date), last row of each rebuilt key, by date."""
    for side in ("home_team_name", "away_team_name"):
        games = games.where(~is_placeholder_team(F.col(side))).withColumn(side, collapsed(F.col(side)))
    for pattern, date in (placeholders or {}).items():
        named = F.col("home_team_name").rlike(pattern) | F.col("away_team_name").rlike(pattern)
        games = games.where(~(named & (F.col("date") == date)))
    keyed = games.withColumn("dedupe_key", dedupe_key(F.col("date"), F.col("home_team_name"), F.col("away_team_name")))
    return last_values_first_place(keyed, ["dedupe_key"], [order])


def inventory_errors(teams: DataFrame) -> DataFrame:
    """team_id and its errors: missing fields, a repeated id, an unknown platform, a bad link."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("team_id", "schedule_url", "platform_guess", "parser_key")]
    repeated = F.when(F.count("*").over(Window.partitionBy("team_id")) > 1, F.lit("team_id is repeated"))
    platform = F.when(~F.col("platform_guess").isin(PLATFORMS), F.lit("platform_guess is unknown"))
    link = F.when(~F.col("schedule_url").rlike("^https?://[^/ ]+"), F.lit("schedule_url is no link"))
    errors = F.array_compact(F.array(*missing, repeated, platform, link))
    return teams.select("team_id", errors.alias("errors")).where(F.size("errors") > 0)
