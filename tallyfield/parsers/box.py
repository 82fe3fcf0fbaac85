"""Player rows from landed box-score pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import numbers, text

from . import pages

CELLS = "array<struct<layout:string,position_in_page:int," + ",".join(f"{c}:string" for c in pages.PLAYER) + ">>"
READ = f"struct<error:string,cells:{CELLS}>"
COUNTERS = ["goals", "assists", "shots", "shots_on_goal", "saves"]


def read_boxes(raw: DataFrame) -> DataFrame:
    """``raw`` (game_id, body) with ``cells``, raw player rows, and ``error`` instead of the body."""
    read = F.udf(pages.box_cells, READ, useArrow=True).asNondeterministic()  # read once, whatever is filtered later
    return raw.withColumn("_read", read("body")).select(*[c for c in raw.columns if c != "body"], "_read.error", "_read.cells")


def players_of(read: DataFrame) -> DataFrame:
    """One row for each listed player; a goalkeeper may be listed twice. Rows without a player name are dropped."""
    kept = [c for c in read.columns if c not in ("error", "cells")]
    found = read.select(*kept, F.explode("cells").alias("c")).select(*kept, "c.*")
    team = F.when(F.col("layout") == "payload", F.col("team")).otherwise(text.team_before_dash(F.col("team")))
    whole = F.col("layout") == "classic"
    played = F.when(whole, numbers.int_or_zero(F.col("minutes")).cast("double")).otherwise(numbers.minutes(F.col("minutes")))
    rows = found.withColumns({"team_id": team, "player_name": text.clean_player_name(F.col("player")), "minutes": played} | {c: numbers.int_or_zero(F.col(c)) for c in COUNTERS})
    rows = rows.where(F.coalesce("player_name", F.lit("")) != "")
    key = text.player_key(F.col("team_id"), F.col("player_name"))
    return rows.select(*kept, "team_id", "player_name", key.alias("player_key"), F.nullif("jersey", F.lit("")).alias("jersey_number"), "position", "minutes", *COUNTERS, "layout", "position_in_page")


def parse_boxes(raw: DataFrame) -> DataFrame:
    """``raw``: game_id, body. Null, empty and unknown pages, and pages that can't be read, give no rows."""
    return players_of(read_boxes(raw))


def best_pages(games: DataFrame, documents: DataFrame) -> DataFrame:
    """The page read for each game with a box score: game_id, url, priority, error, cells, each page read once.

    Of a game's documents (url, priority, body) the one of the smallest priority that lists players
    counts, else the first; a game without a document has nulls.
    """
    wanted = games.where(F.coalesce("boxscore_url", F.lit("")) != "").select("game_id", F.col("boxscore_url").alias("url"))
    read = read_boxes(wanted.join(documents, "url", "left").select("game_id", "url", "priority", "body"))
    rank = F.struct((F.size("cells") == 0).alias("none"), F.col("priority").isNull().alias("missing"), "priority")
    return read.groupBy("game_id").agg(F.min_by(F.struct("url", "priority", "error", "cells"), rank).alias("b")).select("game_id", "b.*")


def parse_games(games: DataFrame, documents: DataFrame) -> DataFrame:
    """Player rows of games with a box score: games (game_id, boxscore_url), documents (url, priority, body)."""
    return players_of(best_pages(games, documents)).drop("url", "priority")


def missing_boxes(best: DataFrame) -> DataFrame:
    """game_id, url, reason: the games of ``best_pages`` without a player row, and why."""
    named = F.exists("cells", lambda c: F.coalesce(text.clean_player_name(c["player"]), F.lit("")) != "")
    reason = F.when(F.col("priority").isNull(), "no page").when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).otherwise("no players")
    return best.where(~F.coalesce(named, F.lit(False))).select("game_id", "url", reason.alias("reason"))
