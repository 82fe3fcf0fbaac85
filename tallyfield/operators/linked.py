"""Linked data of a page merged into the games that its layouts show: a fold whose keys change.

Each event, in order, goes to the first game of its page with the same two teams, or with teams of
likely the same names on the same or an unknown date. It fills what that game lacks: an unknown
date (which gives the game a new key, and a place at the end), an unknown side, a missing pair of scores, the
final status, a missing link. A game whose new key another one has replaces that one. An event
without a game becomes one, which later events find. All in Spark's own expressions over two arrays
for each page, whose size is that of the page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import dates, text


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value made once."""
    return F.transform(F.array(value), then)[0]


def matches(game: Column, event: Column) -> Column:
    likely = lambda a, b: text.forms_likely_match(game[a], event[b])
    same_date = (game["row"]["date"] == event["row"]["date"]) | ~dates.is_known(game["row"]["date"])
    loose = (likely("home", "home") & likely("away", "away")) | (likely("home", "away") & likely("away", "home"))
    return F.coalesce((game["teams"] == event["teams"]) | (same_date & loose), F.lit(False))  # the cheaper test first


def filled(game: Column, event: Column, names: list[str], prefix: str) -> Column:
    """The game, whose row has the columns ``names``, with what the event adds."""
    g, e = game["row"], event["row"]
    fix = ~dates.is_known(g["date"]) & (F.coalesce(e["date"], F.lit("")) != "")
    date = F.when(fix, e["date"]).otherwise(g["date"])
    scored = lambda x: x["home_score"].isNotNull() & x["away_score"].isNotNull()
    take = ~scored(g) & scored(e)
    new = {
        "date": date,
        "date_is_known": dates.is_known(date),
        "game_id": F.when(fix, text.game_id(date, g["home_team_name"], g["away_team_name"], prefix)).otherwise(g["game_id"]),
        "dedupe_key": F.when(fix, text.dedupe_key(date, g["home_team_name"], g["away_team_name"])).otherwise(g["dedupe_key"]),
        "home_score": F.when(take, e["home_score"]).otherwise(g["home_score"]),
        "away_score": F.when(take, e["away_score"]).otherwise(g["away_score"]),
        "location_type": F.when((g["location_type"] == "unknown") & (e["location_type"] != "unknown"), e["location_type"]).otherwise(g["location_type"]),
        "status": F.when(g["status"].isin("scheduled", "unknown") & (e["status"] == "final"), e["status"]).otherwise(g["status"]),
        "boxscore_url": F.coalesce(F.nullif(g["boxscore_url"], F.lit("")), F.nullif(e["boxscore_url"], F.lit("")), g["boxscore_url"]),
    }
    row = F.struct(*[new.get(c, g[c]).alias(c) for c in names])
    return F.struct(row.alias("row"), *[game[c].alias(c) for c in ("home", "away", "teams")])


def step(games: Column, event: Column, names: list[str], prefix: str) -> Column:
    at = F.array_position(F.transform(games, lambda g: matches(g, event)), True)

    def placed(found: Column) -> Column:
        old = F.element_at(games, found.cast("int"))

        def with_new(new: Column) -> Column:
            key = lambda g: g["row"]["dedupe_key"]
            others = F.filter(games, lambda g, i: i + 1 != found)
            replaced = F.transform(others, lambda g: F.when(key(g) == key(new), new).otherwise(g))
            moved = F.when(F.exists(others, lambda g: key(g) == key(new)), replaced).otherwise(F.concat(others, F.array(new)))
            stays = F.transform(games, lambda g, i: F.when(i + 1 == found, new).otherwise(g))
            return F.when(key(new) == key(old), stays).otherwise(moved)

        return F.when(found == 0, F.concat(games, F.array(event))).otherwise(let(filled(old, event, names, prefix), with_new))

    return let(at, placed)


def fold_linked(shown: DataFrame, prefix: str = "game") -> DataFrame:
    """``shown``: (page_id, place, game), where linked data has the layout ``linked``; the games of each page, with ``page_id``."""
    names = shown.schema["game"].dataType.names
    listed = lambda linked: F.sort_array(F.collect_list(F.when((F.col("game.layout") == "linked") == linked, F.struct("place", "game"))))
    pages = shown.groupBy("page_id").agg(listed(False).alias("games"), listed(True).alias("events"))

    def entry(game: Column) -> Column:
        home, away = game["home_team_name"], game["away_team_name"]
        return F.struct(game.alias("row"), text.name_forms(home).alias("home"), text.name_forms(away).alias("away"), text.team_set(home, away).alias("teams"))

    # only pages with events need more of a game than its row
    entries = lambda listed: F.transform(listed, lambda x: entry(x["game"]))
    fold = F.aggregate(entries("events"), entries("games"), lambda games, event: step(games, event, names, prefix))
    rows = F.when(F.size("events") == 0, F.transform("games", lambda x: x["game"])).otherwise(F.transform(fold, lambda x: x["row"]))
    return pages.select("page_id", F.explode(rows).alias("g")).select("page_id", "g.*")
