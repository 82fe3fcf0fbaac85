"""Games from landed pages: cells come from ``pages``, everything else is column expressions.

Each page is read once: ``read_pages`` keeps what was found on it, or what went wrong, and games,
failed pages and counters all come from those rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions import dates, status, text, urls
from tallyfield.operators.linked import fold_linked

from . import pages

CELLS = "array<struct<layout:string,position:int," + ",".join(f"{c}:string" for c in pages.GAME) + ">>"
READ = f"struct<year:string,canonical:string,error:string,cells:{CELLS}>"
PLATFORM_JSON = (
    "array<struct<id:bigint,date:string,type:string,status:string,location:string,location_indicator:string,neutral_hometeam:boolean,"
    "opponent:struct<name:string,image:string>,result:struct<status:string,team_score:string,opponent_score:string,boxscore:string>,schedule:struct<url:string>>>"
)
GAME_COLUMNS = ["game_id", "date", "date_is_known", "home_team_name", "away_team_name", "home_team_ranked", "away_team_ranked", "home_score", "away_score", "location_type", "status", "schedule_url", "boxscore_url", "dedupe_key", "layout", "position"]
#: Pages that a worker reads before it hands on what it found, and their bytes; a page beyond these is read alone.
PAGES_AT_ONCE, BYTES_AT_ONCE = 100, 500_000
#: Later layouts of this list give way to earlier ones for the same game of a page.
PRIORITY = ["payload", "platform", "table", "list", "cards", "scoreboard", "linked"]
#: The order in which a page's layouts are read, which is the order of its games.
READING = ["payload", "platform", "cards", "list", "table", "scoreboard", "linked"]


def place_in(names: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), F.col("layout"))


def read_pages(raw: DataFrame) -> DataFrame:
    """``raw`` (page_id, body, team_name, source_url, default_year) with ``found``, raw games, and ``error``.

    A page is platform JSON, read by Spark's own expressions, or HTML. An array with an element
    that misses a required member counts as no platform array. Filters on pages belong before this.
    """
    is_json = F.coalesce(F.ltrim("body").startswith("["), F.lit(False))
    array = F.from_json(F.when(is_json, F.col("body")), PLATFORM_JSON)
    whole = F.forall(array, lambda g: g["id"].isNotNull() & g["date"].isNotNull() & g["type"].isNotNull() & g["opponent"]["name"].isNotNull())
    # not deterministic, or else filters on what is found would read the page again
    read = F.arrow_udf(_read_html, READ).asNondeterministic()(F.when(~is_json, F.col("body")))
    rows = raw.select("page_id", "team_name", "source_url", F.col("default_year").cast("string").alias("default_year"), F.when(whole, array).alias("p"), read.alias("r"))

    # the first schedule link so far tells the site; each link is looked at once a page
    rows = rows.withColumn("origins", F.transform("p", lambda x: urls.origin(x["schedule"]["url"])))
    rows = rows.withColumn("first", F.nullif(F.array_position(F.transform("origins", lambda o: o != ""), True), F.lit(0)))
    rows = rows.withColumn("site", F.try_element_at("origins", F.col("first").cast("int")))
    seen_base = lambda i: F.coalesce(F.when(i + 1 >= F.col("first"), F.col("site")), F.lit(""))

    no_cell, no_game = F.lit(None).cast(CELLS.removeprefix("array<").removesuffix(">")), F.lit(None).cast(PLATFORM_JSON.removeprefix("array<").removesuffix(">"))
    of_html = F.transform("r.cells", lambda c: F.struct(c.alias("c"), no_game.alias("g"), F.lit("").alias("base"), c["position"].alias("position")))
    of_json = F.transform("p", lambda g, i: F.struct(no_cell.alias("c"), g.alias("g"), seen_base(i).alias("base"), i.alias("position")))
    base = F.coalesce(F.nullif("source_url", F.lit("")), F.col("r.canonical"))
    rows = rows.withColumn("found", F.coalesce(of_json, of_html, F.array().cast(of_html_type())))
    return rows.select("page_id", "team_name", "source_url", base.alias("base_url"), F.coalesce("r.year", "default_year").alias("year"), F.col("r.error").alias("error"), "found")


def _slices(bodies: Iterator[pa.Array]) -> Iterator[list[str | None]]:
    """Few pages at a time, so that what a worker holds beside a batch's pages grows neither with their number nor with their length."""
    for batch in bodies:
        start = size = 0
        for at, n in enumerate(pc.fill_null(pc.binary_length(batch), 0).to_pylist()):
            if at > start and (at - start == PAGES_AT_ONCE or size + n > BYTES_AT_ONCE):
                yield batch.slice(start, at - start).to_pylist()
                start, size = at, 0
            size += n
        if start < len(batch):
            yield batch.slice(start).to_pylist()


def _read_html(bodies: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``pages.read_schedule`` of each page, as READ."""
    for some in _slices(bodies):
        years, links, errors, cells = zip(*map(pages.read_schedule, some), strict=True)
        ends = pa.array(accumulate(map(len, cells), initial=0), pa.int32())
        found = list(zip(*(game for of_page in cells for game in of_page), strict=True)) or [()] * (len(pages.GAME) + 2)
        columns = [pa.array(x, pa.int32() if i == 1 else pa.string()) for i, x in enumerate(found)]
        games = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, names=["layout", "position", *pages.GAME]))
        yield pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in (years, links, errors)] + [games], names=["year", "canonical", "error", "cells"])


def of_html_type() -> str:
    cell, game = CELLS.removeprefix("array<").removesuffix(">"), PLATFORM_JSON.removeprefix("array<").removesuffix(">")
    return f"array<struct<c:{cell},g:{game},base:string,position:int>>"


def _said_date() -> Column:
    """Dates of attributes, then an ISO date in the row's HTML, then the text; each counts while it isn't unknown."""
    year = F.col("_year")
    tried = F.transform(F.split("c.date_attrs", "\n"), lambda x: dates.parse_date(x, year))
    first = F.when(F.col("c.date_attrs") != "", F.try_element_at(F.filter(tried, dates.is_known), F.lit(1)))
    iso = F.nullif(F.col("c.date_iso"), F.lit(""))
    return F.coalesce(first, F.when(dates.is_known(iso), iso), dates.parse_plain(F.col("_plain"), year))


#: Cells of linked data that name teams.
NAMES = ["left", "right", "home", "away"]


def _likes(forms: str, context: str) -> Column:
    """Which names of linked data are likely the context team's, by the columns of their forms."""
    return F.struct(*[text.forms_likely_match(F.col(f"{forms}.{c}"), F.col(context)).alias(c) for c in NAMES])


def _named(name: Column) -> Column:
    """A team's name as shown, and whether a rank stood before it; ``name`` without doubling."""
    return F.struct(text.without_rank(name).alias("name"), text.starts_with_rank(name).alias("ranked"))


def _opponent() -> tuple[Column, Column]:
    """Opponent and whether the context team is at home, by linked data: its title says more than its teams; null if neither tells."""
    like = lambda c: F.col(f"_like.{c}")
    titled, versus = F.col("c.separator") != "", F.startswith("c.separator", F.lit("vs"))
    right_only = like("right") & ~like("left")
    has = lambda c: F.col(c) != ""
    away_only = ~(like("home") & has("c.away")) & like("away") & has("c.home")
    by_teams = F.when(like("home") & has("c.away"), F.col("c.away")).when(away_only, F.col("c.home")).when(has("c.home") & has("c.away"), F.col("c.away"))
    opponent = F.when(titled, F.when(right_only, F.col("c.left")).otherwise(F.col("c.right"))).otherwise(by_teams)
    home = F.when(titled, F.when(right_only, ~versus).otherwise(versus)).otherwise(~away_only)
    return opponent, home


def games_of(read: DataFrame, prefix: str = "game") -> DataFrame:
    """All games of the pages, as their layouts say them: page_id and GAME_COLUMNS.

    What several columns need is a column of an earlier step, so that it is worked out once a game,
    and what only depends on the page once a page.
    """
    rows = read.withColumns({"_context": F.coalesce("team_name", F.lit("Unknown Team")), "_site": urls.origin(F.col("base_url"))})
    rows = rows.withColumns({"_context_once": text.undoubled(F.col("_context")), "_context_forms": text.name_forms(F.col("_context"))}).withColumn("_context_named", _named(F.col("_context_once")))
    rows = rows.select("page_id", "source_url", "_context", "_context_forms", "_context_named", "_site", "year", F.explode_outer("found").alias("f"))
    # an outer explode, as for an inner one Spark adds a filter on the array that makes it a second time
    rows = rows.where("f.position is not null").select("*", "f.*").drop("f")
    platform, linked, opponent, is_home = (F.col(c) for c in ("_platform", "_linked", "_opponent", "_is_home"))
    # a year within a table's date text beats the page's
    in_text = F.when(F.col("c.layout") == "table", F.nullif(F.regexp_extract("c.date_text", r"\b(20[0-9]{2})\b", 1), F.lit("")))
    rows = rows.withColumns({"_platform": F.col("g").isNotNull(), "_linked": F.coalesce(F.col("c.layout") == "linked", F.lit(False))})
    rows = rows.withColumn("_forms", F.when(linked, F.struct(*[text.name_forms(F.col(f"c.{c}")).alias(c) for c in NAMES])))
    rows = rows.withColumns({"_like": F.when(linked, _likes("_forms", "_context_forms")), "_side": F.coalesce("g.location_indicator", F.lit("H")), "_year": F.coalesce(in_text, "year"), "_plain": F.when(~linked & ~platform, dates.without_notes(F.col("c.date_text")))})
    other, other_home = _opponent()
    side = F.col("_side")
    at_home = F.when(side == "N", F.coalesce("g.neutral_hometeam", F.lit(False))).otherwise(side == "H")
    rows = rows.withColumns(
        {
            "_opponent": F.when(platform, F.coalesce("g.opponent.name", F.lit("Unknown Opponent"))).when(linked, other).otherwise(F.col("c.opponent")),
            "_is_home": F.when(platform, at_home).when(linked, other_home).otherwise(~F.col("c.side").isin("away", "neutral")),
        }
    )
    # a number that isn't deterministic keeps the filter here, or else it would work out the opponent again
    rows = rows.withColumn("_here", F.monotonically_increasing_id()).where("_here >= 0")
    rows = rows.where(~linked | F.coalesce((opponent != "") & ~opponent.rlike("(?i)^(unknown opponent|away team|home team)$"), F.lit(False)))
    rows = rows.withColumn("_opponent_once", text.undoubled(opponent)).withColumn("_opponent_named", _named(F.col("_opponent_once")))
    of_home = lambda c: F.when(is_home, F.col(f"_context_named.{c}")).otherwise(F.col(f"_opponent_named.{c}"))
    of_away = lambda c: F.when(is_home, F.col(f"_opponent_named.{c}")).otherwise(F.col(f"_context_named.{c}"))
    result = F.when(platform, F.concat_ws("-", "g.result.team_score", "g.result.opponent_score")).otherwise(F.col("c.result"))
    score = status.scores(result, is_home | linked)  # linked data names the home team's first
    date = F.when(platform, F.coalesce(dates.utc_date(F.col("g.date")), F.concat(F.substring("g.date", 1, 4), F.lit("-01-01")))).when(linked, F.col("c.date_text")).otherwise(_said_date())
    place = F.when(platform, status.location(side)).when(linked, F.when(is_home, "home").otherwise("away")).otherwise(F.col("c.side"))
    said = F.when(platform, status.status_of_code(F.col("g.status"), F.col("g.result.status"))).otherwise(status.status_of_text(F.col("c.result")))
    box = F.col("g.result.boxscore")
    of_platform = F.when(box == "", None).when(F.startswith(box, F.lit("http")), box).otherwise(F.concat("base", box))
    rows = rows.withColumns(
        {"date": date, "home_score": score["home"], "away_score": score["away"], "location_type": place, "status": said}
        | {f"{t}_team_{c}": of(c) for t, of in (("home", of_home), ("away", of_away)) for c in ("name", "ranked")}
        | {"schedule_url": F.when(platform, F.coalesce("g.schedule.url", "source_url")).otherwise(F.col("source_url")), "boxscore_url": F.when(platform, of_platform).otherwise(urls.resolve_from(F.col("c.box"), F.col("_site")))}
        | {"layout": F.when(platform, "platform").otherwise(F.col("c.layout"))}
    )
    d, h, a = F.col("date"), F.col("home_team_name"), F.col("away_team_name")
    own = F.when(platform, F.concat(F.lit(f"{prefix}-"), F.col("g.id").cast("string"))).otherwise(text.game_id(d, h, a, prefix))
    return rows.withColumns({"dedupe_key": text.dedupe_key(d, h, a), "date_is_known": dates.is_known(d), "game_id": own}).select("page_id", *GAME_COLUMNS)


def merged(games: DataFrame, prefix: str = "game") -> DataFrame:
    """One row for each game of a page, by layout priority; then linked data goes through ``fold_linked``."""
    linked = F.col("layout") == "linked"
    key = F.when(linked, F.concat(F.lit("linked "), F.col("position").cast("string"))).otherwise(F.col("dedupe_key"))
    at = F.struct(place_in(READING).alias("at"), "position")
    row = F.struct(*GAME_COLUMNS)
    # of a layout the last row of a key counts, but on scoreboards, which only fill in, the first
    turn = F.when(F.col("layout") == "scoreboard", F.col("position")).otherwise(-F.col("position"))
    # pages go to their tasks once, for both groupings
    shown = games.repartition("page_id").groupBy("page_id", key.alias("_key")).agg(F.min(at).alias("place"), F.min_by(row, F.struct(place_in(PRIORITY), turn)).alias("game"))
    return fold_linked(shown, prefix)


def parse_schedules(raw: DataFrame, prefix: str = "game") -> DataFrame:
    """Games of all pages, one for each page and key.

    Null and empty pages, pages of unknown layout and pages that can't be read give no rows; see
    ``outcomes`` for these.
    """
    return merged(games_of(read_pages(raw), prefix), prefix)


def outcomes(read: DataFrame, *kept: str) -> DataFrame:
    """page_id, source_url, games (raw ones), outcome: ok, no games, or the error, and columns to keep; one row for each page."""
    # a number that isn't deterministic keeps filters on outcomes here, or else they would read each page's games again for each of its games
    rows = read.select("page_id", "source_url", "error", F.size("found").alias("games"), *kept, F.monotonically_increasing_id().alias("_here")).where("_here >= 0")
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("error: "), "error")).when(F.col("games") > 0, "ok").otherwise("no games")
    return rows.select("page_id", "source_url", "games", said.alias("outcome"), *kept)
