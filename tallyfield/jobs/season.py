"""The batch jobs: landed pages to games, box scores to player rows, totals and reports.

    python -m tallyfield.jobs.season schedules PAGES STORE TEAM [YEAR] [FAILED]
    python -m tallyfield.jobs.season boxscores STORE PAGES OUT [LIMIT] [FAILED]
    python -m tallyfield.jobs.season totals PLAYER_STATS OUT
    python -m tallyfield.jobs.season dashboard TOTALS OUT
    python -m tallyfield.jobs.season compare PAGES STORE TEAM OUT [YEAR]
    python -m tallyfield.jobs.season inventory TEAMS OUT
    python -m tallyfield.jobs.season clean GAMES_CSV OUT
    python -m tallyfield.jobs.season repair GAMES_CSV OUT [TEAM=DOMAIN ...]
    python -m tallyfield.jobs.season analyze GAMES_CSV OUT

Jobs over pages print counters of the run and list the pages that gave nothing, with the reason, in
FAILED. ``inventory`` ends with exit code 1 if a team has an error.
"""

from __future__ import annotations

import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions import dates, text
from tallyfield.functions.numbers import int_or_zero
from tallyfield.operators import identity, merge, quality, stats
from tallyfield.parsers import box, schedule
from tallyfield.session import cut
from tallyfield.sources import store as season_store
from tallyfield.sources import tables


def page_rows(spark: SparkSession, pages: str, team: str, year: int) -> DataFrame:
    raw = tables.read_pages(spark, pages)
    return raw.select("page_id", "body", F.lit(team).alias("team_name"), F.lit("").alias("source_url"), F.lit(year).alias("default_year"))


def counted(rows: DataFrame, failed: Column) -> tuple[DataFrame, Observation]:
    """The rows, and counters that their next action fills in, without a scan of its own."""
    counters = Observation()
    return rows.observe(counters, F.count("*").alias("total"), F.count_if(~failed).alias("finished"), F.count_if(failed).alias("failed")), counters


def schedules(spark: SparkSession, pages: str, store: str, team: str, year: str = "2025", failed: str = "") -> dict[str, int]:
    read, counters = counted(schedule.read_pages(page_rows(spark, pages, team, int(year))), (F.col("error").isNotNull()) | (F.size("found") == 0))
    read = cut(read)  # pages are parsed once
    batch = schedule.merged(schedule.games_of(read)).select(*tables.GAMES, F.struct("page_id", "position").alias("seq"))
    try:
        existing = season_store.read(spark, store).drop("season")
    except AnalysisException as error:  # no store yet; an unreadable one must not be overwritten
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        existing = batch.limit(0)
    touched = batch.select(dates.season(F.col("date")).alias("season")).distinct()
    old = existing.join(touched, dates.season(F.col("date")) == F.col("season"), "left_semi")  # other seasons stay as they are
    tables.write_seasons(merge.upsert_merge(old, batch, "dedupe_key", "seq").withColumn("season", dates.season(F.col("date"))), store)
    if failed:
        schedule.outcomes(read).where("outcome <> 'ok'").write.mode("overwrite").parquet(failed)
    return counters.get


def boxscores(spark: SparkSession, store: str, pages: str, out: str, limit: str = "0", failed: str = "") -> dict[str, int]:
    games = season_store.read(spark, store).where(F.coalesce("boxscore_url", F.lit("")) != "")
    games = merge.greedy_by_date(games, "date", "home_team_name", "away_team_name", "seq")
    games = games.orderBy("seq").limit(int(limit)) if int(limit) else games
    documents = tables.read_pages(spark, pages).select(F.concat(F.lit("https://"), F.regexp_extract("page_id", "([^/]+)$", 1)).alias("url"), F.lit(1).alias("priority"), "body")
    games = games.withColumn("boxscore_url", F.concat(F.lit("https://"), text.slug(F.regexp_replace("boxscore_url", "^https?://", ""))))
    best, counters = counted(box.best_pages(games, documents), F.coalesce(F.size("cells"), F.lit(0)) < 1)
    best = cut(best)
    tables.write_csv(box.players_of(best.drop("url", "priority")).select(*tables.PLAYER_STATS), out)
    if failed:
        said = games.select("game_id", "date", F.concat_ws(" vs ", "home_team_name", "away_team_name").alias("teams"))
        box.missing_boxes(best).join(said, "game_id").write.mode("overwrite").parquet(failed)
    return counters.get


def totals(spark: SparkSession, player_stats: str, out: str) -> None:
    rows = tables.read_csv_ordered(spark, player_stats, tables.PLAYER_STATS)
    sums = {c: int_or_zero(F.col(c)) for c in stats.COUNTERS}
    found = stats.season_totals(rows, "player_key", sums, ["player_name", "team_id", "jersey_number"], F.col("seq"))
    stats.by_points(found, "player_key").write.mode("overwrite").parquet(out)


def dashboard(spark: SparkSession, totals: str, out: str) -> None:
    tables.dashboard_json(spark.read.parquet(totals)).write.mode("overwrite").text(out)


def compare(spark: SparkSession, pages: str, store: str, team: str, out: str, year: str = "2025") -> None:
    """Box-score links count only where the page has one."""
    key = text.reconcile_key(F.col("date"), F.col("home_team_name"), F.col("away_team_name")).alias("key")
    kept = ["boxscore_url", "home_score", "away_score", "status"]
    new = schedule.parse_schedules(page_rows(spark, pages, team, int(year))).select(key, *kept)
    old = tables.read_games(spark, store, team=team).select(key, "seq", *kept)
    merge.reconcile(new, old, "key", "seq", kept, ["boxscore_url"]).write.mode("overwrite").parquet(out)


def inventory(spark: SparkSession, teams: str, out: str) -> int:
    """The number of teams with errors."""
    quality.inventory_errors(tables.read_teams(spark, teams)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out).count()


def clean(spark: SparkSession, games: str, out: str) -> None:
    rows = tables.read_csv_ordered(spark, games, tables.GAMES)
    tables.write_csv(quality.clean_games(rows, "seq").orderBy("date", "place").select(*tables.GAMES), out)


def repair(spark: SparkSession, games: str, out: str, *overrides: str) -> None:
    """Box-score links that need a domain get that of a team, in file order."""
    rows = cut(tables.read_csv_ordered(spark, games, tables.GAMES))
    fixed = dict(o.split("=", 1) for o in overrides)
    domains = identity.team_domains(rows, "seq", {k.lower(): v for k, v in fixed.items()})
    tables.write_csv(identity.repair_links(rows, domains).orderBy("seq").select(*tables.GAMES), out)


def analyze(spark: SparkSession, games: str, out: str) -> None:
    """Counts, their percentages, and the first five games of a kind, as one row of JSON."""
    rows = tables.typed_games(tables.read_csv_ordered(spark, games, tables.GAMES))
    quality.report(rows, "seq").write.mode("overwrite").json(out)


JOBS = {f.__name__: f for f in (schedules, boxscores, totals, dashboard, compare, inventory, clean, repair, analyze)}

if __name__ == "__main__":
    said = JOBS[sys.argv[1]](SparkSession.builder.appName(f"tallyfield {sys.argv[1]}").getOrCreate(), *sys.argv[2:])
    if said is not None:
        print(said)
    sys.exit(int(sys.argv[1] == "inventory" and said > 0))
