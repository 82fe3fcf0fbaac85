"""Readers with fixed schemas, never inferred ones, and writers that never overwrite what they read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.numbers import parse_int

from . import store

GAMES = ["game_id", "date", "home_team_name", "away_team_name", "home_team_ranked", "away_team_ranked", "home_score", "away_score", "location_type", "status", "schedule_url", "boxscore_url", "dedupe_key"]
PLAYER_STATS = ["game_id", "team_id", "player_name", "player_key", "jersey_number", "minutes", "goals", "assists", "shots", "shots_on_goal", "saves"]
TEAM = "team_id string, name_canonical string, conference string, sport string, aliases array<string>, schedule_url string, platform_guess string, parser_key string"
LINKS = "struct<schedule_url:string,boxscore_url:string,recap_url:string>"


def read_csv(spark: SparkSession, path: str, columns: list[str], multiline: bool = False) -> DataFrame:
    """CSV files with a header and RFC 4180 quoting; every value is a string, blank lines are skipped.

    Files are read in splits. Where values hold line breaks, ``multiline`` reads each file in one task.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("multiLine", multiline).option("escape", '"').option("enforceSchema", False).csv(path)


def read_csv_ordered(spark: SparkSession, path: str, columns: list[str], multiline: bool = False) -> DataFrame:
    """As above, with ``seq``, which orders rows as the files have them: by file, by the offset of the split, and within it."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return read_csv(spark, path, columns, multiline).select("*", place.alias("seq"))


def typed_lines(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """CSV text in ``column`` as typed columns beside the others; ``reject`` holds a line that doesn't fit the schema."""
    row = F.from_csv(column, f"{schema}, _reject string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_reject", "escape": '"'})
    return lines.withColumn("_row", row).select(*[c for c in lines.columns if c != column], "_row.*").withColumnRenamed("_reject", "reject")


def read_typed(spark: SparkSession, path: str, schema: str, missing_ok: bool = False) -> DataFrame:
    """CSV files with typed columns; rows that don't fit keep what fits, and their line in ``reject``.

    A missing path is an error, or, with ``missing_ok``, an empty table.
    """
    whole = f"{schema}, reject string"
    try:
        return spark.read.schema(whole).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "reject").option("escape", '"').csv(path)
    except AnalysisException as error:
        if not missing_ok or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def read_games(spark: SparkSession, path: str, season: str | None = None, team: str | None = None) -> DataFrame:
    """Typed games of a store partitioned by season, pruned to a season and filtered to a team."""
    rows = store.read(spark, path)
    if season is not None:
        rows = rows.where(F.col("season") == season)
    return rows if team is None else rows.where((F.col("home_team_name") == team) | (F.col("away_team_name") == team))


def typed_games(rows: DataFrame) -> DataFrame:
    """Empty texts become nulls; scores and flags get their types."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumns({c: parse_int(F.col(c)).cast("int") for c in ("home_score", "away_score")} | {c: F.lower(c) == "true" for c in ("home_team_ranked", "away_team_ranked")} | {c: empty(c) for c in ("schedule_url", "boxscore_url")})


def typed_player_stats(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: parse_int(F.col(c)) for c in ("goals", "assists", "shots", "shots_on_goal", "saves")} | {"minutes": F.col("minutes").try_cast("double")})


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Games whose links are JSON text; links that don't parse are empty."""
    rows = read_csv(spark, path, [c for c in GAMES if not c.endswith("_url")] + ["source_urls"])
    return rows.withColumn("source_urls", F.coalesce(F.from_json("source_urls", LINKS), F.struct(*[F.lit(None).cast("string").alias(c) for c in ("schedule_url", "boxscore_url", "recap_url")])))


def read_teams(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TEAM).option("multiLine", True).json(path)


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(team_id, alias) of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("team_id", "names")).select("team_id", F.explode("names").alias("alias"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages: path and body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("page_id"), F.col("value").alias("body"))


def flat_games(games: DataFrame) -> DataFrame:
    """The file's columns in order: missing ranks are false, missing scores and links empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return games.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("false")) if c.endswith("_ranked") else text(c)).alias(c) for c in GAMES])


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def write_seasons(games: DataFrame, path: str) -> None:
    """Parquet by the season of each row; only seasons among the rows are replaced, in one switch (see ``store``).

    The rows may come from the store itself.
    """
    store.replace_seasons(games, path)


def dashboard_json(totals: DataFrame) -> DataFrame:
    """One JSON object a line, nulls included; counters are leading integers."""
    counters = [c for c in ("games_played", "minutes", "goals", "assists", "shots", "shots_on_goal", "saves") if c in totals.columns]
    rows = totals.withColumns({c: parse_int(F.col(c).cast("string")) for c in counters})
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))


def master_rows(games: DataFrame) -> DataFrame:
    links = F.struct("schedule_url", "boxscore_url")
    return games.select(*[c for c in GAMES if not c.endswith("_url")], F.to_json(links).alias("source_urls"))
