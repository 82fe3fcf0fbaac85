"""Team identity: alias tables and lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import trimmed
from tallyfield.functions.urls import is_absolute, origin

#: An alias table below this many rows is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def normal(name: Column) -> Column:
    return F.upper(trimmed(name))


def alias_table(aliases: DataFrame, teams: DataFrame) -> DataFrame:
    """(alias, team_id); names and aliases of ``teams`` override those of ``aliases`` (team_id, alias)."""
    own = teams.select("team_id", F.explode(F.concat(F.array("name_canonical"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"))
    rows = aliases.select("team_id", "alias", F.lit(0).alias("prio")).unionByName(own.withColumn("prio", F.lit(1)))
    return rows.groupBy(normal(F.col("alias")).alias("alias")).agg(F.max_by("team_id", F.struct("prio", "team_id")).alias("team_id"))


def small_side(side: DataFrame) -> DataFrame:
    """The table with a broadcast hint, if its rows are few enough; counting stops just beyond that."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def resolve(rows: DataFrame, name: str, table: DataFrame, into: str = "team_id") -> DataFrame:
    """The rows with the team of a name, null where none is known."""
    side = small_side(table.select(F.col("alias").alias("_alias"), F.col("team_id").alias(into)))
    return rows.join(side, normal(F.col(name)) == F.col("_alias"), "left").drop("_alias")


def team_domains(games: DataFrame, order: str, overrides: Mapping[str, str] | None = None) -> DataFrame:
    """(team, domain): the origin of the first absolute link of a team's games; ``overrides`` (lower-case name to domain) always win.

    Links are visited row by row: of a row the home team's box score, the away team's, then the schedule
    for either. A team with an override and no link has its row, too.
    """
    slots = [("home_team_name", "boxscore_url"), ("away_team_name", "boxscore_url"), ("home_team_name", "schedule_url"), ("away_team_name", "schedule_url")]
    visits = F.array(*[F.struct(trimmed(F.col(team)).alias("team"), trimmed(F.col(link)).alias("link"), F.lit(k).alias("slot")) for k, (team, link) in enumerate(slots)])
    seen = games.select(order, F.explode(visits).alias("v")).select(order, "v.*").where(F.coalesce("team", F.lit("")) != "")
    domain = F.when(is_absolute(F.col("link")), F.nullif(origin(F.col("link")), F.lit("")))
    first = seen.groupBy("team").agg(F.min_by(domain, F.when(domain.isNotNull(), F.struct(order, "slot"))).alias("domain"))
    fixed = F.try_element_at(F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]), F.lower("team")) if overrides else F.lit(None).cast("string")
    return first.select("team", F.coalesce(fixed, "domain").alias("domain")).where("domain is not null")


def repair_links(games: DataFrame, domains: DataFrame) -> DataFrame:
    """The games with box-score links that start with a slash set behind the home team's domain, else the away team's."""
    box = trimmed(F.col("boxscore_url"))
    side = small_side(domains)
    of = lambda c: side.select(F.col("team").alias(f"_{c}"), F.col("domain").alias(f"_{c}_domain"))
    rows = games.withColumns({"_h": trimmed(F.col("home_team_name")), "_a": trimmed(F.col("away_team_name"))})
    rows = rows.join(of("home"), F.col("_h") == F.col("_home"), "left").join(of("away"), F.col("_a") == F.col("_away"), "left")
    domain = F.coalesce("_home_domain", "_away_domain")
    fixed = F.when(F.startswith(box, F.lit("/")) & domain.isNotNull(), F.concat(domain, box)).otherwise(F.col("boxscore_url"))
    return rows.withColumn("boxscore_url", fixed).select(*games.columns)
