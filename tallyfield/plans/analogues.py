"""The benchmark tables seen as games, player rows and teams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.functions.numbers import points
from tallyfield.operators import stats

ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Player season totals from line items: supplier as player, order as game."""
    rows = table(spark, sf_dir, "lineitem")
    whole = F.col("l_quantity").cast("bigint")
    sums = {"minutes": whole, "goals": F.col("l_linenumber"), "assists": F.col("l_partkey") % 3, "shots": whole % 10}
    found = stats.season_totals(rows, "l_suppkey", sums, ["l_partkey"], F.struct(*ROW_ORDER), "l_orderkey")
    return found.withColumnsRenamed({"l_suppkey": "player_key", "l_partkey": "first_part"})


TOTALS_SQL = """
totals AS (
  SELECT l_suppkey AS player_key, arg_min(l_partkey, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS first_part,
         count(*) AS games_played, count(DISTINCT l_orderkey) AS distinct_games,
         CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS minutes, CAST(sum(l_linenumber) AS BIGINT) AS goals,
         CAST(sum(l_partkey % 3) AS BIGINT) AS assists, CAST(sum(CAST(l_quantity AS BIGINT) % 10) AS BIGINT) AS shots
  FROM lineitem GROUP BY l_suppkey
)"""


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as games between customers of fifty teams."""
    o = table(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("Team "), c.cast("string"))
    gone = lambda n, x: F.when(F.col("o_orderkey") % n != 0, x)
    return o.select(
        F.col("o_orderkey").alias("seq"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        name(F.col("o_custkey") % 50).alias("home"),
        name((F.col("o_custkey") + F.col("o_orderkey")) % 50).alias("away"),
        F.when(F.col("o_orderstatus") == "F", "final").when(F.col("o_orderstatus") == "P", "postponed").otherwise("scheduled").alias("status"),
        F.when(F.col("o_orderkey") % 4 == 0, "unknown").otherwise("home").alias("location_type"),
        gone(3, F.col("o_orderkey") % 7).alias("home_score"),
        gone(5, F.col("o_orderkey") % 6).alias("away_score"),
        F.coalesce(gone(2, F.concat(F.lit("/box/"), F.col("o_orderkey").cast("string"))), F.lit("")).alias("boxscore_url"),
        F.concat(F.lit("k"), (F.col("o_custkey") % 997).cast("string")).alias("dedupe_key"),
    )


GAMES_SQL = """
games AS (
  SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Team ' || (o_custkey % 50) AS home,
         'Team ' || ((o_custkey + o_orderkey) % 50) AS away,
         CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status,
         CASE WHEN o_orderkey % 4 = 0 THEN 'unknown' ELSE 'home' END AS location_type,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END AS home_score,
         CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 6 END AS away_score,
         CASE WHEN o_orderkey % 2 <> 0 THEN '/box/' || o_orderkey ELSE '' END AS boxscore_url,
         'k' || (o_custkey % 997) AS dedupe_key
  FROM orders
)"""


def split(rows: DataFrame, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Stored rows and a new batch, by the parity of the order number's third."""
    old = F.floor(F.col(order) / 3) % 2 == 0
    return rows.where(old), rows.where(~old)


def total_points() -> Column:
    return points(F.col("goals"), F.col("assists"))
