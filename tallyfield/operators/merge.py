"""Keyed merges and deduplication. Input order is explicit everywhere: ``order`` columns, never file order."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfield.functions.text import names_likely_match
from tallyfield.session import cut

Qualifies = Callable[[Column], Column]
#: Which values of a column may replace an earlier one; any other column keeps its first value.
GAME_RULES: dict[str, Qualifies] = {
    "location_type": lambda c: c != "unknown",
    "status": lambda c: c != "scheduled",
    "home_score": lambda c: c.isNotNull(),
    "away_score": lambda c: c.isNotNull(),
    "schedule_url": lambda c: c != "",
    "boxscore_url": lambda c: c != "",
}


def keep_last(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key, the last; an aggregate, so hot keys shrink before the shuffle."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def keep_first(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("row")).select("row.*")


def last_values_first_place(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, with ``place``, the order of its first row."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"), F.min(F.struct(*order)).alias("place")).select("row.*", "place")


def upsert_merge(existing: DataFrame, batch: DataFrame, key: str, order: str, rules: Mapping[str, Qualifies] = GAME_RULES) -> DataFrame:
    """Existing rows win; ruled columns take their first qualifying value. One aggregate, no join or fold."""
    known = keep_last(existing.where(F.coalesce(F.col(key), F.lit("")) != ""), [key], [order])
    rows = known.withColumn("_phase", F.lit(0)).unionByName(batch.withColumn("_phase", F.lit(1)))
    at = F.struct("_phase", order)

    def merged(name: str) -> Column:
        first = F.min_by(F.struct(name), at)[name]
        if name not in rules:
            return first.alias(name)
        usable = F.coalesce(rules[name](F.col(name)), F.lit(False))
        return F.coalesce(F.min_by(name, F.when(usable, at)), first).alias(name)

    return rows.groupBy(key).agg(*[merged(c) for c in existing.columns if c != key])


def upsert_overwrite(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, with ``outcome``: kept, added or updated."""
    rows = existing.withColumn("_phase", F.lit(0)).unionByName(batch.withColumn("_phase", F.lit(1)))
    last = F.max_by(F.struct(*existing.columns), F.struct("_phase", order)).alias("row")
    outcome = F.when(F.max("_phase") == 0, "kept").when(F.min("_phase") == 1, "added").otherwise("updated").alias("outcome")
    return rows.groupBy(key).agg(last, outcome).select("row.*", "outcome")


def upsert_counts(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """added and updated, where repeats within the batch count as updates."""
    per_key = batch.groupBy(key).agg(F.count("*").alias("n"))
    new = per_key.join(existing.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("added"))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return new.join(F.broadcast(total)).select("added", (F.col("total") - F.col("added")).alias("updated"))  # one row each


def insert_if_absent(rows: DataFrame, more: DataFrame, key: Sequence[str]) -> DataFrame:
    return rows.unionByName(more.join(rows.select(*key).distinct(), list(key), "left_anti"))


#: A date with more pairs of teams than this isn't gone through game by game.
FOLDED = 2_000


def greedy_by_date(games: DataFrame, date: str, home: str, away: str, order: str) -> DataFrame:
    """Games kept when neither team has a kept game that date, taken in order; dropped ones block nobody.

    Only the first game of a pair can be kept, so a date holds at most as many rows as there are
    pairs. Up to ``FOLDED`` of them are gone through in one array. Larger dates, such as that of all
    undated games, go in rounds: a game that is the first of both its teams is kept, then their other
    games go, until none is left.
    """
    pair = [F.least(home, away).alias("_a"), F.greatest(home, away).alias("_b")]
    first = games.groupBy(F.col(date).alias("_date"), *pair).agg(F.min_by(F.struct(*games.columns), order).alias("row"), F.min(order).alias("_order"))
    small = F.col("_pairs") <= FOLDED
    sizes = first.groupBy("_date").agg(F.count("*").alias("_pairs"))
    hot = sizes.where(~small).select("_date")
    if hot.isEmpty():
        kept = _kept_in_turn(first)
    else:
        hot = cut(hot)
        kept = _kept_in_turn(first.join(hot, "_date", "left_anti")).unionByName(_kept_in_rounds(first.join(hot, "_date", "left_semi").select("_date", "_order", "_a", "_b")))
    return first.select("_date", "_order", "row").join(kept, ["_date", "_order"]).select("row.*")


def _kept_in_turn(first: DataFrame) -> DataFrame:
    """(_date, _order) kept, by one fold for each date."""
    listed = first.groupBy("_date").agg(F.array_sort(F.collect_list(F.struct("_order", "_a", "_b"))).alias("games"))
    game = F.filter("games", lambda x: F.lit(False))
    start = F.struct(F.transform(game, lambda x: x["_a"]).alias("seen"), F.transform(game, lambda x: x["_order"]).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        blocked = F.array_contains(acc["seen"], x["_a"]) | F.array_contains(acc["seen"], x["_b"])
        more = F.struct(F.concat(acc["seen"], F.array(x["_a"], x["_b"])).alias("seen"), F.concat(acc["kept"], F.array(x["_order"])).alias("kept"))
        return F.when(blocked, acc).otherwise(more)

    return listed.select("_date", F.explode(F.aggregate("games", start, step)["kept"]).alias("_order"))


def _kept_in_rounds(left: DataFrame) -> DataFrame:
    """(_date, _order) kept, all dates together; ``left``: _date, _order, _a, _b. Each round keeps at least the first game of a date."""
    parts, left = [], cut(left)
    while not left.isEmpty():
        of_team = left.select("_date", "_order", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_team"))
        firsts = of_team.groupBy("_date", "_team").agg(F.min("_order").alias("_order"))
        of_both = firsts.groupBy("_date", "_order").agg(F.count("*").alias("_teams"))
        kept = cut(left.join(of_both, ["_date", "_order"]).where(F.col("_teams") == F.when(F.col("_a") == F.col("_b"), 1).otherwise(2)).select("_date", "_order", "_a", "_b"))
        parts.append(kept.select("_date", "_order"))
        busy = kept.select("_date", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_team"))
        for side in ("_a", "_b"):
            left = left.join(busy.withColumnRenamed("_team", side), ["_date", side], "left_anti")
        left = cut(left.select("_date", "_order", "_a", "_b"))
    return reduce(DataFrame.unionByName, parts)


def first_match(left: DataFrame, right: DataFrame, block: Sequence[str], left_name: str, right_name: str, left_order: str, right_key: str) -> DataFrame:
    """For each row on the right, the first likely match on the left, within a block (a page)."""
    pairs = right.join(left, list(block)).where(names_likely_match(F.col(left_name), F.col(right_name)))
    return pairs.groupBy(*block, right_key).agg(F.min_by(F.struct(left_name, left_order), left_order).alias("m")).select(*block, right_key, f"m.{left_name}", f"m.{left_order}")


def zip_positions(rows: DataFrame, harvested: DataFrame, on: Sequence[str], parsed: str, link: str) -> DataFrame:
    """Harvested links by row position; they beat parsed ones."""
    return rows.join(harvested.select(*on, link), list(on), "left").withColumn(parsed, F.coalesce(F.nullif(F.col(link), F.lit("")), F.col(parsed))).drop(link)


def reconcile(parsed: DataFrame, stored: DataFrame, key: str, order: str, compared: Sequence[str], if_said: Sequence[str] = ()) -> DataFrame:
    """key, outcome (MISSING_IN_CSV, OK, DIFF, CSV_ONLY) and the differing columns; the last stored row of a key counts.

    Columns in ``if_said`` are compared only where the page says something.
    """
    new = parsed.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"new_{c}") for c in compared])
    old = keep_last(stored, [key], [order]).select(key, F.lit(True).alias("_old"), *[F.col(c).alias(f"old_{c}") for c in compared])
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    differs = [F.when((text(f"new_{c}") != text(f"old_{c}")) & ((text(f"new_{c}") != "") if c in if_said else F.lit(True)), F.concat(F.lit(f"{c}: "), text(f"old_{c}"), F.lit(" -> "), text(f"new_{c}"))) for c in compared]
    both = new.join(old, key, "full_outer").withColumn("detail", F.concat_ws(" | ", *differs))
    outcome = F.when(F.col("_old").isNull(), "MISSING_IN_CSV").when(F.col("_new").isNull(), "CSV_ONLY").when(F.col("detail") == "", "OK").otherwise("DIFF")
    return both.select(key, outcome.alias("outcome"), F.when(outcome == "DIFF", F.col("detail")).otherwise("").alias("detail"))
