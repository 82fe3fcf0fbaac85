"""Queries over landed pages: each customer's orders become a schedule page in some layout, which the parsers read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.operators import identity
from tallyfield.parsers import registry, schedule

from .analogues import table
from .registered import query

SHOWN = ["page_id", "dedupe_key", "date", "home_team_name", "away_team_name", "home_score", "away_score", "location_type", "status", "boxscore_url", "layout"]
#: Sides by the order key's remainder: with the word that pages say, and the platform's letter.
SIDES = [("home", "vs", "H"), ("away", "at", "A"), ("unknown", "", "N")]


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    side = lambda i: F.element_at(F.array(*[F.lit(s[i]) for s in SIDES]), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(
        c.alias("page_id"),
        k.alias("k"),
        F.to_date("o_orderdate").alias("day"),
        F.concat(F.lit("Team "), (100 + c % 50).cast("string")).alias("team"),
        F.concat(F.lit("Club "), (200 + k % 40).cast("string")).alias("club"),
        side(0).alias("side"),
        side(1).alias("word"),
        side(2).alias("letter"),
        F.when(F.col("o_orderstatus") == "F", F.concat_ws("-", (k % 5).cast("string"), (k % 4).cast("string"))).when(F.col("o_orderstatus") == "P", "Postponed").otherwise("").alias("result"),
        F.when(k % 2 == 0, F.concat(F.lit("/boxscore/"), k.cast("string"))).otherwise("").alias("box"),
    )


ORDERS_SQL = """
src AS (
  SELECT o_custkey AS page_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, 'Team ' || (100 + o_custkey % 50) AS team, 'Club ' || (200 + o_orderkey % 40) AS club,
         CASE o_orderkey % 3 WHEN 0 THEN 'home' WHEN 1 THEN 'away' ELSE 'unknown' END AS side, o_orderstatus AS st,
         CASE WHEN o_orderkey % 2 = 0 THEN 'https://t' || (o_custkey % 50) || '.example.com/boxscore/' || o_orderkey END AS box
  FROM orders
)"""


def games_sql(layout: str, side: str = "side", at_home: str = "side <> 'away'", win: str = "DESC", home_first: bool = False) -> str:
    """The games that pages of one layout must give: the last (or first) of each page and key."""
    own, other = "CASE WHEN st = 'F' THEN k % 5 END", "CASE WHEN st = 'F' THEN k % 4 END"
    home, away = (own, other) if home_first else (f"CASE WHEN {at_home} THEN {own} ELSE {other} END", f"CASE WHEN {at_home} THEN {other} ELSE {own} END")
    return f"""WITH {ORDERS_SQL}, g AS (SELECT page_id, k, strftime(day, '%Y-%m-%d') AS date, CASE WHEN {at_home} THEN team ELSE club END AS home_team_name, CASE WHEN {at_home} THEN club ELSE team END AS away_team_name,
  CAST({home} AS BIGINT) AS home_score, CAST({away} AS BIGINT) AS away_score, {side} AS location_type, CASE st WHEN 'F' THEN 'final' WHEN 'P' THEN 'postponed' ELSE 'scheduled' END AS status, box AS boxscore_url, '{layout}' AS layout FROM src)
SELECT page_id, date || '-' || replace(least(home_team_name, away_team_name), ' ', '-') || '-' || replace(greatest(home_team_name, away_team_name), ' ', '-') AS dedupe_key, date, home_team_name, away_team_name, home_score, away_score, location_type, status, boxscore_url, layout
FROM g QUALIFY row_number() OVER (PARTITION BY page_id, dedupe_key ORDER BY k {win}) = 1"""


def pages_of(rows: DataFrame, snippet: Column, before: str = "", after: str = "", separator: str = "") -> DataFrame:
    """A page for each customer from a snippet for each order, in their order."""
    made = rows.groupBy("page_id", "team").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", snippet.alias("s")))), lambda x: x["s"]).alias("parts"))
    source = F.concat(F.lit("https://t"), (F.col("page_id") % 50).cast("string"), F.lit(".example.com/sports/soccer/schedule"))
    body = F.concat(F.lit(before), F.array_join("parts", separator), F.lit(after))
    return made.select("page_id", body.alias("body"), F.col("team").alias("team_name"), source.alias("source_url"), F.lit(2025).alias("default_year"))


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def day(form: str) -> Column:
    return F.date_format("day", form)


def link() -> Column:
    return F.when(F.col("box") != "", text('<a href="', F.col("box"), '">Box Score</a>')).otherwise("")


def cards(rows: DataFrame) -> DataFrame:
    snippet = text('<div class="s-game-card"><div class="s-game-card__header__team"><p class="s-text-paragraph-bold">', F.col("club"), '</p></div><div data-test-id="s-game-card-standard__header-game-date-details"><span>', day("MMM d, yyyy"), '</span></div><span class="s-stamp__text">', F.col("word"), '</span><div class="c-scoreboard__scores">', F.col("result"), "</div>", link(), "</div>")
    return pages_of(rows, snippet)


def list_items(rows: DataFrame) -> DataFrame:
    at_home = F.when(F.col("side") == "home", " sidearm-schedule-home-game").otherwise("")
    snippet = text('<li class="sidearm-schedule-game', at_home, '"><div class="sidearm-schedule-game-opponent-date"><span>', day("M/d/yyyy"), ' (Sat)</span></div><div class="sidearm-schedule-game-opponent-name">', F.col("club"), '</div><div class="sidearm-schedule-game-result">', F.col("result"), "</div>", link(), "</li>")
    return pages_of(rows, snippet, "<ul>", "</ul>")


HEADS = "<table><thead><tr><th>Date</th><th>Time</th><th>Opponent</th><th>Result</th><th>Links</th></tr></thead><tbody>"


def table_row(date: Column, result: Column) -> Column:
    return text("<tr><td>", date, "</td><td>7 PM</td><td>", F.col("word"), " ", F.col("club"), "</td><td>", result, "</td><td>", link(), "</td></tr>")


def table_rows(rows: DataFrame) -> DataFrame:
    return pages_of(rows, table_row(day("MM/dd/yyyy"), F.col("result")), HEADS, "</tbody></table>")


def scoreboard(rows: DataFrame) -> DataFrame:
    known = F.when(F.col("side") != "unknown", text(" c-scoreboard__item--", F.col("side"))).otherwise("")
    snippet = text('<div class="c-scoreboard__item', known, '"><div class="c-scoreboard__logo"><img alt="', F.col("club"), '"></div><div class="c-scoreboard__date"><span>', day("yyyy-MM-dd"), '</span></div><div class="c-scoreboard__scores">', F.col("result"), "</div>", link(), "</div>")
    return pages_of(rows, snippet)


def payload(rows: DataFrame) -> DataFrame:
    """As the list of a JSON script on pages of even number, else as a list within a script, with text that looks like its end."""
    each, shift = 10, F.when(F.col("page_id") % 2 == 0, 5).otherwise(6)
    score = lambda n: F.when(F.col("result").contains("-"), text('"', (F.col("k") % n).cast("string"), '"')).otherwise("null")
    ranked = rows.withColumn("i", F.row_number().over(schedule_order()) - 1)
    at = lambda n: (shift + each * F.col("i") + n).cast("string")
    objects = text('{"date":', at(1), ',"opponent":', at(2), ',"location_indicator":', at(4), ',"result":', at(5), ',"status":', at(9), "},")
    values = text('"', day("yyyy-MM-dd"), 'T00:00:00",{"title":', at(3), '},"', F.col("club"), '","', F.col("letter"), '",{"team_score":', at(6), ',"opponent_score":', at(7), ',"boxscore":', at(8), "},")
    box = F.when(F.col("box") == "", "null").when(F.col("k") % 4 == 0, text('{"url":', at(8), ',"href":"x]"}')).otherwise(text('"', F.col("box"), '"'))
    box = F.when((F.col("box") != "") & (F.col("k") % 4 == 0), text('["', F.col("box"), '"]')).otherwise(box)
    rest = text(score(5), ",", score(4), ",", box, ',"', F.col("result"), '"')
    ranked = ranked.select("page_id", "team", "k", F.struct(at(0).alias("at"), text(objects, values, rest).alias("game")).alias("s"))
    made = ranked.groupBy("page_id", "team").agg(F.sort_array(F.collect_list(F.struct("k", "s"))).alias("parts"))
    join = lambda name: F.array_join(F.transform("parts", lambda x: x["s"][name]), ",")
    data = lambda n: text(f'{{"schedule":{n},"note":"]}}[\\""}},{{"schedules":{n + 1}}},{{"x":{n + 2}}},{{"games":{n + 3}}},[', join("at"), "],", join("game"), "]")
    script = F.when(F.col("page_id") % 2 == 0, text('<script type="application/json" id="__NUXT_DATA__">[', data(1), "</script>")).otherwise(
        text('<script>var a="[[";window.b={data:[["ShallowReactive",0]],"schedule":1};window.__NUXT__=[["ShallowReactive",1],', data(2), ';var z="]]";</script>')
    )
    source = F.concat(F.lit("https://t"), (F.col("page_id") % 50).cast("string"), F.lit(".example.com/sports/soccer/schedule"))
    return made.select("page_id", script.alias("body"), F.col("team").alias("team_name"), source.alias("source_url"), F.lit(2025).alias("default_year"))


def schedule_order():
    from pyspark.sql import Window

    return Window.partitionBy("page_id").orderBy("k")


def platform(rows: DataFrame) -> DataFrame:
    scored = F.col("result").contains("-")
    score = lambda n: F.when(scored, (F.col("k") % n).cast("string"))
    result = F.struct(F.when(scored, "W").alias("status"), score(5).alias("team_score"), score(4).alias("opponent_score"), F.col("box").alias("boxscore"))
    code = F.when(F.col("result") == "Postponed", "P").otherwise("A")
    site = text("https://t", (F.col("page_id") % 50).cast("string"), ".example.com/x")
    game = F.struct(F.col("k").alias("id"), text(day("yyyy-MM-dd"), "T12:00:00Z").alias("date"), F.lit("game").alias("type"), code.alias("status"), F.col("letter").alias("location_indicator"), F.lit(True).alias("neutral_hometeam"), F.struct(F.col("club").alias("name")).alias("opponent"), result.alias("result"), F.struct(site.alias("url")).alias("schedule"))
    return pages_of(rows, F.to_json(game), "[", "]", ",")


def event(date: Column) -> Column:
    """A matchup title for two of three orders, else teams; scores by team."""
    name = F.when(F.col("side") == "home", text(F.col("team"), " vs. ", F.col("club"))).when(F.col("side") == "away", text(F.col("team"), " at ", F.col("club"))).otherwise("Final day")
    scored = F.col("result").contains("-")
    side = lambda name, n: F.struct(F.col(name).alias("name"), F.when(scored, F.col("k") % n).alias("score"))
    return F.to_json(F.struct(F.array(F.lit("Event"), F.lit("SportsEvent")).alias("@type"), name.alias("name"), date.alias("startDate"), side("team", 5).alias("homeTeam"), side("club", 4).alias("awayTeam")))


def linked(rows: DataFrame) -> DataFrame:
    return pages_of(rows, event(day("yyyy-MM-dd'T'19:00")), '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[', "]}</script>", ",")


def shown(raw: DataFrame) -> DataFrame:
    return schedule.parse_schedules(raw).select(*SHOWN)


@query(games_sql("cards"))
def parsed_cards(spark, sf_dir):
    return shown(cards(orders(spark, sf_dir)))


@query(games_sql("list", "CASE side WHEN 'home' THEN side ELSE 'away' END", "side = 'home'"))
def parsed_list(spark, sf_dir):
    return shown(list_items(orders(spark, sf_dir)))


@query(games_sql("table"))
def parsed_table(spark, sf_dir):
    return shown(table_rows(orders(spark, sf_dir)))


@query(games_sql("scoreboard", win="ASC"))
def parsed_scoreboard(spark, sf_dir):
    return shown(scoreboard(orders(spark, sf_dir)))


@query(games_sql("payload", "CASE side WHEN 'unknown' THEN 'neutral' ELSE side END", "side = 'home'"))
def parsed_payload(spark, sf_dir):
    return shown(payload(orders(spark, sf_dir)))


@query(games_sql("platform", "CASE side WHEN 'unknown' THEN 'neutral' ELSE side END"))
def parsed_platform(spark, sf_dir):
    return shown(platform(orders(spark, sf_dir)))


LINKED_SQL = f"""WITH {ORDERS_SQL}, e AS (SELECT page_id, team, club, min(k) AS k, coalesce(arg_min(day, k) FILTER (strftime(day, '%m-%d') <> '01-01'), max_by(day, k)) AS day, arg_min(side, k) AS side,
  arg_min(k, k) FILTER (st = 'F') AS scored, max(st = 'F') AS done FROM src GROUP BY 1, 2, 3),
g AS (SELECT *, strftime(day, '%Y-%m-%d') AS date, side <> 'away' AS at_home FROM e)
SELECT page_id, date || '-' || replace(least(team, club), ' ', '-') || '-' || replace(greatest(team, club), ' ', '-') AS dedupe_key, date,
  CASE WHEN at_home THEN team ELSE club END AS home_team_name, CASE WHEN at_home THEN club ELSE team END AS away_team_name,
  CAST(scored % 5 AS BIGINT) AS home_score, CAST(scored % 4 AS BIGINT) AS away_score, CASE WHEN at_home THEN 'home' ELSE 'away' END AS location_type,
  CASE WHEN done THEN 'final' ELSE 'scheduled' END AS status, CAST(NULL AS VARCHAR) AS boxscore_url, 'linked' AS layout FROM g"""


@query(LINKED_SQL)
def parsed_linked(spark, sf_dir):
    """Events of the same teams go to the first of them, whatever their dates, and fill its scores and status."""
    return shown(linked(orders(spark, sf_dir)))


MERGED_SQL = f"""WITH {ORDERS_SQL}, t AS (SELECT * FROM src QUALIFY row_number() OVER (PARTITION BY page_id, club ORDER BY k) = 1),
g AS (SELECT *, k % 4 = 1 AS tba, k % 5 = 2 AS bare, side <> 'away' AS at_home, (k % 7 <> 3) AS has_event FROM t),
f AS (SELECT *, CASE WHEN tba AND NOT has_event THEN '2025-01-01' ELSE strftime(day, '%Y-%m-%d') END AS date, CASE WHEN bare THEN 'unknown' ELSE side END AS said,
  CASE WHEN bare OR side <> 'away' THEN team ELSE club END AS home, CASE WHEN bare OR side <> 'away' THEN club ELSE team END AS away FROM g)
SELECT page_id, date || '-' || replace(least(team, club), ' ', '-') || '-' || replace(greatest(team, club), ' ', '-') AS dedupe_key, 'game-' || date || '-' || replace(home, ' ', '-') || '-' || replace(away, ' ', '-') AS game_id, date, home AS home_team_name, away AS away_team_name,
  CASE WHEN st = 'F' AND has_event THEN CAST(k % 5 AS BIGINT) END AS home_score, CASE WHEN st = 'F' AND has_event THEN CAST(k % 4 AS BIGINT) END AS away_score,
  CASE WHEN said <> 'unknown' OR NOT has_event THEN said WHEN at_home THEN 'home' ELSE 'away' END AS location_type, CASE WHEN st = 'F' AND has_event THEN 'final' ELSE 'scheduled' END AS status, 'table' AS layout FROM f"""


@query(MERGED_SQL)
def linked_merge(spark, sf_dir):
    """Tables without results, some without dates or sides, filled by the linked data of the same page, where it has the game."""
    from pyspark.sql import Window

    first = orders(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("page_id", "club").orderBy("k"))).where("n = 1")
    k = F.col("k")
    row = text("<tr><td>", F.when(k % 4 == 1, "TBA").otherwise(day("MM/dd/yyyy")), "</td><td></td><td>", F.when(k % 5 == 2, "").otherwise(F.col("word")), " ", F.col("club"), "</td><td></td><td></td></tr>")
    events = F.when(k % 7 != 3, text('<script type="application/ld+json">', event(day("yyyy-MM-dd'T'19:00")), "</script>")).otherwise("")
    both = first.withColumns({"row": row, "event": events}).groupBy("page_id", "team").agg(F.sort_array(F.collect_list(F.struct("k", "row", "event"))).alias("parts"))
    part = lambda name: F.array_join(F.transform("parts", lambda x: x[name]), "")
    raw = both.select("page_id", text(part("event"), HEADS, part("row"), "</tbody></table>").alias("body"), F.col("team").alias("team_name"), F.lit("https://t.example.com/").alias("source_url"), F.lit(2025).alias("default_year"))
    return schedule.parse_schedules(raw).select(*[c for c in SHOWN if c != "boxscore_url"], "game_id")


def routed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of several teams: tables, platform arrays, pages that nobody can read, and ones without games."""
    rows = orders(spark, sf_dir)
    raw = table_rows(rows).where("page_id % 4 < 2").unionByName(platform(rows).where("page_id % 4 >= 2"))
    body = F.when(F.col("page_id") % 11 == 0, "<p>No games yet").when(F.col("page_id") % 13 == 0, F.lit('<script type="application/ld+json">' + "[" * 20_000 + "</script>")).otherwise(F.col("body"))
    teams = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("team_id"),
        F.when(F.col("n_nationkey") % 5 == 0, "presto").otherwise("sidearm").alias("platform_guess"),
        F.when(F.col("n_nationkey") % 7 == 3, "nobody").when(F.col("n_nationkey") % 7 != 4, "sidearm").alias("parser_key"),
    )
    raw = raw.withColumns({"body": body, "team_id": F.concat(F.lit("t"), (F.col("page_id") % 30).cast("string"))})
    known = registry.Registry()
    known.register("other", known.parsers["sidearm"])
    known.map_team("t4", "other")
    return registry.read_routed(registry.routed(raw, teams, known), known)


ROUTED_SQL = """
r AS (SELECT o_custkey AS page_id, count(*) AS n, 'https://t' || (o_custkey % 50) || '.example.com/sports/soccer/schedule' AS source_url, o_custkey % 30 AS t FROM orders GROUP BY o_custkey),
k AS (SELECT *, CASE WHEN t >= 25 OR t % 5 = 0 THEN NULL WHEN t = 4 THEN 'other' WHEN t % 7 IN (3, 4) THEN NULL ELSE 'sidearm' END AS route FROM r),
o AS (SELECT *, CASE WHEN route IS NULL THEN 'no parser' WHEN page_id % 11 = 0 THEN 'no games' WHEN page_id % 13 = 0 THEN 'error' ELSE 'ok' END AS outcome FROM k)"""


@query(f"WITH {ROUTED_SQL} SELECT route, outcome, count(*) AS pages, CAST(sum(CASE WHEN outcome = 'ok' THEN n ELSE 0 END) AS BIGINT) AS games FROM o GROUP BY 1, 2")
def routed_games(spark, sf_dir):
    found = registry.outcomes(routed_pages(spark, sf_dir)).withColumn("outcome", F.regexp_extract("outcome", "^[^:]*", 0))
    return found.groupBy("route", "outcome").agg(F.count("*").alias("pages"), F.sum("games").cast("bigint").alias("games"))


@query(f"WITH {ROUTED_SQL} SELECT page_id, source_url, outcome AS reason FROM o WHERE outcome <> 'ok'")
def quarantined_pages(spark, sf_dir):
    found = registry.outcomes(routed_pages(spark, sf_dir)).where("outcome <> 'ok'")
    return found.select("page_id", "source_url", F.regexp_extract("outcome", "^[^:]*", 0).alias("reason"))


def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored games, some with absolute links, some with links that need a domain, some without."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    team = lambda n: F.concat(F.lit(" Team "), n.cast("string"))
    path = F.concat(F.lit("/box/"), k.cast("string"))
    domain = F.concat(F.lit("https://T"), (k % 9).cast("string"), F.lit(".example.com"))
    box = F.when(k % 4 == 0, F.concat(domain, path)).when(k % 4 == 1, path).when(k % 4 == 2, F.concat(F.lit("box/"), k.cast("string"))).otherwise("")
    return table(spark, sf_dir, "orders").select(
        k.alias("seq"), team(c % 60).alias("home_team_name"), team((c + k) % 60).alias("away_team_name"), box.alias("boxscore_url"), F.when(k % 16 == 5, F.concat(F.lit("http://s"), (k % 9).cast("string"), F.lit(".example.com:80/x"))).otherwise("").alias("schedule_url")
    ).where((c % 60 < 50) | (k % 8 != 0))


OVERRIDES = {"team 7": "https://seven.example.com", "team 59": "https://last.example.com"}
DOMAINS_SQL = """
g AS (SELECT o_orderkey AS seq, 'Team ' || (o_custkey % 60) AS home, 'Team ' || ((o_custkey + o_orderkey) % 60) AS away,
  CASE o_orderkey % 4 WHEN 0 THEN 'https://T' || (o_orderkey % 9) || '.example.com/box/' || o_orderkey WHEN 1 THEN '/box/' || o_orderkey WHEN 2 THEN 'box/' || o_orderkey ELSE '' END AS box,
  CASE WHEN o_orderkey % 16 = 5 THEN 'http://s' || (o_orderkey % 9) || '.example.com:80/x' ELSE '' END AS sched FROM orders WHERE o_custkey % 60 < 50 OR o_orderkey % 8 <> 0),
v AS (SELECT seq, 0 AS slot, home AS team, box AS link FROM g UNION ALL SELECT seq, 1, away, box FROM g UNION ALL SELECT seq, 2, home, sched FROM g UNION ALL SELECT seq, 3, away, sched FROM g),
f AS (SELECT team, arg_min(replace(lower(regexp_extract(link, '^(https?://[^/]+)', 1)), ':80', ''), row(seq, slot)) FILTER (link LIKE 'http%') AS domain FROM v GROUP BY team),
domains AS (SELECT team, CASE lower(team) WHEN 'team 7' THEN 'https://seven.example.com' WHEN 'team 59' THEN 'https://last.example.com' ELSE domain END AS domain FROM f)"""


@query(f"WITH {DOMAINS_SQL} SELECT * FROM domains WHERE domain IS NOT NULL")
def team_domains(spark, sf_dir):
    return identity.team_domains(linked_rows(spark, sf_dir), "seq", OVERRIDES)


@query(f"""WITH {DOMAINS_SQL} SELECT seq, CASE WHEN box LIKE '/%' AND coalesce(h.domain, a.domain) IS NOT NULL THEN coalesce(h.domain, a.domain) || box ELSE box END AS boxscore_url
FROM g LEFT JOIN domains h ON h.team = g.home LEFT JOIN domains a ON a.team = g.away""")
def link_repair(spark, sf_dir):
    rows = linked_rows(spark, sf_dir)
    return identity.repair_links(rows, identity.team_domains(rows, "seq", OVERRIDES)).select("seq", "boxscore_url")
