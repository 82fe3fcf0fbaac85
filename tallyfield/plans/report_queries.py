"""Queries of sinks, reports, dashboards and typed sources over the benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import dates, text, urls
from tallyfield.operators import merge, quality, stats
from tallyfield.parsers import box
from tallyfield.sources import tables

from .analogues import GAMES_SQL, TOTALS_SQL, games, table, totals
from .registered import query


@query("""SELECT l_orderkey * 10 + l_linenumber AS line, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS "stat_A", CASE WHEN l_returnflag = 'N' THEN l_quantity END AS "stat_N",
CASE WHEN l_returnflag = 'R' THEN l_quantity END AS "stat_R", l_extendedprice AS stat_price FROM lineitem""")
def stats_map(spark, sf_dir):
    """A map of statistics, named by the data, as columns."""
    found = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_quantity"))
    return stats.stats_columns(table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), found.alias("stats")), "line", F.col("stats"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS custkey, CAST(o_totalprice AS DOUBLE) AS price,
CASE WHEN o_orderkey % 10 = 0 THEN 'c' || o_custkey || ',' || CAST(o_totalprice AS DOUBLE) || ',"' || o_orderpriority || ', ""x""' || '"' END AS reject, o_orderpriority || ', "x"' AS note FROM orders""")
def typed_rejects(spark, sf_dir):
    """Lines whose number isn't one are kept as rejects, with what fits."""
    o = table(spark, sf_dir, "orders")
    key = F.concat(F.when(F.col("o_orderkey") % 10 == 0, "c").otherwise(""), F.col("o_custkey").cast("string"))
    line = F.concat(key, F.lit(","), F.col("o_totalprice").cast("double").cast("string"), F.lit(',"'), F.col("o_orderpriority"), F.lit(', ""x""' + '"'))
    return tables.typed_lines(o.select("o_orderkey", line.alias("line")), "line", "custkey bigint, price double, note string")


@query("""WITH l AS (SELECT *, l_orderkey % 3 + 1 AS attempts FROM lineitem WHERE l_linenumber = 1), a AS (SELECT l_orderkey, unnest(range(1, 4)) AS attempt, attempts FROM l)
SELECT l_orderkey, attempt, CASE WHEN attempt < attempts THEN 'no players' ELSE 'ok' END AS outcome FROM a WHERE attempt <= attempts""")
def attempts(spark, sf_dir):
    """All tries of a game, those that failed, too: each later one reads only what the earlier ones missed."""
    left = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", (F.col("l_orderkey") % 3 + 1).alias("n"))
    tries = [left.where(F.col("n") >= k).select("l_orderkey", F.lit(k).cast("bigint").alias("attempt"), F.when(F.col("n") > k, "no players").otherwise("ok").alias("outcome")) for k in (1, 2, 3)]
    return tries[0].unionByName(tries[1]).unionByName(tries[2])


@query("""WITH g AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'no players' WHEN 2 THEN 'no page' ELSE 'error: BadPage' END AS reason FROM orders)
SELECT reason, count(*) AS games FROM g WHERE reason <> 'ok' GROUP BY 1""")
def missing_boxes(spark, sf_dir):
    """Games whose box score gave no player, by reason."""
    k = F.col("o_orderkey")
    cell = F.struct(*[F.lit("classic").alias("layout"), F.lit(0).alias("position_in_page")], *[F.lit("x").alias(c) for c in ("team", "jersey", "player", "position", "minutes", "goals", "assists", "shots", "shots_on_goal", "saves", "goals_allowed")])
    cells = F.when(k % 4 == 0, F.array(cell)).when(k % 4 == 1, F.array().cast(box.CELLS))
    best = table(spark, sf_dir, "orders").select(k.alias("game_id"), F.lit("u").alias("url"), F.when(k % 4 != 2, 1).alias("priority"), F.when(k % 4 == 3, "BadPage").alias("error"), cells.alias("cells"))
    return box.missing_boxes(best).groupBy("reason").agg(F.count("*").alias("games"))


@query(f"WITH {TOTALS_SQL} SELECT player_key, goals, assists FROM totals ORDER BY assists ASC, player_key LIMIT 15")
def dynamic_sort(spark, sf_dir):
    rows = totals(spark, sf_dir).select("player_key", "goals", "assists")
    return stats.page(rows, [F.asc("assists"), F.asc("player_key")]).drop("rank")


@query(f"WITH {TOTALS_SQL} SELECT player_key, goals FROM totals ORDER BY goals DESC, player_key LIMIT 10")
def top_goals(spark, sf_dir):
    return totals(spark, sf_dir).select("player_key", "goals").orderBy(F.desc("goals"), "player_key").limit(10)


@query("SELECT p_partkey, lower(p_name) AS name FROM part ORDER BY lower(p_name) DESC, p_partkey LIMIT 15")
def legacy_sort(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return stats.legacy_sorted(rows, "p_name", "p_partkey").limit(15).select("p_partkey", F.lower("p_name").alias("name"))


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS id, r_name AS conference FROM nation JOIN region ON n_regionkey = r_regionkey")
def team_cards(spark, sf_dir):
    teams = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return stats.team_cards(teams.select(F.col("n_name").alias("name_canonical"), F.col("n_nationkey").cast("string").alias("team_id"), F.col("r_name").alias("conference")))


@query("""WITH t AS (SELECT s_suppkey AS k, 'T' || (s_suppkey // 2 * 2) AS team_id, CASE WHEN s_suppkey % 5 = 0 THEN 'odd' ELSE 'custom' END AS p, CASE WHEN s_suppkey % 3 = 0 THEN 'x' WHEN s_suppkey % 3 = 1 THEN 'https://a.example' END AS u FROM supplier),
c AS (SELECT *, count(*) OVER (PARTITION BY team_id) AS n FROM t)
SELECT team_id, CAST(sum((u IS NULL)::INT + (n > 1)::INT + (p = 'odd')::INT + coalesce(u = 'x', FALSE)::INT) AS BIGINT) AS errors, count(*) AS teams FROM c WHERE u IS NULL OR n > 1 OR p = 'odd' OR u = 'x' GROUP BY 1""")
def inventory(spark, sf_dir):
    k = F.col("s_suppkey")
    teams = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("T"), (F.floor(k / 2) * 2).cast("string")).alias("team_id"), F.when(k % 5 == 0, "odd").otherwise("custom").alias("platform_guess"),
        F.when(k % 3 == 0, "x").when(k % 3 == 1, "https://a.example").alias("schedule_url"), F.lit("p").alias("parser_key"),
    )
    return quality.inventory_errors(teams).groupBy("team_id").agg(F.sum(F.size("errors")).cast("bigint").alias("errors"), F.count("*").alias("teams"))


@query(f"""WITH {GAMES_SQL}, c AS (SELECT * FROM games WHERE NOT ((home LIKE 'Team 1%' OR away LIKE 'Team 1%') AND date = '1995-03-05')),
k AS (SELECT seq, date || '-' || replace(least(home, away), ' ', '-') || '-' || replace(greatest(home, away), ' ', '-') AS dedupe_key FROM c) SELECT dedupe_key, max(seq) AS seq FROM k GROUP BY 1""")
def placeholder_dates(spark, sf_dir):
    rows = games(spark, sf_dir).select("seq", "date", F.col("home").alias("home_team_name"), F.col("away").alias("away_team_name"))
    return quality.clean_games(rows, "seq", {"^Team 1": "1995-03-05"}).select("dedupe_key", "seq")


@query(f"""WITH {TOTALS_SQL} SELECT '{{"player_key":' || player_key || ',"games_played":' || games_played || ',"minutes":' || minutes || ',"goals":' || goals || ',"assists":' || assists || ',"shots":' || shots || '}}' AS value FROM totals""")
def dashboard_rows(spark, sf_dir):
    return tables.dashboard_json(totals(spark, sf_dir).select("player_key", "games_played", "minutes", "goals", "assists", "shots"))


@query(f"""WITH {GAMES_SQL} SELECT CAST(seq AS VARCHAR) AS game_id, date, home AS home_team_name, away AS away_team_name, 'false' AS home_team_ranked, CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END AS away_team_ranked,
coalesce(CAST(home_score AS VARCHAR), '') AS home_score, coalesce(CAST(away_score AS VARCHAR), '') AS away_score, location_type, status, '' AS schedule_url, boxscore_url, dedupe_key FROM games""")
def flat_games(spark, sf_dir):
    rows = games(spark, sf_dir).withColumnsRenamed({"seq": "game_id", "home": "home_team_name", "away": "away_team_name"})
    rows = rows.withColumns({"home_team_ranked": F.lit(None).cast("boolean"), "away_team_ranked": F.col("game_id") % 2 == 0, "schedule_url": F.lit(None).cast("string")})
    return tables.flat_games(rows)


@query(f"""WITH {GAMES_SQL}, s AS (SELECT *, home_score IS NOT NULL AND away_score IS NOT NULL AS scored, date || ' - ' || home || ' vs ' || away AS line FROM games)
SELECT count(*) AS total, count(*) FILTER (date LIKE '%-01-01') AS unknown_dates, count(*) FILTER (scored) AS scored, count(*) FILTER (status = 'final' AND NOT scored) AS final_without_score,
round(count(*) FILTER (date LIKE '%-01-01') * 100.0::DOUBLE / count(*), 1) AS unknown_dates_percent, round(count(*) FILTER (scored) * 100.0::DOUBLE / count(*), 1) AS scored_percent,
(SELECT string_agg(line, '|' ORDER BY seq) FROM (SELECT * FROM s WHERE scored ORDER BY seq LIMIT 5)) AS with_scores, (SELECT string_agg(line, '|' ORDER BY seq) FROM (SELECT * FROM s WHERE status = 'final' AND NOT scored ORDER BY seq LIMIT 5)) AS final_without FROM s""")
def games_report(spark, sf_dir):
    rows = games(spark, sf_dir).withColumnsRenamed({"home": "home_team_name", "away": "away_team_name"})
    return quality.report(rows, "seq").withColumns({c: F.array_join(c, "|") for c in ("with_scores", "final_without")})


@query("""SELECT page_id, coalesce(regexp_extract(url, '/([0-9]+)($|[?])', 1), '') AS number, split_part(url || 'T1', 'T', 1) AS before, replace(regexp_replace('No.' || (page_id % 9) || '  ' || url, '^No[.] ?[0-9]+ +', ''), '  ', ' ') AS name FROM pages""")
def link_parts(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    number = F.regexp_replace(urls.page_game_id(F.col("url"), "p"), "^(p-|unknown$)", "")
    name = text.normalize_team_name(F.concat(F.lit("No."), (F.col("page_id") % 9).cast("string"), F.lit("  "), F.col("url")))
    return rows.select("page_id", number.alias("number"), dates.before_time(F.concat("url", F.lit("T1"))).alias("before"), name.alias("name"))


@query("""WITH h AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '<a href="https://wmt.games/x/' || page_id || '?a=1&amp;b=2">x</a>' ELSE '' END || '<a href="http://d.example/' || page_id || '.PDF">p</a> http://d.example/' || page_id || '.PDF, https://e.example/a/' || page_id || '.pdf' AS html FROM pages)
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://wmt.games/x/' || page_id || '?a=1&b=2' END AS other, 'http://d.example/' || page_id || '.PDF https://e.example/a/' || page_id || '.pdf' AS documents FROM h""")
def other_links(spark, sf_dir):
    k = F.col("page_id").cast("string")
    wmt = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<a href="https://wmt.games/x/'), k, F.lit('?a=1&amp;b=2">x</a>'))).otherwise("")
    html = F.concat(wmt, F.lit('<a href="http://d.example/'), k, F.lit('.PDF">p</a> http://d.example/'), k, F.lit(".PDF, https://e.example/a/"), k, F.lit(".pdf"))
    return table(spark, sf_dir, "pages").select("page_id", urls.other_platform_link(html).alias("other"), F.array_join(urls.document_links(html), " ").alias("documents"))


GREEDY_SQL = f"""WITH {GAMES_SQL}, p AS (SELECT date, min(seq) AS seq, least(home, away) AS a, greatest(home, away) AS b FROM games GROUP BY ALL),
d AS (SELECT date, list({{'seq': seq, 'a': a, 'b': b}} ORDER BY seq) AS games FROM p GROUP BY date),
f AS (SELECT date, list_reduce(list_transform(games, lambda g: {{'seen': [g.a, g.b], 'kept': [g.seq]}}), lambda x, y: CASE WHEN list_has_any(x.seen, y.seen) THEN x ELSE {{'seen': list_concat(x.seen, y.seen), 'kept': list_concat(x.kept, y.kept)}} END) AS r FROM d)
SELECT seq, date, home, away FROM games JOIN (SELECT unnest(r.kept) AS seq FROM f) USING (seq)"""


@query(GREEDY_SQL)
def greedy_team_date(spark, sf_dir):
    return merge.greedy_by_date(games(spark, sf_dir).select("seq", "date", "home", "away"), "date", "home", "away", "seq")
