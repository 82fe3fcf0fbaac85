"""Named queries over the benchmark tables, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyfield.functions import dates, numbers, status, text, urls
from tallyfield.operators import identity, merge, quality, stats

from . import page_queries, report_queries  # noqa: F401  register their queries
from .analogues import GAMES_SQL, TOTALS_SQL, games, split, table, total_points, totals
from .registered import ORACLES, QUERIES, query  # noqa: F401
from .report_queries import greedy_team_date  # noqa: F401

@query(f"WITH {TOTALS_SQL} SELECT * FROM totals")
def season_totals(spark, sf_dir):
    return totals(spark, sf_dir)


RATES = """goals::DOUBLE / CASE WHEN minutes = 0 THEN 1 ELSE minutes END * 90 AS g_per_90,
  assists::DOUBLE / CASE WHEN minutes = 0 THEN 1 ELSE minutes END * 90 AS a_per_90,
  CASE WHEN shots > 0 THEN goals::DOUBLE / shots * 100 ELSE 0 END AS conversion_rate"""


@query(f"WITH {TOTALS_SQL} SELECT *, {RATES}, 2 * goals + assists AS points FROM totals ORDER BY 2 * goals + assists DESC, minutes DESC, player_key LIMIT 10")
def season_leaders(spark, sf_dir):
    return stats.by_points(stats.with_rates(totals(spark, sf_dir)), "player_key").limit(10).withColumn("points", total_points())


@query(f"""WITH {TOTALS_SQL} SELECT n_name AS team_id, count(*) AS players, CAST(sum(goals) AS BIGINT) AS goals
FROM totals LEFT JOIN supplier ON player_key = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def team_totals(spark, sf_dir):
    team = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("team_id"))
    return totals(spark, sf_dir).join(team, F.col("player_key") == F.col("s_suppkey"), "left").groupBy("team_id").agg(F.count("*").alias("players"), F.sum("goals").alias("goals"))


@query(f"WITH {TOTALS_SQL} SELECT count(*) AS players, CAST(coalesce(sum(goals), 0) AS BIGINT) AS goals, CASE WHEN count(*) > 0 THEN sum(goals)::DOUBLE / count(*) ELSE 0 END AS goals_per_player FROM totals")
def kpi_summary(spark, sf_dir):
    return stats.kpis(totals(spark, sf_dir))


@query(f"WITH {TOTALS_SQL} SELECT player_key, goals FROM totals ORDER BY goals DESC, player_key LIMIT 1")
def top_scorer(spark, sf_dir):
    return stats.best(totals(spark, sf_dir), F.col("goals"), "player_key").select("player_key", "goals")


@query(f"WITH {TOTALS_SQL} SELECT player_key, {RATES} FROM totals WHERE goals >= 3 ORDER BY conversion_rate DESC, player_key LIMIT 1")
def most_efficient(spark, sf_dir):
    rows = stats.with_rates(totals(spark, sf_dir).where("goals >= 3"))
    return stats.best(rows, F.col("conversion_rate"), "player_key").select("player_key", "g_per_90", "a_per_90", "conversion_rate")


@query(f"""WITH {TOTALS_SQL}, t AS (SELECT * FROM totals ORDER BY goals + assists DESC, player_key LIMIT 10)
SELECT player_key, 'goals' AS series, goals AS value FROM t UNION ALL SELECT player_key, 'assists', assists FROM t""")
def top_contributors(spark, sf_dir):
    top = totals(spark, sf_dir).orderBy((F.col("goals") + F.col("assists")).desc(), "player_key").limit(10)
    return top.select("player_key", "goals", "assists").unpivot("player_key", ["goals", "assists"], "series", "value")


@query(f"WITH {TOTALS_SQL} SELECT player_key, shots, goals, goals::DOUBLE / shots > 0.2 AS efficient FROM totals WHERE shots >= 5")
def efficiency_points(spark, sf_dir):
    return totals(spark, sf_dir).where("shots >= 5").select("player_key", "shots", "goals", (F.col("goals").cast("double") / F.col("shots") > 0.2).alias("efficient"))


@query(f"WITH {TOTALS_SQL}, r AS (SELECT *, {RATES} FROM totals) SELECT player_key, g_per_90, a_per_90 FROM r WHERE minutes > 300")
def per90_points(spark, sf_dir):
    return stats.with_rates(totals(spark, sf_dir).where("minutes > 300")).select("player_key", "g_per_90", "a_per_90")


@query("SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE contains(lower(s_name), '00000000') OR contains(lower(n_name), '00000000')")
def player_search(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return stats.searched(rows, "00000000", name="s_name", team_col="n_name").select("s_suppkey", "s_name")


@query("SELECT DISTINCT n_name AS team_id FROM nation ORDER BY 1")
def team_list(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("team_id")).distinct().orderBy("team_id")


@query(f"WITH {TOTALS_SQL}, r AS (SELECT player_key, goals, CAST(row_number() OVER (ORDER BY goals DESC, player_key) AS INTEGER) AS rank FROM totals) SELECT * FROM r WHERE rank BETWEEN 16 AND 30")
def player_page(spark, sf_dir):
    return stats.page(totals(spark, sf_dir).select("player_key", "goals"), [F.desc("goals"), F.asc("player_key")], number=2)


@query(f"WITH {GAMES_SQL} SELECT seq, date, home, away FROM games WHERE home = 'Team 7' OR away = 'Team 7'")
def games_by_team(spark, sf_dir):
    return games(spark, sf_dir).where("home = 'Team 7' or away = 'Team 7'").select("seq", "date", "home", "away")


@query(f"WITH {GAMES_SQL} SELECT split_part(date, '-', 1) AS season, count(*) AS games FROM games GROUP BY 1")
def season_partition(spark, sf_dir):
    return games(spark, sf_dir).groupBy(dates.season(F.col("date")).alias("season")).agg(F.count("*").alias("games"))


@query(f"""WITH {GAMES_SQL} SELECT seq, date || '-' || replace(least(home, away), ' ', '-') || '-' || replace(greatest(home, away), ' ', '-') AS dedupe_key,
 'g-' || date || '-' || replace(home, ' ', '-') || '-' || replace(away, ' ', '-') AS game_id, date || '__' || lower(home) || '__' || lower(away) AS reconcile_key,
 rtrim(to_base64(encode(date || ':' || home || ':' || away)), '=') AS encoded FROM games""")
def dedupe_keys(spark, sf_dir):
    d, h, a = F.col("date"), F.col("home"), F.col("away")
    return games(spark, sf_dir).select("seq", text.dedupe_key(d, h, a).alias("dedupe_key"), text.game_id(d, h, a, "g").alias("game_id"), text.reconcile_key(d, h, a).alias("reconcile_key"), text.encoded_key(text.colon_key(d, h, a)).alias("encoded"))


MERGE = "dedupe_key, seq, date, home, status, location_type, home_score, away_score, boxscore_url"
OLD_NEW = f"{GAMES_SQL}, old AS (SELECT * FROM games WHERE (seq // 3) % 2 = 0), new AS (SELECT * FROM games WHERE (seq // 3) % 2 <> 0)"
LAST_OLD = "last AS (SELECT * FROM old QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1)"


def _first(column: str, ok: str) -> str:
    return f"coalesce(arg_min({column}, row(phase, seq)) FILTER ({ok}), arg_min({column}, row(phase, seq))) AS {column}"


@query(f"""WITH {OLD_NEW}, {LAST_OLD}, u AS (SELECT 0 AS phase, * FROM last UNION ALL SELECT 1, * FROM new)
SELECT dedupe_key, arg_min(u.seq, row(phase, seq)) AS seq, arg_min(date, row(phase, seq)) AS date, arg_min(home, row(phase, seq)) AS home,
{_first("status", "status <> 'scheduled'")}, {_first("location_type", "location_type <> 'unknown'")}, {_first("home_score", "home_score IS NOT NULL")},
{_first("away_score", "away_score IS NOT NULL")}, {_first("boxscore_url", "boxscore_url <> ''")} FROM u GROUP BY dedupe_key""")
def upsert_merge(spark, sf_dir):
    old, new = split(games(spark, sf_dir).select(*MERGE.split(", ")))
    return merge.upsert_merge(old, new, "dedupe_key", "seq")


@query(f"""WITH {OLD_NEW}, u AS (SELECT 0 AS phase, * FROM old UNION ALL SELECT 1, * FROM new)
SELECT dedupe_key, seq, status, CASE WHEN max(phase) OVER w = 0 THEN 'kept' WHEN min(phase) OVER w = 1 THEN 'added' ELSE 'updated' END AS outcome
FROM u WINDOW w AS (PARTITION BY dedupe_key) QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY phase DESC, seq DESC) = 1""")
def upsert_overwrite(spark, sf_dir):
    old, new = split(games(spark, sf_dir).select("dedupe_key", "seq", "status"))
    return merge.upsert_overwrite(old, new, "dedupe_key", "seq")


@query(f"""WITH {OLD_NEW}, n AS (SELECT dedupe_key, count(*) AS c FROM new GROUP BY 1), a AS (SELECT count(*) AS added FROM n WHERE dedupe_key NOT IN (SELECT dedupe_key FROM old))
SELECT added, CAST((SELECT sum(c) FROM n) - added AS BIGINT) AS updated FROM a""")
def upsert_counts(spark, sf_dir):
    old, new = split(games(spark, sf_dir).select("dedupe_key", "seq"))
    return merge.upsert_counts(old, new, "dedupe_key")


@query("SELECT user_id, event_id, event_type, min(event_id) OVER (PARTITION BY user_id) AS place FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def dedupe_last(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return merge.last_values_first_place(rows, ["user_id"], ["event_id"]).withColumn("place", F.col("place.event_id"))


ORIGIN_SQL = "lower(regexp_extract(url, '^(https?://[^/?#]+)', 1))"


@query(f"SELECT {ORIGIN_SQL} AS origin, min(page_id) AS page_id, count(*) AS pages FROM pages GROUP BY 1")
def first_origin(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(urls.origin(F.col("url")).alias("origin"), "page_id")
    return rows.groupBy("origin").agg(F.min_by("page_id", "page_id").alias("page_id"), F.count("*").alias("pages"))


@query(f"""WITH {OLD_NEW}, {LAST_OLD}, n AS (SELECT * FROM new QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq DESC) = 1),
b AS (SELECT coalesce(n.dedupe_key, last.dedupe_key) AS dedupe_key, n.seq AS ns, last.seq AS os, n.status AS nst, last.status AS ost,
 coalesce(CAST(n.home_score AS VARCHAR), '') AS nh, coalesce(CAST(last.home_score AS VARCHAR), '') AS oh FROM n FULL JOIN last ON n.dedupe_key = last.dedupe_key)
SELECT dedupe_key, CASE WHEN os IS NULL THEN 'MISSING_IN_CSV' WHEN ns IS NULL THEN 'CSV_ONLY' WHEN nst = ost AND nh = oh THEN 'OK' ELSE 'DIFF' END AS outcome,
CASE WHEN os IS NULL OR ns IS NULL THEN '' ELSE concat_ws(' | ', CASE WHEN nst <> ost THEN 'status: ' || ost || ' -> ' || nst END, CASE WHEN nh <> oh THEN 'home_score: ' || oh || ' -> ' || nh END) END AS detail FROM b""")
def reconcile(spark, sf_dir):
    old, new = split(games(spark, sf_dir).select("dedupe_key", "seq", "status", "home_score"))
    return merge.reconcile(merge.keep_last(new, ["dedupe_key"], ["seq"]), old, "dedupe_key", "seq", ["status", "home_score"])


@query(f"WITH {OLD_NEW} SELECT seq, dedupe_key FROM old UNION ALL SELECT seq, dedupe_key FROM new WHERE dedupe_key NOT IN (SELECT dedupe_key FROM old)")
def insert_if_absent(spark, sf_dir):
    old, new = split(games(spark, sf_dir).select("seq", "dedupe_key"))
    return merge.insert_if_absent(old, new, ["dedupe_key"])


@query(f"WITH {GAMES_SQL} SELECT dedupe_key, seq % 3 AS layout, seq FROM games QUALIFY row_number() OVER (PARTITION BY dedupe_key ORDER BY seq % 3 DESC, seq DESC) = 1")
def layout_override(spark, sf_dir):
    rows = games(spark, sf_dir).select("dedupe_key", (F.col("seq") % 3).alias("layout"), "seq")
    return merge.keep_last(rows, ["dedupe_key"], ["layout", "seq"])


@query("""WITH a AS (SELECT upper(trim(n_name)) AS alias, n_name AS team_id FROM nation UNION ALL SELECT 'USA', 'UNITED STATES' UNION ALL SELECT 'UK', 'UNITED KINGDOM'),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' usa ' WHEN c_custkey % 3 = 1 THEN 'Atlantis' ELSE lower(n_name) END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT c_custkey, name, a.team_id FROM c LEFT JOIN a ON upper(trim(name)) = a.alias""")
def alias_resolution(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    teams = nation.select(F.col("n_name").alias("team_id"), F.col("n_name").alias("name_canonical"), F.lit(None).cast("array<string>").alias("aliases"))
    aliases = spark.createDataFrame([("UNITED STATES", "usa"), ("UNITED KINGDOM", "uk")], "team_id string, alias string")
    name = F.when(F.col("c_custkey") % 3 == 0, " usa ").when(F.col("c_custkey") % 3 == 1, "Atlantis").otherwise(F.lower("n_name"))
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", name.alias("name"))
    return identity.resolve(rows, "name", identity.alias_table(aliases, teams))


@query(f"WITH {GAMES_SQL} SELECT a.seq AS a, b.seq AS b FROM games a JOIN games b ON a.date = b.date AND a.seq < b.seq AND least(a.home, a.away) = least(b.home, b.away) AND greatest(a.home, a.away) = greatest(b.home, b.away)")
def team_set_equality(spark, sf_dir):
    g = games(spark, sf_dir).select("seq", "date", text.team_set(F.col("home"), F.col("away")).alias("teams"))
    return g.select(F.col("seq").alias("a"), "date", "teams").join(g.select(F.col("seq").alias("b"), "date", "teams"), ["date", "teams"]).where("a < b").select("a", "b")


INITIALS_SQL = "list_aggregate(list_transform(list_filter(regexp_split_to_array({0}, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN length(w) <= 3 THEN lower(w) ELSE lower(w[1:1]) END), 'string_agg', '')"


@query(f"""WITH p AS (SELECT s_suppkey, s_nationkey, a.n_name AS left_name, b.n_name AS right_name, b.n_nationkey FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey),
m AS (SELECT *, regexp_replace(lower(left_name), '[^a-z0-9]', '', 'g') AS x, regexp_replace(lower(right_name), '[^a-z0-9]', '', 'g') AS y FROM p)
SELECT n_nationkey AS team, min(s_suppkey) AS s_suppkey FROM m WHERE contains(x, y) OR contains(y, x) OR {INITIALS_SQL.format("left_name")} = {INITIALS_SQL.format("right_name")} GROUP BY 1""")
def fuzzy_match(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    left = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", F.col("n_name").alias("left_name")).agg(F.min("s_suppkey").alias("s_suppkey"))
    right = nation.select(F.col("n_nationkey").alias("team"), F.col("n_name").alias("right_name"), "n_regionkey")
    return merge.first_match(left, right, ["n_regionkey"], "left_name", "right_name", "s_suppkey", "team").select("team", "s_suppkey")


LINK = 'href="([^"]*)"'


@query(f"""WITH l AS (SELECT page_id, url, regexp_extract_all(html, '{LINK}', 1) AS links FROM pages), z AS (SELECT page_id, url, unnest(links) AS raw, generate_subscripts(links, 1) - 1 AS pos FROM l),
o AS (SELECT *, {ORIGIN_SQL} AS origin FROM z)
SELECT page_id, CAST(pos AS INTEGER) AS pos, CASE WHEN raw = '' THEN NULL WHEN regexp_matches(lower(raw), '^https?://') THEN raw WHEN raw LIKE '//%' THEN 'https:' || raw WHEN raw LIKE '/%' THEN origin || raw ELSE origin || '/' || raw END AS link FROM o""")
def url_resolution(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit(LINK), F.lit(1))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(found).alias("pos", "raw"))
    return rows.select("page_id", "pos", urls.resolve_box_url(F.col("raw"), F.col("url")).alias("link"))


@query(f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS links FROM pages), z AS (SELECT page_id, unnest(links) AS raw, generate_subscripts(links, 1) - 1 AS pos FROM l)
SELECT n.n_nationkey AS pos, p.page_id, coalesce(nullif(z.raw, ''), '/none') AS link FROM pages p CROSS JOIN nation n LEFT JOIN z ON z.page_id = p.page_id AND z.pos = n.n_nationkey""")
def zip_positions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    positions = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"))
    rows = pages.select("page_id").crossJoin(identity.small_side(positions)).withColumn("link", F.lit("/none"))
    harvested = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("pos", "mapped"))
    return merge.zip_positions(rows, harvested, ["page_id", "pos"], "link", "mapped").select("pos", "page_id", "link")


@query(f"SELECT page_id, {ORIGIN_SQL} AS origin, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS slug FROM pages")
def url_origin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"), text.slug(F.col("url")).alias("slug"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.page') AS page FROM events")
def json_fields(spark, sf_dir):
    row = F.from_json("props", "k string, page string")
    return table(spark, sf_dir, "events").select("event_id", row["k"].alias("k"), row["page"].alias("page"))


@query(f"""WITH {GAMES_SQL} SELECT seq, CASE WHEN status = 'final' THEN 'final' WHEN seq % 4 = 1 THEN 'postponed' WHEN seq % 4 = 2 THEN 'canceled' ELSE 'scheduled' END AS of_code,
CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN 'final' WHEN status = 'postponed' THEN 'postponed' WHEN status = 'final' THEN 'final' ELSE 'scheduled' END AS of_text,
CASE WHEN home_score IS NOT NULL AND away_score IS NOT NULL THEN CASE WHEN seq % 2 = 0 THEN home_score ELSE away_score END END AS home FROM games""")
def status_mapping(spark, sf_dir):
    code = F.when(F.col("seq") % 4 == 1, "P").when(F.col("seq") % 4 == 2, "C").otherwise("A")
    line = F.coalesce(F.concat(F.col("home_score").cast("string"), F.lit(" - "), F.col("away_score").cast("string")), F.initcap("status"))
    found = status.scores(line, F.col("seq") % 2 == 0)
    return games(spark, sf_dir).select("seq", status.status_of_code(code, F.when(F.col("status") == "final", "W")).alias("of_code"), status.status_of_text(line).alias("of_text"), found["home"].alias("home"))


@query("""SELECT p_partkey, trim(regexp_replace('No. 7  ' || p_name || ' *', '^No. 7 +|[*]', '', 'g')) AS name, TRUE AS ranked, trim(p_name) AS player,
regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || ':' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS player_key FROM part""")
def name_cleaning(spark, sf_dir):
    raw = F.concat(F.lit("No. 7  "), F.col("p_name"), F.lit(" *"))
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_team_name(raw).alias("name"), text.is_ranked(raw).alias("ranked"), text.clean_player_name(F.concat(F.lit("#12 "), F.col("p_name"))).alias("player"), text.player_key(F.col("p_brand"), F.col("p_name")).alias("player_key"))


@query("""SELECT p_partkey, trim(p_name) AS name, p_partkey % 6 BETWEEN 1 AND 4 AS ranked FROM part""")
def rank_forms(spark, sf_dir):
    """Each form of a rank, and a name said twice, gives the plain name."""
    k, name = F.col("p_partkey") % 6, F.trim("p_name")
    raw = F.concat(F.when(k == 1, "No. 12 ").when(k == 2, "no 7  ").when(k == 3, "#5 ").when(k == 4, "# 23 ").when(k == 5, F.concat(name, F.lit("  "))).otherwise("* "), name, F.lit(" **"))
    raw = F.when(k == 5, F.concat(name, F.lit("  "), name)).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", text.clean_team_name(raw).alias("name"), text.is_ranked(raw).alias("ranked"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS long_form, '2025-' || strftime(o_orderdate, '%m-%d') AS short_form, strftime(o_orderdate, '%Y-%m-%d') AS iso, '2025-01-01' AS none FROM orders""")
def date_parsing(spark, sf_dir):
    d, year = F.col("o_orderdate"), F.lit(2025)
    forms = {"long_form": F.date_format(d, "EEE, MMM d, yyyy"), "short_form": F.concat(F.date_format(d, "M/d"), F.lit(" (Thu)")), "iso": F.date_format(d, "yyyy-MM-dd'T'HH:mm"), "none": F.lit("TBA")}
    return table(spark, sf_dir, "orders").select("o_orderkey", *[dates.parse_date(f, year).alias(k) for k, f in forms.items()])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) + (l_partkey % 60) / 60.0::DOUBLE AS minutes, CAST(l_quantity AS BIGINT) AS whole, l_extendedprice AS number FROM lineitem""")
def minutes_parsing(spark, sf_dir):
    clock = F.format_string("%d:%02d", F.col("l_quantity").cast("bigint"), F.col("l_partkey") % 60)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", numbers.minutes(clock).alias("minutes"), numbers.int_or_zero(F.col("l_quantity").cast("string")).alias("whole"), numbers.to_number(F.col("l_extendedprice").cast("string")).alias("number"))


@query(f"WITH {GAMES_SQL} SELECT count(*) AS total, count(*) FILTER (date LIKE '%-01-01') AS unknown_dates, count(*) FILTER (home_score IS NOT NULL AND away_score IS NOT NULL) AS scored, count(*) FILTER (status = 'final' AND (home_score IS NULL OR away_score IS NULL)) AS final_without_score FROM games")
def quality_profile(spark, sf_dir):
    return quality.profile(games(spark, sf_dir), F.col("date"), F.col("home_score"), F.col("away_score"), F.col("status"))


@query(f"""WITH {GAMES_SQL}, c AS (SELECT seq, date, home, CASE WHEN seq % 11 = 0 THEN 'Home Team' ELSE away END AS away FROM games),
k AS (SELECT *, date || '-' || replace(least(home, away), ' ', '-') || '-' || replace(greatest(home, away), ' ', '-') AS dedupe_key FROM c WHERE away <> 'Home Team' AND NOT (home = 'Team 3' AND date LIKE '1995-%'))
SELECT dedupe_key, max(seq) AS seq, min(seq) AS place FROM k GROUP BY 1""")
def clean_games(spark, sf_dir):
    away = F.when(F.col("seq") % 11 == 0, "Home Team").otherwise(F.col("away"))
    rows = games(spark, sf_dir).where("not (home = 'Team 3' and date like '1995-%')").select("seq", "date", F.col("home").alias("home_team_name"), away.alias("away_team_name"))
    return quality.clean_games(rows, "seq").select("dedupe_key", "seq", F.col("place.seq").alias("place"))


@query("SELECT l_linestatus, count(*) AS n FROM (SELECT * FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT * FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1")
def union_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.where("l_returnflag = 'R'").unionByName(rows.where("l_returnflag <> 'R'")).groupBy("l_linestatus").agg(F.count("*").alias("n"))
