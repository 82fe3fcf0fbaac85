"""The store's switch when a writer fails, splittable ordered CSV, typed scans, the greedy selection of a large date, the jobs."""

import json
import os
import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tallyfield.jobs import season
from tallyfield.operators import merge, stats
from tallyfield.sources import store, tables


def seasons(spark, path):
    return {(str(r.season), r.k) for r in store.read(spark, path).select("season", "k").collect()}


def hidden(path):
    return [x for x in os.listdir(path) if x.startswith(("_swap", "swap")) or "kept" in x]


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "season string, k int")


class Broken(Exception):
    pass


@pytest.mark.parametrize("moves", [0, 1, 2, 3, 4])
def test_a_switch_that_fails_is_completed(spark, tmp_path, monkeypatch, moves):
    path = str(tmp_path / "store")
    store.replace_seasons(rows(spark, ("2023", 1), ("2024", 1), ("2025", 1)), path)
    done = []

    def failing(self, old, new, real=store.Folder.move):
        if len(done) == moves:
            raise Broken
        done.append(real(self, old, new))

    monkeypatch.setattr(store.Folder, "move", failing)
    change = rows(spark, ("2024", 2), ("2025", 2), ("2026", 2))
    wanted = {("2023", 1), ("2024", 2), ("2025", 2), ("2026", 2)}
    if moves < 5:
        with pytest.raises(Broken):
            store.replace_seasons(change, path)
    monkeypatch.undo()
    assert seasons(spark, path) == wanted  # the journal was there, so the new seasons count
    store.replace_seasons(store.read(spark, path).where("season = '2025'").withColumn("k", F.col("k") + 1).select("season", "k"), path)
    assert seasons(spark, path) == wanted - {("2025", 2)} | {("2025", 3)} and not hidden(path)
    assert {(str(r.season), r.k) for r in spark.read.parquet(path).collect()} == seasons(spark, path)


def test_a_writer_that_fails_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.replace_seasons(rows(spark, ("2024", 1)), path)
    with pytest.raises(Exception):
        store.replace_seasons(rows(spark, ("2024", 2)).withColumn("k", F.raise_error(F.lit("broken")).cast("int")), path)
    assert seasons(spark, path) == {("2024", 1)} and not hidden(path)

    def failing(self, name, real=store.Folder.make):
        raise Broken

    monkeypatch.setattr(store.Folder, "make", failing)
    with pytest.raises(Broken):
        store.replace_seasons(rows(spark, ("2024", 2)), path)
    monkeypatch.undo()
    assert seasons(spark, path) == {("2024", 1)} and not hidden(path)
    with pytest.raises(AnalysisException):
        store.read(spark, str(tmp_path / "none"))


def test_split_files_keep_their_order(spark, tmp_path):
    for name in ("a", "b"):
        lines = [f'{name}{i:05},"x, ""{i}"" {"y" * 40}"' for i in range(4000)]
        (tmp_path / f"{name}.csv").write_text("k,v\n" + "\n\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        read = tables.read_csv_ordered(spark, str(tmp_path), ["k", "v"])
        assert read.rdd.getNumPartitions() > 8
        got = [r.k for r in read.orderBy("seq").collect()]
        ends = read.agg(F.min_by("k", "seq").alias("first"), F.max_by("k", "seq").alias("last"), F.max_by("v", "seq").alias("v")).head()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [f"{n}{i:05}" for n in "ab" for i in range(4000)]
    assert (ends.first, ends.last, ends.v[:9]) == ("a00000", "b03999", 'x, "3999"')
    (tmp_path / "m").mkdir()
    (tmp_path / "m/m.csv").write_text('k,v\n1,"two\nlines"\n2,z\n')
    assert [tuple(r) for r in tables.read_csv(spark, str(tmp_path / "m"), ["k", "v"], multiline=True).collect()] == [("1", "two\nlines"), ("2", "z")]


def test_typed_scan_keeps_what_does_not_fit(spark, tmp_path):
    (tmp_path / "t.csv").write_text('k,v,w\n1,2.5,"a, b"\nx,3.5,c\n3\n4,5.5,d,more\n')
    got = [tuple(r) for r in tables.read_typed(spark, str(tmp_path / "t.csv"), "k bigint, v double, w string").collect()]
    assert got == [(1, 2.5, "a, b", None), (None, 3.5, "c", "x,3.5,c"), (3, None, None, "3"), (4, 5.5, "d", "4,5.5,d,more")]
    missing = str(tmp_path / "none.csv")
    assert tables.read_typed(spark, missing, "k bigint", missing_ok=True).columns == ["k", "reject"]
    with pytest.raises(AnalysisException):
        tables.read_typed(spark, missing, "k bigint")


def sequential(games):
    kept, seen = set(), set()
    for seq, date, home, away in sorted(games):
        if not {(date, home), (date, away)} & seen:
            kept.add(seq)
            seen |= {(date, home), (date, away)}
    return kept


@pytest.mark.parametrize("folded", [0, 30, 2000])
def test_greedy_selection_in_rounds(spark, monkeypatch, folded):
    monkeypatch.setattr(merge, "FOLDED", folded)
    rng = random.Random(folded)
    games = [(i, rng.choice(["d1", "d1", "d2", "d3"]), f"t{rng.randrange(30)}", f"t{rng.randrange(30)}") for i in rng.sample(range(10_000), 900)]
    games += [(20_000 + i, "chain", f"c{i}", f"c{i + 1}") for i in range(12)]
    got = merge.greedy_by_date(spark.createDataFrame(games, "seq int, date string, home string, away string").repartition(5), "date", "home", "away", "seq")
    assert {r.seq for r in got.collect()} == sequential(games)


def test_greedy_selection_of_a_million_undated_games(spark):
    games = spark.range(1_000_000).selectExpr("id AS seq", "'2025-01-01' AS date", "concat('t', pmod(hash(id), 3000)) AS home", "concat('t', pmod(hash(id, 7), 3000)) AS away")
    got = merge.greedy_by_date(games, "date", "home", "away", "seq")
    assert {r.seq for r in got.select("seq").collect()} == sequential([tuple(r) for r in games.collect()])


PAGE = '<h1>2025</h1><li class="sidearm-schedule-game"><div class="sidearm-schedule-game-opponent-date"><span>Aug {0}</span></div><div class="sidearm-schedule-game-opponent-name">{1}</div><a href="https://h.example/boxscore/{0}">Box Score</a></li>'
BOX = '<table class="advanced-table__table"><thead><tr><th>Alpha - Field</th></tr></thead><tbody><tr><td>F</td><td>9</td><td>Ann Lee</td><td>3</td><td>2</td><td>1</td><td>0</td><td>79:30</td></tr></tbody></table>'


def test_jobs_count_and_list_what_fails(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "pages").mkdir()
    for name, body in {"a": PAGE.format(21, "Yale") + PAGE.format(22, "Rook"), "b": "<p>none", "c": '<script type="application/ld+json">' + "[" * 100_000 + "</script>"}.items():
        (tmp_path / f"pages/{name}.html").write_text(body)
    for _ in range(2):
        assert season.schedules(spark, at("pages"), at("store"), "Vale", "2025", at("failed")) == {"total": 3, "finished": 1, "failed": 2}
    assert {(r.page_id[-6:], r.outcome.split(":")[0]) for r in spark.read.parquet(at("failed")).collect()} == {("b.html", "no games"), ("c.html", "error")}
    assert store.read(spark, at("store")).count() == 2
    (tmp_path / "boxes").mkdir()
    (tmp_path / "boxes/h_example_boxscore_21").write_text(BOX)
    assert season.boxscores(spark, at("store"), at("boxes"), at("out"), "0", at("missing")) == {"total": 2, "finished": 1, "failed": 1}
    assert [(r.reason, r.teams) for r in spark.read.parquet(at("missing")).collect()] == [("no page", "Rook vs Vale")]
    assert tables.read_csv(spark, at("out"), tables.PLAYER_STATS).count() == 1
    season.totals(spark, at("out"), at("totals"))
    season.dashboard(spark, at("totals"), at("json"))
    assert [json.loads(r.value)["goals"] for r in spark.read.text(at("json")).collect()] == [1]
    tables.write_csv(tables.flat_games(store.read(spark, at("store")).drop("season")).orderBy("date").coalesce(1), at("csv"))
    season.compare(spark, at("pages"), at("store"), "Vale", at("compared"))
    assert {r.outcome for r in spark.read.parquet(at("compared")).collect()} == {"OK"}
    season.analyze(spark, at("csv"), at("report"))
    report = json.loads(spark.read.text(at("report")).head().value)
    assert (report["total"], report["scored_percent"], report["with_scores"]) == (2, 0.0, [])


def test_link_repair_job(spark, tmp_path):
    games = [("g1", " Cal ", "Rook", "/box/1", ""), ("g2", "Rook", "Elm", "https://R.example/x", ""), ("g3", "Elm", "Oak", "/box/3", "https://e.example:443/s"), ("g4", "Oak", "Ash", "box/4", ""), ("g5", "Ash", "Fir", "/box/5", "")]
    frame = spark.createDataFrame(games, "game_id string, home_team_name string, away_team_name string, boxscore_url string, schedule_url string")
    for c in tables.GAMES:
        frame = frame if c in frame.columns else frame.withColumn(c, F.lit(""))
    tables.write_csv(frame.select(*tables.GAMES).coalesce(1), str(tmp_path / "games"))
    season.repair(spark, str(tmp_path / "games"), str(tmp_path / "out"), "Cal=https://cal.example")
    got = {r.game_id: r.boxscore_url for r in tables.read_csv(spark, str(tmp_path / "out"), tables.GAMES).collect()}
    # the link of g2 names Elm's domain, too, as its first; Oak's comes from the schedule of g3
    assert got == {"g1": "https://cal.example/box/1", "g2": "https://R.example/x", "g3": "https://r.example/box/3", "g4": "box/4", "g5": "/box/5"}


def test_inventory_tells_how_many_teams_have_errors(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"team_id": "X", "schedule_url": "https://x.example", "platform_guess": "custom", "parser_key": "k"}, {"team_id": "Y"}]))
    assert season.inventory(spark, str(tmp_path / "t.json"), str(tmp_path / "out")) == 1


def test_too_many_statistics_are_an_error(spark):
    table = spark.range(30).select("id", F.create_map(F.concat(F.lit("s"), F.col("id").cast("string")), F.col("id")).alias("m"))
    with pytest.raises(ValueError):
        stats.stats_columns(table, "id", F.col("m"), most=29)
    assert len(stats.stats_columns(table, "id", F.col("m"), most=30).columns) == 31


def test_master_rows_and_typed_tables(spark, tmp_path):
    games = spark.createDataFrame([("g1", "2025-09-01", "A", "B", True, None, 2, None, "home", "final", "https://s", None, "k")], "game_id string, date string, home_team_name string, away_team_name string, home_team_ranked boolean, away_team_ranked boolean, home_score int, away_score int, location_type string, status string, schedule_url string, boxscore_url string, dedupe_key string")
    tables.write_csv(tables.flat_games(games), str(tmp_path / "flat"))
    assert tables.typed_games(tables.read_csv(spark, str(tmp_path / "flat"), tables.GAMES)).collect() == games.na.fill({"away_team_ranked": False}).collect()
    tables.write_csv(tables.master_rows(games), str(tmp_path / "master"))
    got = tables.read_master(spark, str(tmp_path / "master")).head()
    assert got.source_urls.schedule_url == "https://s" and got.source_urls.boxscore_url is None and got.home_score == "2"
    (tmp_path / "p.csv").write_text("game_id,team_id,player_name,player_key,jersey_number,minutes,goals,assists,shots,shots_on_goal,saves\ng,t,n,k,9,79.5,2x,,3,1,0\n")
    row = tables.typed_player_stats(tables.read_csv(spark, str(tmp_path / "p.csv"), tables.PLAYER_STATS)).head()
    assert (row.minutes, row.goals, row.assists, row.shots) == (79.5, 2, None, 3)
