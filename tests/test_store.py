"""Files, the incremental merge and the batch jobs."""

import json

from pyspark.sql import functions as F

from tallyfield.jobs import season
from tallyfield.operators import stats
from tallyfield.sources import tables
from tallyfield.streaming.merge import merge_stream

STATS = """game_id,team_id,player_name,player_key,jersey_number,minutes,goals,assists,shots,shots_on_goal,saves
g1,Alpha,"Lee, Ann",alpha:annlee,10,79.5,1,0,5,1,0

g1,Alpha,Kay Roe,alpha:kayroe,1,90,,,,,4
g1,Alpha,Kay Roe,alpha:kayroe,1,90,0,0,0,0,0
"""


def test_totals_from_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text(STATS)
    season.totals(spark, str(tmp_path / "s.csv"), str(tmp_path / "out"))
    got = {r.player_key: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (got["alpha:annlee"].games_played, got["alpha:annlee"].minutes, got["alpha:annlee"].player_name) == (1, 79, "Lee, Ann")
    kay = got["alpha:kayroe"]
    assert (kay.games_played, kay.distinct_games, kay.minutes, kay.saves) == (2, 1, 180, 4)
    found = stats.dashboard(spark.read.parquet(str(tmp_path / "out")), term="ANN")
    assert [r.player_key for r in found["page"].collect()] == ["alpha:annlee"]
    assert found["kpis"].head() == (1, 1, 1.0) and found["pages"].head().pages == 1
    lines = [json.loads(r.value) for r in tables.dashboard_json(spark.read.parquet(str(tmp_path / "out"))).collect()]
    assert {x["minutes"] for x in lines} == {79, 180}


def test_stream_merges_into_seasons(spark, tmp_path):
    schema = "dedupe_key string, seq long, date string, status string, location_type string, home_score int"
    inbox, store = str(tmp_path / "in"), str(tmp_path / "store")
    steps = [[("a", 1, "2024-09-01", "scheduled", "unknown", None), ("b", 2, "2025-09-01", "scheduled", "home", None)], [("a", 3, "2024-09-01", "final", "home", 2), ("c", 4, "2025-09-02", "final", "away", 1)], [("a", 5, "2024-09-01", "final", "away", 3)]]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        query = merge_stream(spark.readStream.schema(schema).parquet(inbox), store, str(tmp_path / "ck"))
        query.awaitTermination(120)
        assert query.exception() is None
    got = {r.dedupe_key: (r.season, r.status, r.location_type, r.home_score) for r in spark.read.parquet(store).collect()}
    assert {k: (str(v[0]), *v[1:]) for k, v in got.items()} == {"a": ("2024", "final", "home", 2), "b": ("2025", "scheduled", "home", None), "c": ("2025", "final", "away", 1)}


def test_inventory_and_aliases(spark, tmp_path):
    teams = [{"team_id": "X", "name_canonical": "X U", "schedule_url": "https://x.example", "platform_guess": "custom", "parser_key": "k"}] * 2 + [{"team_id": "Y", "schedule_url": "nope", "platform_guess": "odd"}]
    (tmp_path / "t.json").write_text(json.dumps(teams))
    (tmp_path / "a.json").write_text(json.dumps({"X": ["x one", "the x"]}))
    season.inventory(spark, str(tmp_path / "t.json"), str(tmp_path / "out"))
    errors = spark.read.parquet(str(tmp_path / "out")).groupBy("team_id").agg(F.max(F.size("errors")).alias("n")).collect()
    assert {(r.team_id, r.n) for r in errors} == {("X", 1), ("Y", 3)}
    assert {r.alias for r in tables.read_aliases(spark, str(tmp_path / "a.json")).collect()} == {"x one", "the x"}


def test_schedule_job_builds_a_store(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages/p.html").write_text('<h1>2025</h1><li class="sidearm-schedule-game"><div class="sidearm-schedule-game-opponent-date"><span>Aug 21</span></div><div class="sidearm-schedule-game-opponent-name">Yale</div></li>')
    for _ in range(2):
        season.schedules(spark, str(tmp_path / "pages"), str(tmp_path / "store"), "SMU")
    rows = tables.read_games(spark, str(tmp_path / "store"), "2025", "SMU").collect()
    assert [(r.dedupe_key, r.status) for r in rows] == [("2025-08-21-SMU-Yale", "scheduled")]
