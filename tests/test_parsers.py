"""Hand-written pages of each layout."""

import json

from pyspark.sql import functions as F

from tallyfield.parsers import box, schedule

CARD = """<div class="s-game-card"><div class="s-game-card__header__team"><span class="s-text-paragraph-bold">No. 7 Velmora</span></div>
<div data-test-id="s-game-card-standard__header-game-date-details"><span>Aug 10</span></div><span class="s-stamp__text">at</span>
<div class="c-scoreboard__scores">W 2-1</div><a href="/boxscore/11">Box Score</a></div>"""
ITEM = """<li class="sidearm-schedule-game sidearm-schedule-home-game"><div class="sidearm-schedule-game-opponent-date"><span>Aug 21 (Thu)</span></div>
<div class="sidearm-schedule-game-opponent-name">Port Aster</div><div class="sidearm-schedule-game-result">Postponed</div></li>"""
TABLE = """<table><thead><tr><th>Date</th><th>Opponent</th><th>Result</th></tr></thead><tbody><tr><td>9/1/25</td><td>at Harrow</td><td>L 0-3</td></tr></tbody></table>"""
BOARD = """<div class="c-scoreboard__item c-scoreboard__item--home"><div class="c-scoreboard__logo"><img alt="Pitt"></div><div class="c-scoreboard__date"><span>Oct 3</span></div></div>"""
LINKED = '<script type="application/ld+json">{"@graph": [{"@type": "SportsEvent", "startDate": "2025-11-02T19:00", "name": "SMU vs Cal"}]}</script><script type="application/ld+json">{bad</script>'
PAYLOAD = '<script id="__NUXT_DATA__">' + json.dumps([{"schedule": 1}, {"schedules": 2}, {"x": 3}, {"games": 4}, [5], {"date": 6, "opponent": 7, "location_indicator": 8, "result": 9}, "2025-09-09T00:00", {"name": 10}, "A", {"team_score": 11, "opponent_score": 12}, "Yale", "4", "2"]) + "</script>"
PLATFORM = json.dumps([{"id": 9, "date": "2025-08-24T22:00:00-05:00", "type": "g", "status": "O", "location_indicator": "A", "opponent": {"name": "#5 Duke"}, "result": {"status": "W", "team_score": "3", "opponent_score": "1", "boxscore": "/b/9"}, "schedule": {"url": "https://s.example/x"}}])
CLASSIC = """<table class="sidearm-table overall-stats"><caption>Velmora - Players</caption><tbody>
<tr><td>M</td><td>7</td><td>#7 Núñez, Orla</td><td>4</td><td>3</td><td>2</td><td>1</td><td>61:15</td></tr><tr><td>none</td></tr></tbody></table>
<table class="sidearm-table overall-stats"><caption>Harrow Bay - Players</caption><tbody>
<tr><td>G</td><td>31</td><td>Quist, Tamsin</td><td>0</td><td>0</td><td>0</td><td>0</td><td>90</td></tr></tbody></table>"""
ADVANCED = """<table class="advanced-table__table"><thead><tr><th>Alpha - Field</th></tr></thead><tbody><tr><td>F</td><td>9</td><td>Ann Lee</td><td>3</td><td>2</td><td>1</td><td>0</td><td>79:30</td></tr></tbody></table>
<table class="advanced-table__table"><thead><tr><th>Alpha - Goal</th></tr></thead><tbody><tr><td>GK</td><td>1</td><td>Kay Roe</td><td>90:00</td><td>0</td><td>4</td></tr></tbody></table>"""


def test_schedule_layouts(spark):
    bodies = ["<h1>2025 Schedule</h1>" + CARD + ITEM + TABLE + BOARD + LINKED, PAYLOAD, PLATFORM, None, "", "<p>none</p>", "[not json"]
    raw = spark.createDataFrame([(i, b, "SMU", "https://h.example/s", 2024) for i, b in enumerate(bodies)], "page_id int, body string, team_name string, source_url string, default_year int")
    got = {(r.page_id, r.layout): r for r in schedule.parse_schedules(raw).collect()}
    brief = {k: (r.date, r.home_team_name, r.away_team_name, r.home_score, r.away_score, r.location_type, r.status) for k, r in got.items()}
    assert brief == {
        (0, "cards"): ("2025-08-10", "Velmora", "SMU", 1, 2, "away", "final"),
        (0, "list"): ("2025-08-21", "SMU", "Port Aster", None, None, "home", "postponed"),
        (0, "table"): ("2025-09-01", "Harrow", "SMU", 3, 0, "away", "final"),
        (0, "scoreboard"): ("2025-10-03", "SMU", "Pitt", None, None, "home", "scheduled"),
        (0, "linked"): ("2025-11-02", "SMU", "Cal", None, None, "home", "scheduled"),
        (1, "payload"): ("2025-09-09", "Yale", "SMU", 2, 4, "away", "final"),
        (2, "platform"): ("2025-08-25", "Duke", "SMU", 1, 3, "away", "final"),
    }
    assert got[0, "cards"].boxscore_url == "https://h.example/boxscore/11" and got[0, "cards"].home_team_ranked
    assert got[2, "platform"].boxscore_url == "https://s.example/b/9" and got[2, "platform"].game_id == "game-9"


def row_of(*cells, attrs=""):
    return f"<tr {attrs}>" + "".join(c if c.startswith("<t") else f"<td>{c}</td>" for c in cells) + "</tr>"


HEADS = row_of("<th>Date</th>", "<th>Time</th>", "<th>Opponent</th>", "<th>Result</th>")
TABLES = {  # a page, and its games: date, home, away, scores, status
    "th for the date": (f"<table><thead>{HEADS}</thead><tbody>" + row_of("<th>Aug 21</th>", "7 PM", "at Harrow", "L 0-3") + "</tbody></table>", [("2025-08-21", "Harrow", "SMU", 3, 0, "final")]),
    "teams": ("<table><thead>" + HEADS.replace("Opponent", "Teams").replace("Result", "Time/Results") + "</thead>" + row_of("9/1", "7 PM", "vs Cal", "Postponed") + "</table>", [("2025-09-01", "SMU", "Cal", None, None, "postponed")]),
    "two columns": ("<table><thead><tr><th>Date</th><th>Opponent</th></tr></thead>" + row_of("9/2", "Yale") + "</table>", [("2025-09-02", "SMU", "Yale", None, None, "scheduled")]),
    "header row of td": ("<table>" + HEADS.replace("th>", "td>") + row_of("9/3", "7 PM", "Pitt", "W 2-1") + row_of("9/4", "8 PM", "Duke", "") + "</table>", [("2025-09-03", "SMU", "Pitt", 2, 1, "final"), ("2025-09-04", "SMU", "Duke", None, None, "scheduled")]),
    "header class": ("<table><tr class='my-header'><td>When</td><td>At</td><td>Opponent 1</td></tr>" + row_of("9/5", "Rome", "Ohio St") + "</table>", [("2025-09-05", "SMU", "Ohio St", None, None, "scheduled")]),
    "no header": ("<table>" + row_of("9/6", "7:00 PM", "at Louisville", "Cardinal Park", "T 1-1", "Recap") + row_of("9/7", "8:00 PM", "UCF", "Cal", "", "Canceled", "") + row_of("Skip Ad") + row_of("", "", "", "") + "</table>", [("2025-09-06", "Louisville", "SMU", 1, 1, "final"), ("2025-09-07", "SMU", "Cal", None, None, "canceled")]),
    "date attributes": (f"<table><thead>{HEADS}</thead>" + row_of('<td data-date="TBA">Fri</td>', "", "Navy", "", attrs='data-game-date="9/8/2025"') + row_of("<td data-datetime='2025-09-09T19:00'>Sat</td>", "", "Army", "") + "</table>", [("2025-09-08", "SMU", "Navy", None, None, "scheduled"), ("2025-09-09", "SMU", "Army", None, None, "scheduled")]),
    "ISO in HTML": (f"<table><thead>{HEADS}</thead>" + row_of("Sun", "<td><time datetime='2025-09-10T19:00'>7 PM</time></td>", "Rice", "") + "</table>", [("2025-09-10", "SMU", "Rice", None, None, "scheduled")]),
    "year in the date": (f"<table><thead>{HEADS}</thead>" + row_of("2024: Sep 11", "", "Iowa", "") + "</table>", [("2024-09-11", "SMU", "Iowa", None, None, "scheduled")]),
    "ISO date is no score": ("<table>" + row_of("2025-09-12", "Velmora", "TBA") + "</table>", [("2025-09-12", "SMU", "Velmora", None, None, "scheduled")]),
    "line score": ("<table><thead><tr><th>Team</th><th>Period</th><th>F</th></tr></thead>" + row_of("Harrow", "1 2 3", "2") + "</table>", []),
}


def test_tables_without_plain_headers(spark):
    raw = spark.createDataFrame([(k, b, "SMU", "", 2025) for k, (b, _) in TABLES.items()], "page_id string, body string, team_name string, source_url string, default_year int")
    rows = schedule.parse_schedules(raw).orderBy("position").collect()
    got = {k: [(r.date, r.home_team_name, r.away_team_name, r.home_score, r.away_score, r.status) for r in rows if r.page_id == k] for k in TABLES}
    assert got == {k: games for k, (_, games) in TABLES.items()}


def test_box_layouts(spark):
    players = [{"players": 1, "id": 2, "name": 3}, [4], "t1", "Beta", {"name": 5, "minutesPlayed": 6, "shots": 7, "uniform": 9}, "27 Bo Day", "88", {"goals": 8, "shots": 8}, "2", "27"]
    bodies = [CLASSIC, ADVANCED, f'<script id="__NUXT_DATA__">{json.dumps(players)}</script>', None, "<table></table>"]
    raw = spark.createDataFrame([(f"g{i}", b) for i, b in enumerate(bodies)], "game_id string, body string")
    got = {(r.game_id, r.player_key): (r.minutes, r.goals, r.shots, r.saves) for r in box.parse_boxes(raw).collect()}
    assert got == {
        ("g0", "velmora:nezorla"): (61.0, 2, 4, 0),
        ("g0", "harrowbay:quisttamsin"): (90.0, 0, 0, 0),
        ("g1", "alpha:annlee"): (79.5, 1, 3, 0),
        ("g1", "alpha:kayroe"): (90.0, 0, 0, 4),
        ("g2", "beta:boday"): (88.0, 2, 2, 0),
    }
    games = raw.limit(2).select("game_id", F.concat(F.lit("u"), "game_id").alias("boxscore_url"))
    docs = spark.createDataFrame([("ug0", 1, "<p>"), ("ug0", 2, CLASSIC), ("ug0", 3, CLASSIC), ("ug1", 1, ADVANCED)], "url string, priority int, body string")
    assert box.parse_games(games, docs).groupBy("game_id").count().orderBy("game_id").collect() == [("g0", 2), ("g1", 2)]
