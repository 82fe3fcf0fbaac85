"""Payload slices, box-score links, opponents of tables, platform arrays, pages that fail, and their routing."""

import json

import pytest
from pyspark.sql import functions as F

from tallyfield.parsers import box, pages, registry, schedule
from tallyfield.parsers.dom import parse

SCHEMA = "page_id string, body string, team_name string, source_url string, default_year int"


def payload_list(shift=0, title="Yale", box_link="/b/1", links=None, status=None):
    """The flat list of a payload; ``shift``: items that come before it."""
    at = lambda n: n + shift
    game = {"date": at(6), "opponent": at(7), "location_indicator": at(8), "result": at(9), "status": at(13), "game_links": at(14)}
    return [{"schedule": at(1), "note": at(15)}, {"schedules": at(2)}, {"any": at(3)}, {"games": at(4)}, [at(5)], game, "2025-09-09T00:00", {"title": at(10)}, "A", {"team_score": at(11), "opponent_score": at(12), "boxscore": at(16)}, title, None if status else "4", None if status else "2", status, links, 'a "quoted" ]] \\ text [[', box_link]


def brief(rows):
    return [(r.date, r.home_team_name, r.away_team_name, r.home_score, r.away_score, r.status, r.boxscore_url) for r in rows]


def parsed(spark, bodies, source="https://h.example/s"):
    raw = spark.createDataFrame([(str(i), b, "Vale", source, 2025) for i, b in enumerate(bodies)], SCHEMA)
    return [brief([r for r in rows if r.page_id == str(i)]) for rows in [schedule.parse_schedules(raw).orderBy("position").collect()] for i in range(len(bodies))]


def test_payload_slices(spark):
    plain = f'<script type="x" id="__NUXT_DATA__">{json.dumps(payload_list())}</script>'
    mark = [["ShallowReactive", 1]]
    sliced = json.dumps([*mark, *payload_list(1)])
    nested = json.dumps([*mark, *payload_list(1), [[[1], ["]"]], {"a": [[]]}]])
    script = lambda body: f'<script>var q = {{"schedule":1}}; window.x = {body}; var y = "]]";</script>'
    cut_off = script(sliced)[: -len("; var y = \"]]\";</script>") - 1]
    two = script('[["ShallowReactive",{"x":[]}], {"a": "]"}]; window.y = ' + sliced)
    other = f'<script id="__NUXT_DATA__">{{"no": "list"}}</script>{script(nested)}'
    bad = script('[["ShallowReactive",1], {schedule: 2}]')
    got = parsed(spark, [plain, script(sliced), script(nested), cut_off, two, other, bad, "<script>[[" + "[" * 5000])
    game = [("2025-09-09", "Yale", "Vale", 2, 4, "final", "https://h.example/b/1")]
    assert got == [game] * 6 + [[], []]


@pytest.mark.parametrize(
    ("link", "want"),
    [("/b", "/b"), (17, "17"), (["x", "/b"], "x"), ([{"url": "/u"}], "/u"), ([{"href": "/u"}, 5], ""), ({"href": "/h", "link": "/l"}, "/h"), ({"link": "/l"}, "/l"), ({"url": 5}, ""), (None, ""), (True, ""), ([], "")],
)
def test_links_of_any_shape(link, want):
    assert pages.link_of(link) == want


def test_payload_details(spark):
    page = lambda **x: f'<script id="__NUXT_DATA__">{json.dumps(payload_list(**x))}</script>'
    links = [{"title": "Recap", "url": "/r"}, {"title": "Box Score (PDF)", "url": "/c"}]
    got = parsed(spark, [page(box_link=None, links=links), page(status="Postponed - rain"), page(box_link="x", status="canceled"), page(title=None)])
    assert [g[0][5:] for g in got] == [("final", "https://h.example/c"), ("postponed", "https://h.example/b/1"), ("canceled", "https://h.example/x"), ("final", "https://h.example/b/1")]
    assert got[3][0][1] == "Unknown Opponent"


def row_of(cell="Yale", rest=""):
    return parse(f"<table><tr><td>9/1</td><td>7 PM</td><td>{cell}</td><td>W 1-0</td>{rest}</tr></table>").first("tr")


@pytest.mark.parametrize(
    ("rest", "want"),
    [
        ('<td><a href="/r">Recap</a><a href="/x">Box Score</a><a href="/boxscore/1">s</a></td>', "/x"),
        ('<td><a href="/a">Inbox</a><a href="/y"> BOX </a></td>', "/y"),
        ('<td><a href="/a">Live</a></td><td><a href="/Stats/4">s</a><a href="/boxscore/5">t</a></td>', "/Stats/4"),
        ('<td><button href="/z/BoxScore/6">b</button></td>', "/z/BoxScore/6"),
        ('<td><script>{"Boxscore" : "/j/7"}</script></td>', "/j/7"),
        ('<td><a href="/recap">Recap</a></td>', ""),
        ("", ""),
    ],
)
def test_box_links_of_table_rows(rest, want):
    assert pages.table_box_link(row_of(rest=rest)) == want


def test_opponents_of_tables(spark):
    head = "<table><thead><tr><th>Date</th><th>Opponent</th><th>Result</th></tr></thead>"
    name = '<span class="schedule-event-item-team__opponent-name">Yale<b>x</b> Blue</span>'
    cells = [
        f'<i class="schedule-event-item-team__divider--desktop">at</i>{name}',
        '<i class="schedule-event-item-team__promo-title">Kids day</i><i class="schedule-event-item-team__divider">vs</i> at Harrow',
        '<i class="schedule-default-team__divider">vs.</i><b class="schedule-default-team__opponent-name">Rook</b>',
        "Elm",
        "vs ",  # no name follows, so the word is one
    ]
    body = head + "".join(f"<tr><td>9/{i + 1}</td><td>{c}</td><td></td></tr>" for i, c in enumerate(cells)) + "</table>"
    raw = spark.createDataFrame([("p", body, "Vale", "", 2025)], SCHEMA)
    got = [(r.home_team_name, r.away_team_name, r.location_type) for r in schedule.parse_schedules(raw).orderBy("position").collect()]
    assert got == [("Yale Blue", "Vale", "away"), ("Harrow", "Vale", "away"), ("Vale", "Rook", "home"), ("Vale", "Elm", "unknown"), ("Vale", "vs", "unknown")]


def test_a_bad_element_spoils_a_platform_array(spark):
    good = {"id": 1, "date": "2025-09-01T10:00:00Z", "type": "g", "opponent": {"name": "Yale"}}
    bad = [{"date": "2025-09-02", "type": "g", "opponent": {"name": "x"}}, {"id": 2, "type": "g", "date": "2025-09-02"}, {"id": "n", "date": "2025-09-02", "type": "g", "opponent": {"name": "x"}}]
    got = parsed(spark, [json.dumps([good])] + [json.dumps([good, b]) for b in bad] + ["[]"])
    assert [len(g) for g in got] == [1, 0, 0, 0, 0]


def test_the_canonical_link_is_the_base(spark):
    head = '<link rel="canonical" href="https://canon.example/a/b">'
    row = '<table><thead><tr><th>Date</th><th>Opponent</th><th>R</th></tr></thead><tr><td>9/1</td><td>Yale</td><td><a href="boxscore/1">x</a></td></tr></table>'
    assert [g[0][-1] for source in ("", "https://h.example") for g in parsed(spark, [head + row, row], source)] == ["https://canon.example/boxscore/1", "boxscore/1", "https://h.example/boxscore/1", "https://h.example/boxscore/1"]


DEEP = '<script type="application/ld+json">' + "[" * 100_000 + "</script>"


def test_pages_that_fail_are_listed_with_the_reason(spark):
    raw = spark.createDataFrame([("a", DEEP, "Vale", "", 2025), ("b", "<p>none", "Vale", "", 2025), ("c", None, "Vale", "", 2025), ("d", json.dumps([{"id": 1, "date": "2025-09-01T10:00:00Z", "type": "g", "opponent": {"name": "Yale"}}]), "Vale", "", 2025)], SCHEMA)
    got = {r.page_id: (r.games, r.outcome.split(":")[0], "Recursion" in r.outcome) for r in schedule.outcomes(schedule.read_pages(raw)).collect()}
    assert got == {"a": (0, "error", True), "b": (0, "no games", False), "c": (0, "no games", False), "d": (1, "ok", False)}
    games = spark.createDataFrame([("g1", "u1"), ("g2", "u2"), ("g3", "u3"), ("g4", "")], "game_id string, boxscore_url string")
    nobody = '<table class="advanced-table__table"><tr><td>F</td><td>9</td><td> </td><td>3</td><td>2</td><td>1</td><td>0</td><td>79:30</td></tr></table>'
    documents = spark.createDataFrame([("u1", 1, nobody), ("u2", 1, '<script id="__NUXT_DATA__">' + "[" * 100_000 + "</script>")], "url string, priority int, body string")
    best = box.best_pages(games, documents)
    assert {r.game_id: r.reason.split(":")[0] for r in box.missing_boxes(best).collect()} == {"g1": "no players", "g2": "error", "g3": "no page"}
    assert box.players_of(best).count() == 0


def test_registry(spark):
    known = registry.Registry()
    upper = registry.Parser(lambda raw: schedule.read_pages(raw.withColumn("body", F.regexp_replace("body", "Yale", "YALE"))), delegate="sidearm")
    known.register("upper", upper)
    known.register("circle", registry.Parser(schedule.read_pages, delegate="circle"))
    known.map_team("t2", "upper")
    assert known.boxes_of("upper") is known.boxes_of("sidearm") is box.read_boxes
    assert known.boxes_of("circle") is known.boxes_of("none") is None
    row = "<table><thead><tr><th>Date</th><th>Opponent</th></tr></thead><tr><td>9/1</td><td>Yale</td></tr></table>"
    raw = spark.createDataFrame([(f"p{i}", row, "Vale", "", 2025, t) for i, t in enumerate(["t1", "t2", "t3", "t4", "t5", None])], SCHEMA + ", team_id string")
    teams = spark.createDataFrame([("t1", "sidearm", "sidearm"), ("t2", "sidearm", "sidearm"), ("t3", "presto", "sidearm"), ("t4", "sidearm", None), ("t6", "sidearm", "sidearm")], "team_id string, platform_guess string, parser_key string")
    read = registry.read_routed(registry.routed(raw, teams, known), known)
    assert {r.page_id: (r.route, r.outcome) for r in registry.outcomes(read).collect()} == {"p0": ("sidearm", "ok"), "p1": ("upper", "ok"), **{f"p{i}": (None, "no parser") for i in (2, 3, 4, 5)}}
    assert {r.away_team_name for r in schedule.games_of(read).collect()} == {"Yale", "YALE"}
    known.default = "sidearm"
    assert registry.routed(raw, teams, known).where("page_id = 'p3'").head().route == "sidearm"
