"""That page queries do their work once and in bounded memory: plain markup, slices of pages, bases, filters and the fold."""

import gc
import json
import random
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tallyfield.operators.linked import fold_linked
from tallyfield.parsers import dom, pages, registry, schedule

SCHEMA = "page_id string, body string, team_name string, source_url string, default_year int"
CARD = '<div class="s-game-card"><p class="s-text-paragraph-bold">Yale</p><span class="s-stamp__text">at</span><a href="/boxscore/1">Box</a></div>'
#: Pieces of markup, many of them broken.
PIECES = ['<div class="a b">', "<DIV Class='c'>", "</div>", "</Div >", "<p>", "</p>", "<br>", "<br/>", '<img alt="x" />', "<p/>", "text", " a &amp; b ", "a & b", "&nbsp;", "<", ">", "< b", "</", "<!-- c -->", "<!-- a-b -->", "<!DOCTYPE html>", "<!x>", "<?pi?>"]
PIECES += ['<a href="/x?a=1&b=2">', '<a href="/y" href="/z">', "<a href=/q data-x>", '<i title="<b>">', "</a>", "<script>", '<script type="x">{"a": 1}</script>', "<script>if (a<b) {}</script>", "</script>", "<style>x</style>", "<SCRIPT>1</SCRIPT>", "<script/>", "<title>a<b</title>", "<textarea><p></textarea>", "<td\x0bx>", "<td\xa0class=\"a\">", "<a\nclass=\"d\"\t>", "<h1>2024", "\x00", "<x:y>", "<table><tr><td>1</table>"]


def tree(node):
    out, data = [], []
    for child in node.children:  # text may come in pieces
        if isinstance(child, str):
            data.append(child)
            continue
        out += ["".join(data), (child.tag, child.attrs, tree(child))]
        data = []
    return [*out, "".join(data)]


def by_parser(html):
    builder = dom._Builder()
    builder.plain = lambda html: 0
    builder.feed(html)
    unread = builder.rawdata if builder.cdata_elem else ""
    builder.close()
    if unread:
        builder.handle_data(unread)
    return builder.root


def walked(node):
    return [n for c in node.children if isinstance(c, dom.Node) for n in (c, *walked(c))]


def test_plain_markup_is_read_as_the_parser_reads_it():
    rng = random.Random(5)
    for _ in range(4000):
        html = "".join(rng.choices(PIECES, k=rng.randint(0, 14)))
        root = dom.parse(html)
        assert tree(root) == tree(by_parser(html)), html
        for node in [root, *walked(root)]:  # numbers and indexes against a walk
            below = walked(node)
            assert node.all() == below and node.text() == "".join(x if isinstance(x, str) else x.text() for x in node.children)
            assert node.all("p", "td", "a") == [n for n in below if n.tag in ("p", "td", "a")]
            assert node.all(cls="a") == [n for n in below if "a" in n.attrs.get("class", "").split()]
            assert node.all("div", cls="b") == [n for n in below if n.tag == "div" and "b" in n.attrs.get("class", "").split()]
    page = "<!doctype html><ul>" + CARD * 3 + '<script type="x">{"a": 1}</script></ul>'
    assert dom._Builder().plain(page) == len(page)  # nothing of a plain page is left to the slow parser


def test_a_reader_hands_on_few_pages():
    made = [None, "", "<p>", *(CARD * (i % 3) for i in range(997))]
    taken = []

    def batches():
        for at in (0, 500):
            taken.append(at)
            yield pa.array(made[at : at + 500])

    found = schedule._read_html(batches())
    first = next(found)
    assert taken == [0] and 0 < len(first) <= schedule.PAGES_AT_ONCE < 500
    got = [x for part in (first, *found) for x in part.to_pylist()]
    names = ["layout", "position", *pages.GAME]
    want = [pages.read_schedule(x) for x in made]
    assert got == [{"year": y, "canonical": c, "error": e, "cells": [dict(zip(names, g, strict=True)) for g in games]} for y, c, e, games in want]


def test_a_reader_holds_no_more_for_more_long_pages():
    page = '<div class="c-scoreboard__item"><img alt="Yale"><span>2025-09-01</span></div>' * 2000

    def peak(count):
        bodies = pa.array([None, *[page] * count])
        tracemalloc.start()
        sizes = [len(part) for part in schedule._read_html(iter([bodies, bodies[:0]]))]
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == count + 1 and (max(sizes) - 1) * len(page) <= schedule.BYTES_AT_ONCE
        return most

    peak(1)
    assert peak(30) < 1.5 * peak(5)


def test_a_page_is_freed_once_read():
    html, count = CARD * 50, lambda: sum(isinstance(x, dom.Node) for x in gc.get_objects())
    gc.collect()
    before = count()
    gc.disable()
    try:
        assert len(pages.read_schedule(html)[3]) == 50
        assert count() <= before
    finally:
        gc.enable()


def plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_a_platform_page_is_read_once(spark):
    game = lambda i, url, box: {"id": i, "date": "2025-09-01T10:00:00Z", "type": "g", "opponent": {"name": f"Club {i}"}, "result": {"boxscore": box}, "schedule": url and {"url": url}}
    urls = [None, "no link", "https://A.example:443/x", "https://b.example/y", None]
    whole, none = [json.dumps([game(i, u, "/b") for i, u in enumerate(x)]) for x in (urls, [None, "x"])]
    raw = spark.createDataFrame([("p", whole, "Vale", "", 2025), ("q", none, "Vale", "", 2025)], SCHEMA)
    games = schedule.games_of(schedule.read_pages(raw))
    got = {p: [r.boxscore_url for r in sorted(games.collect(), key=lambda r: r.position) if r.page_id == p] for p in "pq"}
    assert got == {"p": ["/b", "/b"] + ["https://a.example/b"] * 3, "q": ["/b", "/b"]}
    assert not any("slice(" in x for x in plan(games))  # no list of links for each game
    assert not any("Filter" in x and "from_json" in x for x in plan(games))  # no second reading


def test_a_filter_does_not_work_out_names_again(spark):
    games = schedule.games_of(schedule.read_pages(spark.createDataFrame([], SCHEMA)))
    filters = [x for x in plan(games) if "Filter" in x and "unknown opponent" in x]
    assert len(filters) == 1 and "_opponent" in filters[0] and "lower(" not in filters[0]


def test_a_filter_on_outcomes_does_not_read_pages_again(spark):
    game = lambda i: {"id": i, "date": "2025-09-01T10:00:00Z", "type": "g", "opponent": {"name": f"Club {i}"}, "schedule": {"url": "https://a.example/x"}}
    bodies = {"array": json.dumps([game(i) for i in range(3)]), "spoiled": json.dumps([game(1), {"id": 2}]), "cards": CARD * 2, "none": "<p>none", "null": None, "deep": '<script type="application/ld+json">' + "[" * 100_000 + "</script>"}
    raw = spark.createDataFrame([(k, body, "Vale", "", 2025) for k, body in bodies.items()], SCHEMA)
    known = registry.Registry()
    read = registry.read_routed(raw.withColumn("route", F.when(F.col("page_id") != "null", "sidearm")), known)
    for found, of_null in ((schedule.outcomes(schedule.read_pages(raw)), "no games"), (registry.outcomes(read), "no parser")):
        said = {r.page_id: (r.games, r.outcome.split(":")[0]) for r in found.collect()}
        assert said == {"array": (3, "ok"), "spoiled": (0, "no games"), "cards": (2, "ok"), "none": (0, "no games"), "null": (0, of_null), "deep": (0, "error")}
        bad = found.where("outcome <> 'ok'")
        assert {r.page_id for r in bad.collect()} == {"spoiled", "none", "null", "deep"}
        assert not any("Filter" in x and ("from_json" in x or "transform" in x) for x in plan(bad))


def test_names_are_taken_apart_only_on_pages_with_events(spark):
    games = schedule.games_of(schedule.read_pages(spark.createDataFrame([], SCHEMA)))
    shown = games.select("page_id", F.struct("position").alias("place"), F.struct(*schedule.GAME_COLUMNS).alias("game"))
    lists = [x for x in plan(fold_linked(shown)) if "collect_list" in x]
    assert lists and not any("initials" in x for x in lists)


def test_a_number_that_is_none_costs_no_exception(spark):
    from tallyfield.functions import numbers

    rows = spark.createDataFrame([("",), ("x",), (None,), (" 12a",), ("-3",), ("9" * 30,)], "t string").select(numbers.parse_int(F.col("t")).alias("n"))
    assert [r.n for r in rows.collect()] == [None, None, None, 12, -3, None]
    assert "nullif" in plan(rows)[0].lower() or "null else" in plan(rows)[0] or "_common_expr" in plan(rows)[0]
