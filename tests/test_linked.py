"""Linked data merged into a page's games, against a sequential model with changing keys; names that likely match."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import text
from tallyfield.parsers import schedule


def alnum(x):
    return re.sub("[^a-z0-9]", "", x.lower())


def initials(x):
    return "".join(p.lower() if len(p) <= 3 else p[0].lower() for p in re.split("[^A-Za-z0-9]+", x) if p)


def likely(a, b):
    x, y = alnum(a), alnum(b)
    return bool(x and y) and (x in y or y in x or initials(a) == initials(b))


def key_of(g):
    return "-".join([g["date"], *(t.replace(" ", "-") for t in sorted((g["home"], g["away"])))])


def model(team, games, events):
    """Games by key in order of insertion, as a page's reader keeps them."""
    found = {}
    for g in games:
        found[key_of(g)] = dict(g)
    for e in events:
        if e["title"]:
            left, word, right = e["title"]
            right_only = likely(right, team) and not likely(left, team)
            home = (word == "at") if right_only else (word == "vs")
            other = left if right_only else right
        else:
            other, home = e["away"], True
            if not (likely(e["home"], team) and e["away"]) and likely(e["away"], team) and e["home"]:
                other, home = e["home"], False
        new = {"date": e["date"], "home": team if home else other, "away": other if home else team, "scores": e["scores"], "side": "home" if home else "away", "status": "final" if e["scores"] else "scheduled"}
        new |= {"id": "game-" + "-".join([new["date"], new["home"].replace(" ", "-"), new["away"].replace(" ", "-")])}
        sets = lambda g: {g["home"].lower().replace(" ", "-"), g["away"].lower().replace(" ", "-")}
        for key, g in found.items():
            same_date = g["date"] == new["date"] or g["date"].endswith("-01-01")
            straight = likely(g["home"], new["home"]) and likely(g["away"], new["away"])
            swapped = likely(g["home"], new["away"]) and likely(g["away"], new["home"])
            if sets(g) == sets(new) or (straight or swapped) and same_date:
                break
        else:
            found[key_of(new)] = new
            continue
        if g["date"].endswith("-01-01"):
            g["date"] = new["date"]
            g["id"] = "game-" + "-".join([g["date"], g["home"].replace(" ", "-"), g["away"].replace(" ", "-")])
            if key != key_of(g):
                del found[key]
                found[key_of(g)] = g
        if g["side"] == "unknown":
            g["side"] = new["side"]
        if not g["scores"] and new["scores"]:
            g["scores"] = new["scores"]
        if g["status"] == "scheduled" and new["status"] == "final":
            g["status"] = "final"
    return {k: (g["date"], g["home"], g["away"], g["scores"], g["side"], g["status"], g["id"]) for k, g in found.items()}


NAMES = ["North Vale", "North", "N V", "NV", "Port-Aster", "Port Aster", "port aster", "Saint_Rook", "St. Rook", "Rook", "Harrow", "Elm 7"]


def page(rng, team):
    days = ["2025-09-01", "2025-09-02", "2025-09-03"]
    games, events, rows = [], [], []
    for _ in range(rng.randint(0, 6)):
        other, side = rng.choice(NAMES), rng.choice(["home", "away", "unknown"])
        date, scores = rng.choice([*days, "2025-01-01", "2025-01-01"]), rng.choice([None, None, (rng.randint(0, 4), rng.randint(0, 4))])
        word = {"home": "vs ", "away": "at ", "unknown": ""}[side]
        rows.append(f"<tr><td>{'TBA' if date.endswith('01-01') else date}</td><td></td><td>{word}{other}</td><td>{'%d-%d' % scores if scores else ''}</td></tr>")
        home, away = (other, team) if side == "away" else (team, other)
        g = {"date": date, "home": home, "away": away, "scores": scores and (scores[::-1] if side == "away" else scores), "side": side, "status": "final" if scores else "scheduled"}
        games.append(g | {"id": "game-" + "-".join([date, home.replace(" ", "-"), away.replace(" ", "-")])})
    said = []
    for _ in range(rng.randint(0, 6)):
        other, title = rng.choice(NAMES), None
        home, away = rng.choice([(team, other), (other, team), (other, rng.choice(NAMES))])
        if rng.random() < 0.5:
            title = (home, rng.choice(["vs", "at"]), away)
        scores = rng.choice([None, (rng.randint(0, 4), rng.randint(0, 4))])
        e = {"date": rng.choice(days), "title": title, "home": home, "away": away, "scores": scores}
        events.append(e)
        said.append({"@type": "SportsEvent", "startDate": e["date"] + "T19:00", "name": " ".join(title) if title else "Match", "homeTeam": {"name": home} | ({"score": str(scores[0])} if scores else {}), "awayTeam": {"name": away} | ({"homeScore": 9, "awayScore": scores[1]} if scores else {})})
    body = f'<table><thead><tr><th>Date</th><th>Time</th><th>Opponent</th><th>Result</th></tr></thead>{"".join(rows)}</table><script type="application/ld+json">{json.dumps(said)}</script>'
    return body, model(team, games, events)


def test_fold_matches_a_sequential_model(spark):
    rng = random.Random(8)
    made = [page(rng, "Team One") for _ in range(400)]
    raw = spark.createDataFrame([(i, b, "Team One", "https://h.example", 2025) for i, (b, _) in enumerate(made)], "page_id int, body string, team_name string, source_url string, default_year int")
    got = [{} for _ in made]
    for r in schedule.parse_schedules(raw).collect():
        scores = None if r.home_score is None else (r.home_score, r.away_score)
        assert r.dedupe_key not in got[r.page_id]
        got[r.page_id][r.dedupe_key] = (r.date, r.home_team_name, r.away_team_name, scores, r.location_type, r.status, r.game_id)
    for i, (body, want) in enumerate(made):
        assert got[i] == want, body
    assert sum(len(w) for _, w in made) > 1000


@pytest.mark.parametrize(("a", "b"), [("Saint_Rook", "S R"), ("NATION_1", "N 1"), ("NATION_1", "NATION_2"), ("St. Ann's", "St Ann s"), ("North-Vale", "N.V."), ("", "x"), ("--", "x"), ("Elm", "elmwood")])
def test_likely_names(spark, a, b):
    row = spark.range(1).select(text.names_likely_match(F.lit(a), F.lit(b)).alias("m"), text.initials(F.lit(a)).alias("i")).head()
    assert row.m == likely(a, b) and row.i == initials(a)
