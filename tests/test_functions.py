"""Scalar functions: fixed cases, and numbers against a small model."""

import pytest
from pyspark.sql import functions as F

from tallyfield.functions import dates, numbers, status, text, urls

L = F.lit


def cases():
    base = L("https://h.example/s/a")
    return [
        (text.clean_team_name(L("No. 7 Velmora")), "Velmora"),
        (text.clean_team_name(L("Port Aster  Port Aster")), "Port Aster"),
        (text.clean_team_name(L("Harrow * *")), "Harrow"),
        (text.is_ranked(L("#5 Duke")), True),
        *((f(L(x)), y) for x in ("No 7 Velmora", "# 5 Velmora", "no.12 Velmora", "#5  Velmora") for f, y in ((text.is_ranked, True), (text.clean_team_name, "Velmora"))),
        (text.is_ranked(L("No 7")), False),
        (text.initials(L("Harbor-Vale St. Ann's")), "hvstanns"),
        (text.is_ranked(L("Duke")), False),
        (text.clean_player_name(L("#12 Ann  Lee ")), "Ann Lee"),
        (text.dedupe_key(L("2025-08-24"), L("UNC"), L("NC State")), "2025-08-24-NC-State-UNC"),
        (text.encoded_key(L("a:b")), "YTpi"),
        (text.player_key(L("SMU"), L("Núñez, Orla")), "smu:nezorla"),
        (text.team_before_dash(L("Team A - Box")), "Team A"),
        (text.team_before_dash(L(" - Box")), "Unknown"),
        (text.names_likely_match(L("Virginia"), L("Virginia Tech")), True),
        (text.names_likely_match(L("NC State"), L("North Carolina State")), True),
        (text.names_likely_match(L("Duke"), L("UNC")), False),
        (text.same_teams(L("A b"), L("C"), L("c"), L("a-B")), True),
        (dates.parse_date(L("Aug 21 (Thu)"), L(2025)), "2025-08-21"),
        (dates.parse_date(L("8/9"), L(2025)), "2025-08-09"),
        (dates.parse_date(L("8/9/24"), L(2025)), "2024-08-09"),
        (dates.parse_date(L("Thu, Aug 21, 2024"), L(2025)), "2024-08-21"),
        (dates.parse_date(L("August 16, 2025"), L(2024)), "2025-08-16"),
        (dates.parse_date(L("13/45"), L(2025)), "2025-13-45"),
        (dates.parse_date(L(""), L(2025)), "2025-01-01"),
        (dates.utc_date(L("2025-08-24T22:00:00-05:00")), "2025-08-25"),
        (dates.season(L(None).cast("string")), "unknown"),
        (numbers.minutes(L("79:30")), 79.5),
        (numbers.minutes(L("45")), 45.0),
        (numbers.minutes(L("DNP")), 0.0),
        (numbers.minutes(L(None).cast("string")), 0.0),
        (numbers.int_or_zero(L("79.5")), 79),
        (numbers.int_or_zero(L(" -3x")), -3),
        (numbers.parse_int(L("x")), None),
        (numbers.to_number(L("")), 0.0),
        (numbers.to_number(L("abc")), None),
        (numbers.per_90(L(2), L(0)), 180.0),
        (numbers.conversion(L(1), L(0)), 0.0),
        (numbers.fixed(L(1.005), 2), "1.00"),
        (numbers.fixed(L(0.125), 2), "0.13"),
        (numbers.duration(L(3723999)), "01:02:03"),
        (urls.origin(L("HTTPS://H.example:443/x")), "https://h.example"),
        (urls.origin(L("http://h.example:81?x")), "http://h.example:81"),
        (urls.origin(L("nope")), ""),
        (urls.resolve_box_url(L("/x/1"), base), "https://h.example/x/1"),
        (urls.resolve_box_url(L("//k.example/x"), base), "https://k.example/x"),
        (urls.resolve_box_url(L("x/1"), base), "https://h.example/x/1"),
        (urls.resolve_box_url(L(""), base), None),
        (urls.page_game_id(L("https://h.example/boxscore/26235?x"), "g"), "g-26235"),
        (urls.page_game_id(L("https://test.com"), "g"), "unknown"),
        (status.status_of_code(L("P"), L(None).cast("string")), "postponed"),
        (status.status_of_text(L("W, 2-1")), "final"),
        (status.scores(L("W 2-1"), L(False))["away"], 2),
        (status.location(L("N")), "neutral"),
    ]


def test_fixed_cases(spark):
    known = cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(known)]).head()
    for i, (_, want) in enumerate(known):
        assert row[i] == pytest.approx(want) if isinstance(want, float) else row[i] == want, (i, known[i][1], row[i])
