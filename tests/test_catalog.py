"""Every catalog query against its DuckDB equivalent, and the fold against a sequential model."""

import duckdb
import pytest

from tallyfield.plans import catalog
from tallyfield.plans.analogues import games

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
    assert rows or name in ("player_page", "team_set_equality")  # empty at this size


def test_links_are_zipped_to_every_position(spark, tmp_path):
    page = "".join(f'<a href="/l{k}">x</a>' for k in range(28))
    spark.createDataFrame([(1, "https://a.example/s", page), (2, "https://a.example/t", "<p>")], "page_id int, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(k,) for k in range(30)], "n_nationkey int").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("pages", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.sql(catalog.ORACLES["zip_positions"])
    got = catalog.QUERIES["zip_positions"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert got.where("link <> '/none'").count() == 28


def test_greedy_matches_sequential_model(spark):
    kept, seen = set(), set()
    for g in sorted(games(spark, SF).select("seq", "date", "home", "away").collect()):
        if not {(g.date, g.home), (g.date, g.away)} & seen:
            kept.add(g.seq)
            seen |= {(g.date, g.home), (g.date, g.away)}
    assert {r.seq for r in catalog.greedy_team_date(spark, SF).collect()} == kept
