"""Every registered query of the star schema against DuckDB at the smallest size."""

from __future__ import annotations

from datetime import date, datetime
from pathlib import Path

import duckdb
import pytest

from tidemark.plans import registry

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, datetime):
        v = v.date()
    if isinstance(v, date):
        return str(v)
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, str(DATA))
    want = duck.execute(registry.oracle_sql()[name])
    columns = sorted(got.columns)
    places = [[c[0] for c in want.description].index(c) for c in columns]
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    theirs = sorted(repr([plain(r[i]) for i in places]) for r in want.fetchall())
    assert mine == theirs
