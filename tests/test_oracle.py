"""Every query of the catalogue that has SQL gives the rows that DuckDB gives."""

import math
from pathlib import Path

import duckdb
import pytest

from millrace.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    found = catalogue.queries()[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=repr)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert rows == expected
