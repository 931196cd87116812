"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math

import duckdb
import pytest

from corpuslab.registry import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    r = duck.sql(ORACLES[name])
    want = rows(r.columns, r.fetchall())
    assert sorted(df.columns) == sorted(r.columns)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-6)) for x, y in zip(a, b)), (a, b)
