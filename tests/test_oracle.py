"""Each query of the engine's operators against its DuckDB counterpart."""

import datetime
import decimal
import math

import duckdb
import pytest

from brindle import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


def test_every_statement_has_both_sides():
    assert set(Q.queries()) >= set(Q.oracle_sql())


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_is_its_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    c = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in c.description]
    assert sorted(n.lower() for n in got.columns) == sorted(n.lower() for n in names)
    low = {n.lower(): i for i, n in enumerate(names)}
    order = [low[n.lower()] for n in got.columns]
    want = sorted((tuple(plain(r[i]) for i in order) for r in c.fetchall()), key=repr)
    have = sorted((tuple(map(plain, r)) for r in got.collect()), key=repr)
    assert have == want
