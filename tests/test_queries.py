"""Queries against their SQL on the driver's small tables."""

import os

import pytest

import __spark_entry__ as entry_point
from viaflux.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    return sorted(tuple(str(cell(r[i])) for i in order) for r in rows), sorted(columns)


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_query(spark, duck, name):
    df = core.QUERIES[name](spark, SF)
    ours = plain([tuple(r) for r in df.collect()], df.columns)
    out = duck.execute(core.ORACLES[name])
    columns = [d[0] for d in out.description]
    assert ours == plain(out.fetchall(), columns)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
