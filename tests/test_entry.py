"""The driver's contract."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_queries_match_sql(spark):
    import duckdb

    from tracewell.plans.queries import ORACLES, QUERIES

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SMALL}/{name}'")
    for name, f in QUERIES.items():
        df = f(spark, SMALL)
        got = sorted(str([r[c] for c in sorted(df.columns)]) for r in df.collect())
        if name in ORACLES:
            r = con.execute(ORACLES[name])
            names = [d[0] for d in r.description]
            order = [names.index(c) for c in sorted(df.columns)]
            assert got == sorted(str([row[i] for i in order]) for row in r.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
