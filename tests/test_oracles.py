"""Every registered market query against its SQL in DuckDB, row for row."""

from pathlib import Path

import duckdb
import pytest

from tickerloom.plans import queries as Q


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(None if r[i] is None else f"{r[i]:.8g}" if isinstance(r[i], float) else r[i] for i in order)) for r in data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf_dir, duck, name):
    from tickerloom.plans.oracles import ORACLES

    got = Q.QUERIES[name](spark, sf_dir)
    data = [tuple(r) for r in got.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == sorted(got.columns)
        assert rows(got.columns, data) == rows(want.columns, want.fetchall())
    else:
        assert data


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 5
    assert set(e.oracle_sql()) <= set(e.queries())
