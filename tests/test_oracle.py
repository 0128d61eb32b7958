"""Every registered query of the library beside its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from sparlattice import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    con.execute(SQL[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in place) for r in con.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_imports_without_the_llm_folders():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(SQL) <= set(e.oracle_sql())
