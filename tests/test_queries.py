"""Every library query against its DuckDB counterpart; those without one against their own claims."""

import os

import duckdb
import pytest

from turnback import catalog


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def canon(rows):
    return sorted(tuple(repr(v + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = df.select(*(f"`{c}`" for c in cols)).collect()
    if name in catalog.ORACLES:
        want = db.sql(catalog.ORACLES[name])
        assert sorted(want.columns) == cols
        at = [want.columns.index(c) for c in cols]
        assert canon(got) == canon([[r[i] for i in at] for r in want.fetchall()])
    else:
        assert got and all(r["same"] for r in got if "same" in cols)


def test_entry_offers_everything(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
