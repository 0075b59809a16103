"""Catalog queries against their DuckDB oracle (as the driver compares them)."""

import duckdb
import pytest

import __spark_entry__ as entry
from cellgrad.plans import catalog, oracle_catalog
from conftest import SF001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KEYS = sorted(catalog.QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def _norm(rows):
    rows = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(rows, key=lambda r: tuple((v is None, v if v is not None else 0) for v in r))


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(oracle_catalog.ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    df = entry.queries()[key](spark, SF001)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[key])
    assert sorted(rel.columns) == cols
    idx = [rel.columns.index(c) for c in cols]
    want = [tuple(r[k] for k in idx) for r in rel.fetchall()]
    assert _norm(got) == _norm(want)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["iter", "precision"]
    assert df.count() >= 0
