"""The queries with SQL, against DuckDB, on the small tables and on odd rows."""

import duckdb
import pytest

from cellgrad.llm.queries import ORACLE, QUERIES

from .conftest import ODD_TEXTS, SF001


def _norm(rows):
    return sorted(map(repr, rows))


def _connect(docs):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{docs}')")
    for t in ("pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SF001)
    rel = _connect(f"{SF001}/documents.parquet").sql(ORACLE[name])
    at = [rel.columns.index(c) for c in got.columns]
    assert sorted(rel.columns) == sorted(got.columns)
    assert _norm(tuple(r) for r in got.collect()) == _norm(tuple(r[k] for k in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", ["op2_license_scan", "op3_line_dedup", "op9_quality"])
def test_query_equals_its_sql_on_odd_rows(spark, tmp_path, name):
    # Without repeated or missing ids, which SQL over doc_id cannot tell apart.
    seen, rows = set(), []
    for i, t in ODD_TEXTS:
        if i is not None and i not in seen:
            seen.add(i)
            rows.append((i, t, "en", None if i % 4 == 0 else f"s{i % 2}", 0))
    rows += [(100 + k, f"Very common boilerplate line\nbody {k} " + " ".join(f"v{k}q{j}" for j in range(40)),
              "en", "hub", 0) for k in range(30)]
    rows += [(200, "Licensed under CC BY-NC 4.0.", "en", "hub", 0), (201, "mit license", "en", None, 0)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .coalesce(1).write.parquet(path)
    got = QUERIES[name](spark, str(tmp_path))
    rel = _connect(f"{path}/*.parquet").sql(ORACLE[name])
    at = [rel.columns.index(c) for c in got.columns]
    rows = [tuple(r) for r in got.collect()]
    assert _norm(rows) == _norm(tuple(r[k] for k in at) for r in rel.fetchall())
    if name == "op9_quality":
        cut = {r[got.columns.index("doc_id")]: r[got.columns.index("n_common_lines")] for r in rows}
        assert all(cut[100 + k] == 1 for k in range(30))
