"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from termloom.plans.oracle import ORACLE_SQL
from termloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def test_which_queries_have_no_sql():
    assert set(QUERIES) - set(ORACLE_SQL) == {"lbfgs_search"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(norm(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5) if all(isinstance(x, float) for x in g) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5) for x, y in zip(g, w, strict=True))


def test_quasi_newton_search_on_the_objective(spark, sf_dir):
    row = QUERIES["lbfgs_search"](spark, sf_dir).first()
    assert 0 <= row.start_score <= row.score <= 1 and all(0.1 <= row[x] <= 5 for x in ("alpha", "beta", "gamma")) and row.evaluations >= 7
