"""Registered queries against DuckDB on the smallest tables."""

from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from strandloom.plans import chains, more  # noqa: F401  register their queries
from strandloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    return round(float(v), 6) if isinstance(v, (float, Decimal)) else v


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(SQL) > 70


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, SF)
    rel = con.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    at = [rel.columns.index(c) for c in cols]
    assert got == Counter(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
