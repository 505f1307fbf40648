"""Every query with SQL against DuckDB, at the smallest scale."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tallyframe.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(frame):
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else v.item() if hasattr(v, "item") else v
    return sorted((tuple(map(clean, r)) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, db, name):
    assert rows(QUERIES[name](spark, str(DATA)).toPandas()) == rows(db.execute(SQL[name]).df())


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
