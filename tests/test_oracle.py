"""Every query with a DuckDB statement, compared on the smallest sample."""

import duckdb
import pytest

import check_oracle
import oracle
from skuloom.registry import all_queries
from skuloom.sources.sample_views import TABLES

SF = "/root/testdata/sf0.001"
STATEMENTS = oracle.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_statements_belong_to_queries():
    assert set(STATEMENTS) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_query(spark, duck, name):
    df = all_queries()[name](spark, SF)
    cur = duck.execute(STATEMENTS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert check_oracle.normal(df.collect(), df.columns) == check_oracle.normal(cur.fetchall(), names)
