"""Every registered query against its DuckDB SQL, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tools.check_oracle import compare

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf, duck, name):
    got = contract.queries()[name](spark, sf).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) == "ok"


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(SQL)))
def test_query_has_rows(spark, sf, name):
    assert contract.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    assert "suggestion" in contract.entry(spark).columns
