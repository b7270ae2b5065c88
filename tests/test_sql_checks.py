"""Every query with a SQL form gives the same rows as DuckDB on the smallest tables; the others run."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracle import canonical
from cropseries.workload.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_as_sql(spark, db, name):
    ours = contract.queries()[name](spark, SF).toArrow().to_pandas(date_as_object=True)
    theirs = db.sql(contract.oracle_sql()[name]).to_arrow_table().to_pandas(date_as_object=True)
    assert canonical(ours) == canonical(theirs)


@pytest.mark.parametrize("name", sorted(set(contract.queries()) - set(contract.oracle_sql())))
def test_runs(spark, name):
    result = contract.queries()[name](spark, SF).toArrow()
    assert result.num_rows > 0 and len(set(result.column_names)) == len(result.column_names)


def test_entry(spark):
    assert contract.entry(spark).limit(1).count() == 1
