"""Every query with an SQL counterpart gives the same rows as DuckDB."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from skuflow.functions import fixed_values as fv
from tests.conftest import SMALL

_path = Path(__file__).resolve().parent.parent / "scripts" / "check_queries.py"
_spec = importlib.util.spec_from_file_location("check_queries", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_same_rows_as_sql(spark, database, name):
    df = contract.queries()[name](spark, SMALL)
    result = database.execute(contract.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(df.columns) == sorted(names)
    assert check.rows_of(df.columns, df.collect()) == check.rows_of(names, result.fetchall())


def test_entry(spark):
    board = contract.entry(spark)
    assert board.count() > 0
    severities = [row.severity for row in board.collect()]
    assert severities == sorted(severities, key=fv.SEVERITY_ORDER.index)


def test_alert_total_is_the_sum_of_its_parts(spark):
    counts = contract.queries()["alert_counts"](spark, SMALL).first()
    assert counts.total_alerts == counts.reorder_alerts + counts.anomaly_alerts > 0
