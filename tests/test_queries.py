"""Registered queries against their SQL; all of them with CREDITWEIR_ALL=1."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "silver_clean", "borrower_history", "segment_default_rates", "fact_upsert", "credit_features", "psi_by_split",
    "service_metrics", "decile_lift", "rejected_requests", "reason_codes", "report_audit", "bronze_from_csv",
    "stream_volume",
]
CHOSEN = list(oracle_sql()) if os.environ.get("CREDITWEIR_ALL") else QUICK


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("the given tables are not here")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return connection


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark, db):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, db, name):
    df = queries()[name](spark, FOLDER)
    cursor = db.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())
