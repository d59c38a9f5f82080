"""A few driver queries against their SQL twins; checks/compare.py runs all."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import TABLES, rows_of
from checks.oracle import oracle
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"
SAMPLE = ("a8_upsert", "b2_column_values", "c3_email_tokens", "c12_decode_response", "c13_arbitrate",
          "c16_scan_table", "c17_scan_all", "d6_partial_mask", "d11_secure_read", "e10_sla_check", "f1_gen_values")

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = queries()[name](spark, SF)
    cursor = con.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(oracle())


def test_entry(spark):
    assert entry(spark).count() == 1500
