"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from verify import TABLES, compare

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def connection():
    link = duckdb.connect()
    for table in TABLES:
        link.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return link


def test_every_query_has_sql():
    assert set(entry._ORACLES) == set(entry._QUERIES)


@pytest.mark.parametrize("name", sorted(entry._QUERIES))
def test_query_equals_sql(spark, connection, name):
    ok, rows, _, _, detail = compare(spark, connection, FOLDER, name)
    assert ok, detail


def test_entry(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["query_id", "item_id", "item_type", "score", "rank"] and frame.count() == 800
