"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from joulecorpus.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def by_value(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = [columns.index(name) for name in sorted(columns)]
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(queries()) & set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    found = by_value(df.columns, [tuple(row) for row in df.collect()])
    cursor = duck.execute(oracle_sql()[name])
    columns = [part[0] for part in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert found == by_value(columns, cursor.fetchall())


def test_entry(spark):
    assert {row["split"] for row in entry(spark).collect()} == {"train", "validation", "test"}
