"""Every registered query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from plyforge.catalog import registry

DATA = "/root/testdata/sf0.001"
KINDS = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}
QUERIES, SQL = registry.QUERIES, registry.SQL

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def shown(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return value if value is None else str(value)


def sorted_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(shown(row[i]) for i in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((v is None, v or "") for v in row))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DATA)
    rows = sorted_rows([tuple(row) for row in found.collect()], found.columns)
    result = duck.execute(SQL[name])
    columns = [column[0] for column in result.description]
    assert rows == sorted_rows(result.fetchall(), columns)
    kinds = {row[0]: row[1] for row in duck.execute("DESCRIBE " + SQL[name]).fetchall()}
    assert {column: KINDS[kind] for column, kind in found.dtypes} == kinds


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
