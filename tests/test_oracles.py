"""Every query of the motion engine against its SQL, as the driver does it."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from tidewatch.plans import catalog

DATA = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute(f"create view events as select * from '{DATA}/events.parquet'")
    return connection


def plain(value):
    return None if value is None or isinstance(value, float) and math.isnan(value) else value


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    found = catalog.QUERIES[name](spark, DATA)
    sql = catalog.ORACLE_SQL[name]
    columns = sorted(found.columns)
    expected = duck.execute(f"select {', '.join(columns)} from ({sql})").fetchall()
    rows = [tuple(plain(r[c]) for c in columns) for r in found.collect()]
    order = lambda r: tuple((x is not None, str(x)) for x in r)
    assert sorted(rows, key=order) == sorted((tuple(map(plain, r)) for r in expected), key=order)
    assert rows
    kinds = {r[0]: str(r[1]) for r in duck.execute(f"describe {sql}").fetchall()}
    assert kinds == {f.name: TYPES[f.dataType.simpleString()] for f in found.schema}
