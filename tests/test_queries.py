"""Every query with a check statement gives DuckDB's rows; the others give rows at all."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest

from glosa.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SLOW = {"M05_learning_curve", "M06_grid_search"}  # covered at smaller size in test_learning


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, Decimal):
        return repr(float(value))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return str(value)


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    result = catalog.queries()[name](spark, SF)
    cursor = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(result.columns) == sorted(names)
    assert normal(result.collect(), result.columns) == normal(expected, names)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - SLOW))
def test_gives_rows(spark, name):
    result = catalog.queries()[name](spark, SF)
    assert result.limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_every_statement_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
