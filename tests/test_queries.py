"""Every registered query against its SQL twin, row by row and exactly."""

from __future__ import annotations

import __spark_entry__ as driver
import pytest
from compare import compare, duck

from seriata.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    sql = driver.oracle_sql()
    assert name in sql
    ok, text = compare(spark, con, FOLDER, driver.queries()[name], sql[name])
    assert ok, text


def test_entry(spark):
    df = driver.entry(spark)
    assert df.columns == ["serie_id", "fecha", "acumulado", "flujo"]
    assert df.count() == 1015
