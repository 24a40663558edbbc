"""NOT IN as SQL has it."""

from __future__ import annotations

import duckdb
import pytest

from seriata.operators.anti import not_in

ROWS = {"some": [1, 2, 2, 3], "null": [1, None, 2, 5], "empty": []}


@pytest.mark.parametrize("left", ROWS)
@pytest.mark.parametrize("right", ROWS)
def test_not_in_is_duckdbs(spark, left, right):
    df = spark.createDataFrame([(x,) for x in ROWS[left]], "k int")
    listed = spark.createDataFrame([(x,) for x in ROWS[right] if x != 1], "v int")
    con = duckdb.connect()
    con.execute("CREATE TABLE l (k INT); CREATE TABLE r (v INT)")
    for table, values in (("l", ROWS[left]), ("r", [x for x in ROWS[right] if x != 1])):
        for x in values:
            con.execute(f"INSERT INTO {table} VALUES (?)", [x])
    want = con.execute("SELECT k FROM l WHERE k NOT IN (SELECT v FROM r)").fetchall()
    found = not_in(df, "k", listed, "v")
    assert found.columns == ["k"] and sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text
