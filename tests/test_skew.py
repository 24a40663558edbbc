"""The registered queries on tables where one key holds a third of all rows."""

from __future__ import annotations

import __spark_entry__ as driver
import duckdb
import pytest
from compare import TABLES, compare, duck

from seriata.operators import windows
from seriata.plans import panels

SOURCE = "/root/testdata/sf0.001"

# A third of the rows of each fact goes to one supplier, customer, day, priority, kind or user.
SKEWED = {
    "lineitem": """SELECT * REPLACE (CASE WHEN n % 3 = 0 THEN 7 ELSE l_suppkey END AS l_suppkey,
                       CASE WHEN n % 9 = 0 THEN TIMESTAMP '1998-12-05' ELSE l_shipdate END AS l_shipdate)
                   FROM {rows}""",
    "orders": """SELECT * REPLACE (CASE WHEN n % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey,
                     CASE WHEN n % 3 = 1 THEN '1-URGENT' ELSE o_orderpriority END AS o_orderpriority,
                     CASE WHEN n % 9 = 0 THEN TIMESTAMP '1999-03-07' ELSE o_orderdate END AS o_orderdate)
                 FROM {rows}""",
    "events": """SELECT * REPLACE (CASE WHEN n % 3 = 0 THEN 'click' ELSE event_type END AS event_type,
                     CASE WHEN n % 3 = 1 THEN 8 ELSE user_id END AS user_id,
                     CASE WHEN n % 5 = 0 THEN TIMESTAMP '2024-01-10 12:00:00' ELSE ts END AS ts)
                 FROM {rows}""",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        rows = f"(SELECT *, row_number() OVER () AS n FROM '{SOURCE}/{name}.parquet')"
        kept = SKEWED.get(name, "SELECT * FROM {rows}").format(rows=rows)
        con.execute(f"COPY (SELECT * EXCLUDE (n) FROM ({kept}) t) TO '{out}/{name}.parquet'")
    return str(out)


@pytest.fixture(autouse=True)
def small_tasks(monkeypatch):
    """Limits as low as the data is small, so that the large-scale paths run."""
    monkeypatch.setattr(windows, "ROWS_PER_SLICE", 100)


def test_the_limits_take_hold(spark, folder):
    steps = panels.event_steps(spark, folder)
    assert windows.slices_needed(steps, ["serie_id"]) >= 3
    cut = driver.queries()["check_jumps"](spark, folder)
    assert windows.SLICE in cut._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize(
    "name",
    [
        "check_jumps",
        "jumps_4_sigma",
        "ex12",
        "gaps_by_day",
        "check_gaps",
        "check_duplicates",
        "dedup_first",
        "unified_monthly",
        "deaccumulate_ytd",
        "yoy_and_average",
        "quality_report",
        "reconcile_full",
        "reconcile_inner",
        "relations_difference",
        "relationship_failures",
        "unique_failures",
        "quarterly_from_daily",
        "wide_to_long",
        "series_profile",
        "published_table",
        "sheet_scan",
        "ytd_loaded",
        "jumps_sliced",
    ],
)
def test_skewed(spark, folder, name):
    ok, text = compare(spark, duck(folder), folder, driver.queries()[name], driver.oracle_sql()[name])
    assert ok, text


def test_the_tables_are_skewed(folder):
    con = duck(folder)
    for table, column in (("lineitem", "l_suppkey"), ("orders", "o_custkey"), ("events", "event_type")):
        share = con.execute(
            f"SELECT MAX(n) / SUM(n) FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {column})"
        ).fetchone()[0]
        assert share > 0.33
