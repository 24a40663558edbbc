"""Physical plans: what reaches the scan, how often rows are shuffled, what is joined how."""

from __future__ import annotations

import re

import __spark_entry__ as driver
import pytest
from conftest import PANEL, rows
from pyspark.sql import functions as F

from seriata.functions.dates import in_year
from seriata.operators import quality, reconcile
from seriata.operators import transforms as tr
from seriata.plans import panels, registry
from seriata.sources import sheets, tables

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> list[str]:
    return re.findall(r"(?<!Broadcast)(?<!Reused)Exchange (\w+partitioning\([^)]*\))", plan(df))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored panel, as a mart would be."""
    path = str(tmp_path_factory.mktemp("plans") / "panel")
    panels.supplier_month(spark, FOLDER).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(registry.QUERIES[name](spark, FOLDER))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Arrow", "Pandas"):
        assert node not in text, text
    # One task only ever gets the rows of a global aggregate's partial results.
    lines = text.splitlines()
    for above, below in zip(lines, lines[1:]):
        if "Exchange SinglePartition" in above:
            assert "HashAggregate(keys=[]" in below


def test_series_and_date_range_reach_the_scan(spark, stored):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    picked = stored.where((F.col("serie_id") == "7") & in_year(F.col("fecha"), 1998)).select("valor")
    text = plan(picked)
    for pushed in ("EqualTo(serie_id,7)", "GreaterThanOrEqual(fecha,1998-01-01)", "LessThan(fecha,1999-01-01)"):
        assert pushed in text


def test_a_series_filter_passes_below_the_window(stored):
    assert "EqualTo(serie_id,7)" in plan(tr.yoy_change(stored).where(F.col("serie_id") == "7"))


def test_only_needed_columns_are_read(spark):
    text = plan(panels.supplier_month(spark, FOLDER))
    assert "ReadSchema: struct<l_suppkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in text


def test_sums_are_combined_before_the_shuffle(spark):
    text = plan(panels.supplier_month(spark, FOLDER))
    assert "partial_sum" in text and len(exchanges(panels.supplier_month(spark, FOLDER))) == 1


def test_two_windows_share_one_exchange_and_sort(stored):
    both = tr.moving_average(tr.yoy_change(stored))
    assert len(exchanges(both)) == 1
    assert plan(both).count("Sort [") == 1


def test_jumps_need_one_exchange(spark, stored):
    """Changes and their moments read the same one; without a broadcast, so that both are there to see."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = quality.find_jumps(stored)
        found.collect()
        final = plan(found).split("Initial Plan")[0]
        lines = [line for line in final.splitlines() if "Exchange hash" in line]
        assert sorted("ReusedExchange" in line for line in lines) == [False, True], final
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_reconciliation_has_no_join(stored):
    df = reconcile.reconcile(stored, stored.where("valor > 1"))
    assert "Join" not in plan(df)
    assert len(exchanges(df)) == 2
    assert "partial_max" in plan(df)


def test_difference_has_one_exchange(stored):
    df = reconcile.relations_difference(stored, stored)
    assert "Join" not in plan(df) and len(exchanges(df)) == 1


def test_first_of_a_key_is_a_hash_aggregate(spark):
    text = plan(driver.queries()["dedup_first"](spark, FOLDER))
    assert "partial_min_by" in text and "SortAggregate" not in text and "Window" not in text


def test_report_counts_keys_once(spark, stored):
    flows = tr.deaccumulate_ytd(stored)
    dim = stored.select("serie_id").limit(3)
    report = quality.quality_report(stored, fact=stored, dim_serie=dim, flows=flows)
    report.collect()
    text = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in text


def test_empty_panels_have_plans_and_no_rows(spark):
    empty = spark.createDataFrame([], PANEL)
    for df in (
        tr.yoy_change(empty),
        tr.deaccumulate_ytd(empty),
        quality.find_gaps(empty),
        quality.find_jumps(empty, slices="auto"),
        quality.find_stale(empty),
        reconcile.reconcile(empty, empty),
    ):
        assert df.isEmpty()


def test_a_sheet_is_in_no_window_and_its_header_is_sought_in_the_first_rows(spark, tmp_path):
    path = str(tmp_path / "sheet")
    cells = [("f", 0, ["fecha", "v"]), ("f", 1, ["2020-01-31", "1"])]
    spark.createDataFrame(cells, sheets.SHEET_SCHEMA).write.parquet(path)
    df = sheets.load_ytd(spark, {"a": ("f", 1), "b": ("f", 1)}, period=None, rows=spark.read.parquet(path))
    assert "Window" not in plan(df) and "LessThan(row_idx,15)" in plan(df)
    assert sorted(r.serie_id for r in df.collect()) == ["a", "b"]


def test_a_bucketed_mart_needs_no_exchange(spark, tmp_path):
    facts = panels.supplier_month(spark, FOLDER)
    names = spark.read.parquet(f"{FOLDER}/supplier.parquet").selectExpr("CAST(s_suppkey AS STRING) AS serie_id")
    fact = tables.publish_bucketed(facts, "plan_fact", buckets=4, path=str(tmp_path / "f"))
    dim = tables.publish_bucketed(names, "plan_dim", order=(), buckets=4, path=str(tmp_path / "d"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (
            tr.deaccumulate_ytd(fact),
            tr.moving_average(tr.yoy_change(fact)),
            fact.join(dim, "serie_id", "left_anti"),
            fact.join(dim, "serie_id"),
        ):
            assert exchanges(df) == [], plan(df)
        assert rows(tr.yoy_change(fact)) == rows(tr.yoy_change(facts))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        tables.drop_all(spark, ["plan_fact", "plan_dim"])
