from __future__ import annotations

import pytest
from conftest import months, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seriata.functions.dates import in_year
from seriata.operators import staging
from seriata.operators import transforms as tr


def test_flow_is_the_difference_within_the_year(panel):
    raw = panel([("a", "2020-11-30", 10.0), ("a", "2020-12-31", 15.0), ("a", "2021-01-31", 4.0), ("a", "2021-02-28", 9.0)])
    out = tr.deaccumulate_ytd(raw)
    assert out.columns == ["serie_id", "fecha", "acumulado", "flujo"]
    assert rows(out) == [
        ("a", "2020-11-01", 10.0, 10.0),
        ("a", "2020-12-01", 15.0, 5.0),
        ("a", "2021-01-01", 4.0, 4.0),
        ("a", "2021-02-01", 9.0, 5.0),
    ]


def test_a_null_total_counts_as_zero_for_the_next_row(panel):
    raw = panel([("a", "2020-01-31", 1.0), ("a", "2020-02-29", None), ("a", "2020-03-31", 3.0)])
    assert [r[3] for r in rows(tr.deaccumulate_ytd(raw))] == [1.0, None, 3.0]


def test_a_missing_month_merges_two_flows(panel):
    raw = panel([("a", "2020-01-31", 1.0), ("a", "2020-03-31", 6.0)])
    assert rows(tr.deaccumulate_ytd(raw), "fecha", "flujo") == [("2020-01-01", 1.0), ("2020-03-01", 5.0)]


def test_rows_are_ordered_by_the_published_date(panel):
    """Two dates in one month: the later total comes second, both dated at month start."""
    raw = panel([("a", "2020-05-31", 9.0), ("a", "2020-05-15", 4.0)])
    assert rows(tr.deaccumulate_ytd(raw), "fecha", "flujo") == [("2020-05-01", 4.0), ("2020-05-01", 5.0)]


def test_staged_variant_equals_the_direct_one(panel):
    raw = panel([("a", m + "-28", float(i * i)) for i, m in enumerate(months("2019-01", 30))])
    direct = tr.deaccumulate_ytd(raw)
    staged = tr.deaccumulate_ytd(staging.stage_ytd(raw), value="acumulado")
    assert rows(direct) == rows(staged)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=40))
def test_accumulate_is_undone(panel, values):
    flows = panel([("a", m, float(v)) for m, v in zip(months("2018-05", 40), values)])
    totals = tr.accumulate_ytd(flows).select("serie_id", "fecha", F.col("acumulado").alias("valor"))
    assert rows(tr.deaccumulate_ytd(totals), "serie_id", "fecha", "flujo") == rows(flows)


def test_peers_of_one_date_accumulate_together(panel):
    df = panel([("a", "2020-01-01", 1.0), ("a", "2020-01-01", 2.0), ("a", "2020-02-01", 4.0)])
    assert rows(tr.accumulate_ytd(df), "acumulado") == [(3.0,), (3.0,), (7.0,)]


def test_unified_monthly_takes_each_series_once(spark, panel):
    raw = panel([("y", "2020-01-31", 1.0), ("y", "2020-02-29", 3.0)])
    seen = panel([("y", "2020-01-01", 9.0), ("m", "2020-01-01", 5.0), ("d", "2020-01-01", 7.0), ("q", "2020-01-01", 8.0), ("u", "2020-01-01", 8.5)])
    dim = spark.createDataFrame([("y", "M"), ("m", "M"), ("d", "D"), ("q", "Q")], "serie_id string, frecuencia string")
    out = tr.unified_monthly(tr.deaccumulate_ytd(raw), seen, dim, ytd_series=raw)
    assert rows(out) == [("m", "2020-01-01", 5.0), ("y", "2020-01-01", 1.0), ("y", "2020-02-01", 2.0)]


def test_unified_monthly_runs_nothing_by_itself(spark, panel):
    raw = panel([("y", "2020-01-31", 1.0)])
    dim = spark.createDataFrame([("y", "M")], "serie_id string, frecuencia string")
    spark.sparkContext.setJobGroup("unified", "unified")
    out = tr.unified_monthly(tr.deaccumulate_ytd(raw), panel([("m", "2020-01", 2.0)]), dim, ytd_series=raw)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("unified")
    spark.sparkContext.setJobGroup("tests", "tests")
    assert "hint" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_yoy_needs_a_previous_value_that_is_not_zero(panel):
    values = [0.0, 2.0, None] + [1.0] * 9 + [5.0, 3.0, 4.0]
    df = panel([("a", m, v) for m, v in zip(months("2019-01", 15), values)])
    out = tr.yoy_change(df)
    assert out.columns == ["serie_id", "fecha", "valor", "hace_un_anio", "var_interanual_pc"]
    got = rows(out, "fecha", "hace_un_anio", "var_interanual_pc")
    assert got[11:] == [
        ("2019-12-01", None, None),
        ("2020-01-01", 0.0, None),
        ("2020-02-01", 2.0, 50.0),
        ("2020-03-01", None, None),
    ]


def test_yoy_counts_rows_not_months(panel):
    kept = [m for m in months("2019-01", 14) if m != "2019-06"]
    df = panel([("a", m, float(i + 1)) for i, m in enumerate(kept)])
    assert rows(tr.yoy_change(df), "fecha", "hace_un_anio")[-1] == ("2020-02-01", 1.0)


def test_moving_average_is_shorter_at_the_start_and_skips_nulls(panel):
    df = panel([("a", m, v) for m, v in zip(months("2020-01", 5), [1.0, 2.0, None, 6.0, 7.0])])
    assert [r[1] for r in rows(tr.moving_average(df), "fecha", "mm3")] == [1.0, 1.5, 1.5, 4.0, 6.5]
    assert "mm2" in tr.moving_average(df, n=2).columns


def test_filter_before_and_after_the_window_differ(panel):
    df = panel([("a", m, float(i)) for i, m in enumerate(months("2019-10", 6))])
    year = in_year(F.col("fecha"), 2020)
    first = rows(tr.moving_average(df.where(year)), "fecha", "mm3")[0]
    last = rows(tr.moving_average(df).where(year), "fecha", "mm3")[0]
    assert first == ("2020-01-01", 3.0) and last == ("2020-01-01", 2.0)


def test_quarter_shown_on_each_date_of_the_calendar(spark, panel):
    obs = panel([("q", "2020-01-01", 1.0), ("q", "2020-04-01", 2.0), ("m", "2020-01-01", 9.0)])
    calendar = panel([("-", m, 0.0) for m in ["2020-01", "2020-03", "2020-04", "2020-07"]]).select("fecha")
    out = tr.quarter_to_month_broadcast(obs, calendar, series="q")
    assert rows(out) == [("q", "2020-01-01", 1.0), ("q", "2020-03-01", 1.0), ("q", "2020-04-01", 2.0)]
    whole = tr.carried_monthly(obs, calendar, series="q")
    assert rows(whole) == sorted(rows(out) + [("m", "2020-01-01", 9.0)])


def test_quarter_comes_from_the_finest_grain(panel):
    daily = panel([("d", "2020-01-01", 1.0), ("d", "2020-01-02", 2.0), ("d", "2020-02-01", 9.0)])
    own = panel([("d", "2020-01-01", 100.0), ("m", "2020-01-01", 4.0), ("m", "2020-02-01", 6.0)])
    out = tr.quarterly_from_finest_grain(daily, own)
    assert rows(out) == [("d", "2020-01-01", 4.0), ("m", "2020-01-01", 5.0)]
    assert rows(tr.quarterly_mean_of_means(daily)) == [("d", "2020-01-01", 5.25)]
