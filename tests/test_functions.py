"""Scalar expressions against the behaviour the published results rest on."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from conftest import rows
from pyspark.sql import functions as F

from seriata.functions import dates, numbers, text


@pytest.mark.parametrize("digits", [1, 2, 4])
def test_rounding_equals_the_other_engine(spark, digits):
    rng = random.Random(digits)
    values = [1.005, 2.675, -2.5, 0.49999999999999994, -0.001, 0.0, 1e15, -12345.675]
    values += [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [rng.randrange(-10**7, 10**7) / 10 ** (digits + 1) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        numbers.round_at(F.col("v"), digits)
    )
    want = duckdb.execute(
        f"SELECT ROUND(v::DOUBLE, {digits}) FROM (SELECT UNNEST(?::DOUBLE[]) AS v)", [values]
    ).fetchall()
    for value, (a,), (b,) in zip(values, got.collect(), want, strict=True):
        assert a == b and math.copysign(1, a) == math.copysign(1, b), value


def test_plain_round_would_differ(spark):
    one = spark.range(1).select(F.round(F.lit(1.005), 2), numbers.round_at(F.lit(1.005), 2)).first()
    assert tuple(one) == (1.01, 1.0)


@pytest.mark.parametrize("digits", [1, 2])
def test_number_text_equals_the_other_engine(spark, digits):
    rng = random.Random(digits)
    values = [5.0, -0.9, 0.0, -0.001, 12345678.9, 1e-5, 1e14, 100.0, 10.1, -0.05, 0.995]
    values += [rng.uniform(-1e9, 1e9) for _ in range(3000)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(
        numbers.number_text(F.col("v"), digits)
    )
    want = duckdb.execute(
        f"SELECT ROUND(v::DOUBLE, {digits})::VARCHAR FROM (SELECT UNNEST(?::DOUBLE[]) AS v)", [values]
    ).fetchall()
    assert [r[0] for r in got.collect()] == [r[0] for r in want]


def test_exact_sums_and_means_do_not_depend_on_row_order(spark):
    rng = random.Random(4)
    values = [rng.randrange(-10**9, 10**9) / 100 for _ in range(4000)] + [None, 1e13, -1e13]
    for _ in range(3):
        rng.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(rng.randrange(2, 9))
        total, mean = df.select(numbers.exact_sum(F.col("v")), numbers.mean_of(F.col("v"), 2)).first()
        units = sum(round(v * 100) for v in values if v is not None)
        assert total == units / 100 and mean == total / 4002
    none = spark.createDataFrame([], "v double").select(numbers.mean_of(F.col("v"), 2), numbers.mean_of(F.col("v")))
    assert tuple(none.first()) == (None, None)


def test_no_value_is_null(spark):
    df = spark.createDataFrame([(float("nan"),), (None,), (1.5,)], "v double")
    assert [r[0] for r in df.select(numbers.no_nan(F.col("v"))).collect()] == [None, None, 1.5]


def test_ratio_and_parsing_never_raise(spark):
    df = spark.createDataFrame([(1.0, 0.0, "x"), (1.0, None, "NaN"), (1.0, 2.0, " 3.5 ")], "a double, b double, t string")
    got = df.select(numbers.ratio(F.col("a"), F.col("b")), numbers.try_number(F.col("t")))
    assert [tuple(r) for r in got.collect()] == [(None, None), (None, None), (0.5, 3.5)]


def test_dates_parse_or_become_null(spark):
    texts = ["2020-01-31", " 2020-01-31 00:00:00", "31/01/2020", "total", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    iso = rows(df.select(dates.try_date(F.col("t"))))
    assert iso.count(("2020-01-31",)) == 2 and iso.count((None,)) == 3
    both = rows(df.select(dates.try_date(F.col("t"), "dd/MM/yyyy")))
    assert both.count(("2020-01-31",)) == 3


@pytest.mark.parametrize(
    "step, start, following",
    [
        ("day", "2020-02-29", "2020-03-01"),
        ("week", "2020-02-24", "2020-03-02"),
        ("month", "2020-02-01", "2020-03-01"),
        ("quarter", "2020-01-01", "2020-04-01"),
        ("year", "2020-01-01", "2021-01-01"),
    ],
)
def test_period_starts_are_dates(spark, step, start, following):
    first = dates.period_start(F.col("d"), step)
    df = spark.sql("SELECT DATE'2020-02-29' AS d").select(
        first.alias("a"), dates.next_period(first, step).alias("b")
    )
    assert df.dtypes == [("a", "date"), ("b", "date")]
    assert rows(df) == [(start, following)]


def test_months_from_a_month_end_do_not_drift(spark):
    start = dates.month_start(F.lit("2020-01-31").cast("date"))
    end = dates.month_start(F.lit("2020-04-30").cast("date"))
    df = spark.range(1).select(F.explode(dates.periods_between(start, end, "month")))
    assert rows(df) == [("2020-01-01",), ("2020-02-01",), ("2020-03-01",), ("2020-04-01",)]
    none = spark.range(1).select(dates.periods_between(end, start, "month"))
    assert none.first()[0] is None


def test_text(spark):
    df = spark.createDataFrame([("FRED - DGS2 - x",), ("BCCR",)], "o string")
    assert rows(df.select(text.provider_of(F.col("o")))) == [("BCCR",), ("FRED",)]
    cells = spark.createDataFrame([("  FECHA de corte",), ("mi fecha",), (None,)], "c string")
    assert [r[0] for r in cells.select(text.starts_like(F.col("c"), "fecha")).collect()] == [True, False, None]
