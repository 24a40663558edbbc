"""Sliced windows equal plain ones, whatever the sizes of the series."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from seriata.operators import quality, transforms, windows

SCHEMA = "serie_id string, fecha int, valor double"


def _build(back):
    return lambda w: {
        "antes": F.lag("valor", back).over(w),
        "suma": F.sum("valor").over(w.rowsBetween(-back, Window.currentRow)),
    }


def _brute(data, back):
    out = []
    for name in {s for s, *_ in data}:
        own = sorted((d, v) for s, d, v in data if s == name)
        for i, (d, v) in enumerate(own):
            near = [x for _, x in own[max(0, i - back) : i + 1] if x is not None]
            before = own[i - back][1] if i >= back else None
            out.append((name, d, v, before, sum(near) if near else None))
    return sorted(out, key=repr)


def _check(spark, data, back, slices):
    df = spark.createDataFrame(data, SCHEMA)
    got = windows.with_lookback(
        df, _build(back), series=["serie_id"], order=["fecha"], back=back, slices=slices
    )
    assert got.columns == ["serie_id", "fecha", "valor", "antes", "suma"]
    assert rows(got) == _brute(data, back)


def test_one_series_holds_most_rows(spark):
    rng = random.Random(3)
    data = [("hot", d, float(rng.randrange(100))) for d in range(400)]
    data += [(f"s{i}", d, float(rng.randrange(100))) for i in range(40) for d in range(rng.randrange(1, 9))]
    data += [(None, d, 1.0) for d in range(30)]
    rng.shuffle(data)
    for back, slices in ((1, 7), (12, 5), (3, 30)):
        _check(spark, data, back, slices)


def test_more_rows_back_than_a_slice_holds(spark):
    data = [("a", d, float(d)) for d in range(20)] + [("b", d, float(d)) for d in range(3)]
    _check(spark, data, 9, 15)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 60)), unique=True, min_size=1, max_size=60),
    back=st.integers(1, 4),
    slices=st.integers(2, 9),
)
def test_any_sizes(spark, keys, back, slices):
    data = [(s, d, float(d * 7 % 11) if d % 5 else None) for s, d in keys]
    _check(spark, data, back, slices)


def test_slices_are_of_near_equal_size(spark):
    hot = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 50).cast("string"))).alias("serie_id"),
        F.col("id").alias("fecha"),
        F.lit(1.0).alias("valor"),
    )
    out = windows.with_lookback(
        hot, _build(1), series=["serie_id"], order=["fecha"], back=1, slices=10, keep_slice=True
    )
    sizes = [r["count"] for r in out.groupBy(windows.SLICE).count().collect()]
    assert sum(sizes) == 20_000
    assert max(sizes) < 2 * 20_000 / 10
    assert out.where("serie_id = 'hot'").select(windows.SLICE).distinct().count() >= 3


def test_slices_only_when_a_series_is_too_long(spark):
    df = spark.createDataFrame([("a", d, 0.0) for d in range(90)] + [("b", 1, 0.0)], SCHEMA)
    assert windows.slices_needed(df, ["serie_id"], rows_per_slice=90) == 0
    assert windows.slices_needed(df, ["serie_id"], rows_per_slice=30) == 4
    assert windows.slices_needed(df.limit(0), ["serie_id"]) == 0


def test_sliced_operators_equal_plain_ones(spark):
    rng = random.Random(5)
    data = [("hot", d, rng.gauss(0, 1) + (40 if d == 200 else 0)) for d in range(300)]
    data += [("b", d, rng.gauss(5, 1)) for d in range(40)] + [("c", 1, 2.0)]
    df = spark.createDataFrame(data, SCHEMA)
    for op in (transforms.yoy_change, transforms.moving_average):
        assert rows(op(df)) == rows(op(df, slices=6))
    plain = quality.find_jumps(df, sigmas=4)
    assert plain.count() == 2


@pytest.mark.parametrize("decimals", [2, 17])
def test_the_same_numbers_in_any_number_of_slices(spark, decimals):
    """Every column, bit by bit."""
    rng = random.Random(11)
    data = [("hot", d, round(rng.gauss(0, 1e4) + (9e4 if d % 97 == 0 else 0), decimals)) for d in range(900)]
    data += [("b", d, round(rng.gauss(5, 1), decimals)) for d in range(40)] + [("c", 1, 2.0), ("c", 2, None)]
    df = spark.createDataFrame(data, SCHEMA)
    jumps = [rows(quality.find_jumps(df, sigmas=2, slices=n)) for n in (None, 3, 7, 50)]
    assert len(jumps[0]) > 10 and all(j == jumps[0] for j in jumps)
    days = df.withColumn("fecha", F.date_add(F.lit("2020-01-01"), F.col("fecha").cast("int")))
    totals = [rows(transforms.accumulate_ytd(days, digits=2, slices=n)) for n in (None, 3, 7, 50)]
    assert all(t == totals[0] for t in totals)
    exact = [rows(transforms.accumulate_ytd(days, exact=True, slices=n)) for n in (None, 3, 50)]
    assert exact[0] == exact[1] == exact[2] == rows(transforms.accumulate_ytd(days, slices=5))


@pytest.mark.parametrize("size", [2, 50])
def test_auto_cuts_by_measure(spark, monkeypatch, size):
    monkeypatch.setattr(windows, "ROWS_PER_SLICE", size)
    data = [("a", d, float(d)) for d in range(20)]
    assert bool(windows.slices_needed(spark.createDataFrame(data, SCHEMA), ["serie_id"])) == (size < 20)
    _check(spark, data, 2, "auto")


def test_running_total_over_slices(spark):
    rng = random.Random(9)
    data = [("hot", d // 2, float(rng.randrange(100))) for d in range(300)]
    data += [(None, d, None if d % 3 == 0 else 2.0) for d in range(20)] + [("b", 1, None), ("b", 2, 1.0)]
    df = spark.createDataFrame(data, SCHEMA)
    options = {"group": ["serie_id"], "order": ["fecha"]}
    plain = windows.with_running_total(df, "valor", "t", **options)
    cut = windows.with_running_total(df, "valor", "t", slices=9, digits=0, **options)
    assert plain.columns == cut.columns
    assert rows(plain) == rows(cut)


def test_sliced_year_to_date(spark):
    rng = random.Random(7)
    data = [("hot" if i % 3 else f"s{i % 4}", f"{2019 + i % 2}-{1 + i % 12:02d}-{1 + i % 28:02d}", float(rng.randrange(50))) for i in range(400)]
    df = spark.createDataFrame(data, "serie_id string, d string, valor double").groupBy(
        "serie_id", F.col("d").cast("date").alias("fecha")
    ).agg(F.sum("valor").alias("valor"))
    assert rows(transforms.accumulate_ytd(df)) == rows(transforms.accumulate_ytd(df, digits=0, slices=7))
    assert rows(transforms.deaccumulate_ytd(df)) == rows(transforms.deaccumulate_ytd(df, slices=7))
