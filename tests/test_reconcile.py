from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from conftest import PANEL, months, rows
from pyspark.sql import functions as F

from seriata.operators import reconcile as r

COLUMNS = ("serie_id", "dif", "filas", "sin_pareja", "ok")


def _as_published(expected, actual, tol):
    """Per series: full outer merge, largest difference, NaN left aside."""
    out = []
    for name in sorted({s for s, *_ in expected} & {s for s, *_ in actual}):
        e, a = (
            pd.DataFrame([(d, v) for s, d, v in data if s == name], columns=["fecha", side])
            for side, data in (("e", expected), ("a", actual))
        )
        j = e.astype({"e": float}).merge(a.astype({"a": float}), on="fecha", how="outer", indicator=True)
        alone = int((j["_merge"] != "both").sum())
        gaps = np.abs(j["e"] - j["a"])
        dif = None if gaps.isna().all() else float(gaps.max())
        out.append((name, dif, len(j), alone, alone == 0 and dif is not None and dif <= tol))
    return out


def test_against_the_published_procedure(spark):
    rng = random.Random(11)
    expected = [(s, m, rng.choice([None, float(rng.randrange(9))])) for s in "abcdef" for m in months("2020-01", 9)]
    actual = [(s, m, v if rng.random() < 0.8 else 5.0) for s, m, v in expected if rng.random() < 0.9 and s != "f"]
    actual += [("a", "2030-01", 1.0), ("z", "2020-01", 1.0)]
    expected += [("b", "2020-02", 3.0)] * 3
    actual += [("b", "2020-02", 8.0)] * 4
    frames = [
        spark.createDataFrame(data, "serie_id string, fecha string, valor double")
        for data in (expected, actual)
    ]
    got = rows(r.reconcile(*frames), *COLUMNS)
    assert got == _as_published(expected, actual, 1e-9)


def test_a_relation_reconciles_with_itself(panel):
    df = panel([("a", m, 1.0) for m in months("2020-01", 5)])
    assert rows(r.reconcile(df, df)) == [("a", 0.0, 5, 0, 0, True)]
    assert rows(r.reconcile_inner(df, df, rows=5)) == [("a", 0.0, 5, True)]
    assert rows(r.reconcile_inner(df, df, rows=6)) == [("a", 0.0, 5, False)]


def test_value_against_null_passes_but_is_told(panel):
    one = panel([("a", "2020-01", 1.0), ("a", "2020-02", 2.0)])
    other = panel([("a", "2020-01", 1.0), ("a", "2020-02", math.nan)])
    assert rows(r.reconcile(one, other)) == [("a", 0.0, 2, 0, 1, True)]


def test_all_null_fails(panel):
    df = panel([("a", "2020-01", None)])
    assert rows(r.reconcile(df, df)) == [("a", None, 1, 0, 0, False)]


def test_tolerances(panel):
    one = panel([("a", "2020-01", 1.0)])
    near = panel([("a", "2020-01", 1.0 + 5e-9)])
    assert rows(r.reconcile(one, near), "ok") == [(False,)]
    assert rows(r.reconcile_inner(one, near), "ok") == [(True,)]


def test_absent_series_are_skipped_or_fail(panel):
    one = panel([("a", "2020-01", 1.0), ("b", "2020-01", 1.0)])
    other = panel([("a", "2020-01", 1.0), ("c", "2020-01", 1.0)])
    assert rows(r.reconcile(one, other), "serie_id") == [("a",)]
    assert rows(r.reconcile_inner(one, other)) == [("a", 0.0, 1, True), ("b", None, 0, False)]
    with pytest.raises(ValueError):
        r.reconcile(one, other, missing="ignore")


def test_copies_of_a_hot_key_never_meet_as_pairs(spark):
    """3e5 copies on either side are 9e10 pairs; the extremes tell the difference."""
    one = spark.range(300_000).selectExpr("'a' AS serie_id", "DATE'2020-01-01' AS fecha", "CAST(id % 7 AS DOUBLE) AS valor")
    other = one.withColumn("valor", F.col("valor") + 1)
    assert rows(r.reconcile(one, other)) == [("a", 7.0, 90_000_000_000, 0, 0, False)]


def test_except_both_ways(spark, panel):
    one = panel([("a", "2020-01", 1.0), ("a", "2020-01", 1.0), ("b", "2020-01", None)])
    same = panel([("b", "2020-01", None), ("a", "2020-01", 1.0)]).select("valor", "fecha", "serie_id")
    assert r.relations_identical(one, same)
    other = panel([("a", "2020-01", 1.0), ("c", "2020-01", 2.0)])
    assert rows(r.relations_difference(one, other), "serie_id", "solo_en") == [("b", "izquierda"), ("c", "derecha")]
    with pytest.raises(ValueError):
        r.relations_difference(one, other.drop("valor"))


def test_results_are_compared_not_texts(spark):
    one = spark.createDataFrame([(1, "x", 0.1234567), (2, "y", 1.0)], "A int, b string, c double")
    same = spark.createDataFrame([("y", 2.0, 1.0000001), ("x", 1.0, 0.1234568)], "b string, a double, c double")
    assert r.results_equal(one, same)
    assert not r.results_equal(one, one.unionByName(one.limit(1)))
    assert not r.results_equal(one, one.withColumnRenamed("b", "d"))
    assert r.results_equal(spark.createDataFrame([], PANEL), spark.createDataFrame([], PANEL))


@pytest.mark.parametrize(
    "left, right, equal",
    [
        ("9007199254740992L", "9007199254740993L", False),
        ("12345678901234567.01BD", "12345678901234567.02BD", False),
        ("1L", "1.0D", True),
        ("10.50BD", "10.5D", True),
        ("100", "100.000BD", True),
        ("-0.0D", "0", True),
        ("1e300D", "1e300D", True),
        ("1e300D", "2e300D", False),
        ("double('NaN')", "CAST(NULL AS DOUBLE)", True),
    ],
)
def test_numbers_are_compared_by_type(spark, left, right, equal):
    assert r.results_equal(spark.sql(f"SELECT {left} AS x"), spark.sql(f"SELECT {right} AS x")) == equal
