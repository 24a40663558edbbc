"""Sums of doubles that do not depend on the order of rows, against fractions."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seriata.functions.exact import exact_moments, exact_totals
from seriata.operators import quality, windows
from seriata.operators import transforms as tr

INF = float("inf")


def values():
    rng = random.Random(4)
    cases = {
        "cancelled": [1e300, 1.0, -1e300],
        "tenths": [0.1] * 1000,
        "smallest": [5e-324] * 3,
        "largest": [1.7e308, -1.7e308, 2.0**-1000],
        "zeros": [0.0, -0.0],
        "powers": [2.0 ** (32 * k) for k in range(-30, 31)] + [-math.nextafter(2.0 ** (32 * k), 0) for k in range(-30, 30)],
        None: [1.5, 2.5, None],
    }
    for i in range(40):
        cases[f"random {i}"] = [rng.uniform(-1, 1) * 10.0 ** rng.randint(-7 * i, 7 * i) for _ in range(100)]
    return cases


def test_totals_are_those_of_fractions(spark):
    cases = values()
    rows = [(k, x) for k, xs in cases.items() for x in xs]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    found = {r.k: r for r in exact_totals(df, ["k"], {"s": [F.col("x")]}).collect()}
    assert len(found) == len(cases)
    for k, xs in cases.items():
        xs = [x for x in xs if x is not None]
        total = sum(map(Fraction, xs))
        assert found[k].s == float(total) and found[k]["s__n"] == len(xs), k
        assert abs(found[k].s + Fraction(found[k]["s__rest"]) - total) <= abs(total) / 2**94


def test_totals_of_nulls_nan_and_infinities(spark):
    rows = [("n", None), ("i", INF), ("i", 1.0), ("nan", math.nan), ("nan", 2.0), ("both", INF), ("both", -INF)]
    df = spark.createDataFrame(rows, "k string, x double")
    found = {r.k: r.s for r in exact_totals(df, ["k"], {"s": [F.col("x")]}).collect()}
    assert found["n"] is None and found["i"] == INF and math.isnan(found["nan"]) and math.isnan(found["both"])
    assert exact_totals(df.limit(0), ["k"], {"s": [F.col("x")]}).isEmpty()


def _moments(xs):
    n, s = len(xs), sum(map(Fraction, xs))
    mean = s / n
    spread = sum((x - mean) ** 2 for x in map(Fraction, xs))
    return float(mean), math.sqrt(spread / (n - 1)) if n > 1 else None


def test_moments_are_those_of_fractions(spark):
    rng = random.Random(8)
    cases = {f"{scale:g}": [scale * (1 + rng.gauss(0, 1e-9)) for _ in range(300)] for scale in (1e-140, 1e-8, 1.0, 1e22, 1e140)}
    cases |= {"one": [3.5], "equal": [0.1] * 7, "wide": [rng.gauss(0, 10.0 ** rng.randint(-9, 9)) for _ in range(300)]}
    df = spark.createDataFrame([(k, x) for k, xs in cases.items() for x in xs], "k string, x double")
    runs = [{r.k: r for r in exact_moments(df.repartition(n), ["k"], "x").collect()} for n in (1, 6, 13)]
    assert runs[0] == runs[1] == runs[2]
    for k, xs in cases.items():
        mean, deviation = _moments(xs)
        assert runs[0][k].media == pytest.approx(mean, rel=1e-15)
        assert runs[0][k].desviacion == (None if deviation is None else pytest.approx(deviation, rel=1e-12))


@pytest.mark.parametrize("scale", [1e-8, 1.0, 1e22])
def test_jumps_of_any_size(spark, scale):
    rng = random.Random(3)
    steps = [scale * rng.gauss(0, 1) for _ in range(50)]
    steps[20] = 40 * scale
    rows, at = [], 0.0
    for i, step in enumerate(steps):
        at += step
        rows += [("a", i, at), (None, i, at)]
    df = spark.createDataFrame(rows, "serie_id string, fecha int, valor double").repartition(5)
    plain, sliced = (
        sorted(map(tuple, quality.find_jumps(df, sigmas=3, slices=n).select("serie_id", "fecha", "cambio", "desviaciones").collect()), key=repr)
        for n in (None, 4)
    )
    assert plain == sliced and [(s, f) for s, f, *_ in plain] == [("a", 20), (None, 20)]


def test_running_totals_in_slices_without_decimals(spark):
    rng = random.Random(6)
    rows = [(s, i // 3, rng.gauss(0, 10.0 ** rng.randint(-8, 8))) for s in ("a", "b", None) for i in range(60)]
    rows += [("c", 0, None), ("c", 1, 2.5), ("c", 2, 1e22), ("c", 3, -1e22)]
    df = spark.createDataFrame(rows, "g string, o int, x double").repartition(5)
    runs = []
    for slices in (None, 3, 8):
        out = windows.with_running_total(df, "x", "total", group=["g"], order=["o"], exact=True, slices=slices)
        assert out.columns == ["g", "o", "x", "total"]
        runs.append(sorted(map(tuple, out.collect()), key=repr))
    assert runs[0] == runs[1] == runs[2]
    for g, o, _, total in runs[0]:
        before = [Fraction(x) for s, i, x in rows if s == g and i <= o and x is not None]
        assert total == (float(sum(before)) if before else None)
    assert [t for g, _, _, t in runs[0] if g == "c"] == [None, 2.5, 1e22 + 2.5, 2.5]


def test_quarterly_means_do_not_depend_on_the_order(spark):
    rows = [("a", i, 0.1 * i + 1e9 * (-1) ** i) for i in range(90)]
    df = spark.createDataFrame(rows, "serie_id string, i int, valor double").withColumn("fecha", F.date_add(F.lit("2020-01-01").cast("date"), F.col("i")))
    found = {tuple(tr.quarterly_means(df.repartition(n, "i")).first()) for n in (1, 3, 7)}
    assert len(found) == 1 and found.pop()[2] == float(sum(Fraction(v) for _, _, v in rows) / 90)
