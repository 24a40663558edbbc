from __future__ import annotations

from datetime import date

from conftest import rows
from pyspark.sql import functions as F

from seriata import schemas
from seriata.operators import profiles, reshape
from seriata.operators.constraints import schema_failures


def test_melt_keeps_empty_cells_and_drops_nan(spark):
    wide = spark.createDataFrame(
        [(date(2020, 1, 1), 1.0, float("nan")), (date(2020, 2, 1), None, 2.0)], "fecha date, `a.1` double, b double"
    )
    assert rows(reshape.melt_panel(wide), "serie_id", "fecha", "valor") == [
        ("a.1", "2020-01-01", 1.0),
        ("a.1", "2020-02-01", None),
        ("b", "2020-01-01", None),
        ("b", "2020-02-01", 2.0),
    ]


def test_routing_keeps_undeclared_series(spark):
    dim = spark.createDataFrame([("q", "Q"), ("m", "M"), ("d", "D")], "serie_id string, frecuencia string")
    names = ["q", "m", "d", "undeclared"]
    wide = spark.createDataFrame([(date(2020, 1, 1), 1.0, 2.0, 3.0, 4.0)], ["fecha", *names])
    tenfold = wide.select("fecha", *[(F.col(n) * 10).alias(n) for n in names])
    out = reshape.wide_to_long({"men": wide, "tri": tenfold}, dim, routes={"tri": "Q"}, otherwise="men")
    assert schema_failures(out, schemas.FACT_OBSERVACION) == []
    assert rows(out, "serie_id", "valor") == [("d", 3.0), ("m", 2.0), ("q", 10.0), ("undeclared", 4.0)]


def test_first_row_of_a_key_wins(spark):
    df = spark.createDataFrame(
        [("a", 2, 20.0, "late"), ("a", 1, None, "first"), ("b", 5, 1.0, "only")], "k string, pos int, v double, t string"
    )
    assert rows(reshape.dedup_first(df, ["k"], ["pos"])) == [("a", None, "first"), ("b", 1.0, "only")]
    assert rows(reshape.dedup_first(df, ["k"], ["pos", "t"])) == [("a", None), ("b", 1.0)]


def test_dimensions(spark, panel):
    meta = spark.createDataFrame([("ffr", "Rate", "M", "FRED - FEDFUNDS", None)], schemas.METADATA)
    dim = reshape.build_dim_serie(meta)
    assert rows(dim) == [("ffr", "Rate", "M", "FRED - FEDFUNDS", "FRED", None)]
    assert schema_failures(dim, schemas.DIM_SERIE) == []
    days = reshape.build_dim_fecha(panel([("a", "2020-12", 1.0), ("b", "2020-12", 1.0), ("a", "2021-04", 1.0), ("c", None, 1.0)]))
    assert rows(days) == [("2020-12-01", 2020, 4, 12, True), ("2021-04-01", 2021, 2, 4, False)]
    assert schema_failures(days, schemas.DIM_FECHA) == []


def test_profiles(spark, panel):
    dim = spark.createDataFrame([("a", "M"), ("empty", "Q")], "serie_id string, frecuencia string")
    obs = panel([("a", "2020-01", 1.0), ("a", "2020-02", None), ("undeclared", "2020-01", 1.0)])
    assert rows(profiles.series_profile(dim, obs)) == [
        ("a", "M", 1, "2020-01-01", "2020-02-01", 1),
        ("empty", "Q", 0, None, None, 1),
    ]
    raw = panel([("y", f"2020-{m:02d}", m * 1.06) for m in range(1, 8)])
    assert rows(profiles.ytd_profile(raw)) == [("y", 7, "2020-01-01", "2020-07-01", 1.1, 7.4)]
    assert [tuple(r) for r in profiles.ytd_peek(raw, "y", 2020).collect()] == [(1, 1.1), (2, 2.1), (3, 3.2), (4, 4.2)]
    assert rows(profiles.daily_profile(raw)) == [("y", 7, "2020-01-01", "2020-07-01")]
