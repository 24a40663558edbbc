"""Profiles: what each series holds, as small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.functions.dates import in_year
from seriata.functions.numbers import round_at


def series_profile(dim_serie: DataFrame, observations: DataFrame) -> DataFrame:
    """Per declared series: values, first and last date, NULLs.

    A series without rows is kept and shows one NULL, as the published profile
    does.  Facts are counted first, so only one row per series is joined.
    """
    counted = observations.groupBy("serie_id").agg(
        F.count("valor").alias("obs"),
        F.min("fecha").alias("desde"),
        F.max("fecha").alias("hasta"),
        F.count(F.lit(1)).alias("filas"),
    )
    series = dim_serie.select("serie_id", F.col("frecuencia").alias("frec"))
    obs = F.coalesce(F.col("obs"), F.lit(0))
    return series.join(counted, "serie_id", "left").select(
        "serie_id",
        "frec",
        obs.alias("obs"),
        "desde",
        "hasta",
        (F.coalesce(F.col("filas"), F.lit(1)) - obs).alias("nulos"),
    )


def daily_profile(daily: DataFrame) -> DataFrame:
    return daily.groupBy("serie_id").agg(
        F.count(F.lit(1)).alias("obs"),
        F.min("fecha").alias("desde"),
        F.max("fecha").alias("hasta"),
    )


def ytd_profile(raw: DataFrame, digits: int = 1) -> DataFrame:
    return raw.groupBy("serie_id").agg(
        F.count(F.lit(1)).alias("obs"),
        F.min("fecha").alias("desde"),
        F.max("fecha").alias("hasta"),
        round_at(F.min("valor"), digits).alias("min"),
        round_at(F.max("valor"), digits).alias("max"),
    )


def ytd_peek(raw: DataFrame, series: str, year: int, n: int = 4, digits: int = 1) -> DataFrame:
    """The first ``n`` months of one series and year, as published."""
    return (
        raw.where((F.col("serie_id") == series) & in_year(F.col("fecha"), year))
        .select(F.month("fecha").alias("mes"), round_at(F.col("valor"), digits).alias("acumulado"))
        .orderBy("mes")
        .limit(n)
    )
