"""Staging: rename and type, no business rule."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriata.functions.dates import month_start


def staging(df: DataFrame, casts: Mapping[str, str], names: Mapping[str, str] | None = None) -> DataFrame:
    """Pick the columns of ``casts`` in order, typed; ``names`` renames them."""
    names = names or {}
    return df.select(*[F.col(c).cast(kind).alias(names.get(c, c)) for c, kind in casts.items()])


def stage_observations(fact: DataFrame) -> DataFrame:
    return staging(fact, {"serie_id": "string", "fecha": "date", "valor": "double"})


def stage_series(dim_serie: DataFrame) -> DataFrame:
    columns = ("serie_id", "etiqueta", "frecuencia", "origen", "proveedor", "titulo_original")
    return staging(dim_serie, dict.fromkeys(columns, "string"))


def stage_ytd(raw: DataFrame) -> DataFrame:
    """Year-to-date rows as published, dated at the start of their month."""
    typed = staging(
        raw, {"serie_id": "string", "fecha": "date", "valor": "double"}, {"valor": "acumulado"}
    )
    return typed.withColumn("fecha", month_start(F.col("fecha")))
