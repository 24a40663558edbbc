"""Wide panels to the long star: melt, routing, first-wins dedup, dimensions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriata.functions.numbers import no_nan
from seriata.functions.text import provider_of


def melt_panel(panel: DataFrame, *, keep: Sequence[str] = ("fecha",)) -> DataFrame:
    """One row per date and series column; empty cells stay as NULL rows."""
    values = [c for c in panel.columns if c not in keep]
    typed = panel.select(*keep, *[no_nan(F.col(f"`{c}`").cast("double")).alias(c) for c in values])
    return typed.unpivot(list(keep), [f"`{c}`" for c in values], "serie_id", "valor")


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of equal columns, one under the other."""
    return reduce(DataFrame.unionByName, frames)


def route_by_frequency(
    long: DataFrame,
    dim_serie: DataFrame,
    *,
    routes: Mapping[str, str],
    otherwise: str,
    tag: str = "archivo",
) -> DataFrame:
    """Keep each series only from the panel that has its declared frequency.

    ``routes`` maps a panel tag to the one frequency it supplies; the panel
    ``otherwise`` supplies every other series, undeclared ones included (the
    orphan check has to see those).
    """
    frequency = F.col("frecuencia")
    routed = reduce(
        Column.__or__,
        [(F.col(tag) == t) & frequency.eqNullSafe(F.lit(f)) for t, f in routes.items()],
    )
    taken = reduce(Column.__or__, [frequency.eqNullSafe(F.lit(f)) for f in routes.values()])
    declared = dim_serie.select("serie_id", "frecuencia")
    return (
        long.join(declared, "serie_id", "left")
        .where(routed | ((F.col(tag) == otherwise) & ~taken))
        .drop("frecuencia")
    )


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by ``order`` (never NULL, unique in the key).

    An aggregate, not a numbered window: copies of a hot key are combined
    before the shuffle.
    """
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(*[F.min_by(c, position).alias(c) for c in rest])


def wide_to_long(
    panels: Mapping[str, DataFrame],
    dim_serie: DataFrame,
    *,
    routes: Mapping[str, str],
    otherwise: str,
    order: str = "orden",
) -> DataFrame:
    """Melt every panel, tag, route by frequency and keep the first of each key.

    A panel may carry the load order of its rows in column ``order``; without
    it its dates have to be unique.
    """
    tagged = []
    for tag, panel in panels.items():
        if order not in panel.columns:
            panel = panel.withColumn(order, F.lit(0).cast("long"))
        tagged.append(melt_panel(panel, keep=("fecha", order)).withColumn("archivo", F.lit(tag)))
    routed = route_by_frequency(concat(tagged), dim_serie, routes=routes, otherwise=otherwise)
    first = dedup_first(routed.drop("archivo"), ["serie_id", "fecha"], [order])
    return first.select("serie_id", "fecha", "valor")


def build_dim_serie(metadata: DataFrame) -> DataFrame:
    """Series dimension from the metadata table; the provider is split off the origin."""
    return metadata.select(
        F.col("variable").alias("serie_id"),
        "etiqueta",
        "frecuencia",
        "origen",
        provider_of(F.col("origen")).alias("proveedor"),
        "titulo_original",
    )


def build_dim_fecha(long: DataFrame, date: str = "fecha") -> DataFrame:
    """Calendar of the dates that occur, with year, quarter, month and year end."""
    day = F.col("fecha")
    return (
        long.select(F.col(date).cast("date").alias("fecha"))
        .where(day.isNotNull())
        .distinct()
        .select(
            "fecha",
            F.year(day).cast("short").alias("anio"),
            F.quarter(day).cast("byte").alias("trimestre"),
            F.month(day).cast("byte").alias("mes"),
            (F.month(day) == 12).alias("fin_de_anio"),
        )
    )
