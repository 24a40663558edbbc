"""The warehouse end to end: load, stage, transform, check, verify."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seriata.operators import quality
from seriata.operators.constraints import unique
from seriata.operators.reconcile import reconcile, reconcile_inner
from seriata.operators.reshape import build_dim_fecha, concat, melt_panel
from seriata.operators.staging import stage_observations, stage_series
from seriata.operators.transforms import (
    carried_monthly,
    deaccumulate_ytd,
    moving_average,
    quarterly_from_finest_grain,
    unified_monthly,
    yoy_change,
)
from seriata.sources import delimited, sheets
from seriata.sources.tables import publish


@dataclass(frozen=True)
class Files:
    """Where the inputs are, by series or panel; all but the metadata may be absent.

    ``panels`` maps a tag to a wide CSV; ``routes`` gives the frequency a tag
    supplies, ``otherwise`` the tag of every other series.  ``daily`` maps a
    series to its CSV, ``ytd`` to its workbook and value column.
    """

    metadata: str
    panels: Mapping[str, str]
    routes: Mapping[str, str]
    otherwise: str
    daily: Mapping[str, str] = field(default_factory=dict)
    ytd: Mapping[str, tuple[str, int]] = field(default_factory=dict)


@dataclass(frozen=True)
class Star:
    dim_serie: DataFrame
    dim_fecha: DataFrame
    observations: DataFrame
    daily: DataFrame
    ytd_raw: DataFrame


def load_star(
    spark: SparkSession,
    files: Files,
    *,
    period: tuple[date, date] | None,
    sheet_rows: DataFrame | None = None,
) -> Star:
    """Read the inputs into the star; nothing is aggregated or altered.

    ``period`` bounds the daily and year-to-date series (closed; ``None`` keeps
    all).  ``sheet_rows`` stand for the workbooks, see ``sheets.load_ytd``.
    """
    dim_serie = delimited.load_dim_serie(spark, files.metadata)
    observations = delimited.load_observations(
        spark, files.panels, dim_serie, routes=files.routes, otherwise=files.otherwise
    )
    return Star(
        dim_serie=dim_serie,
        dim_fecha=build_dim_fecha(observations),
        observations=observations,
        daily=delimited.load_daily(spark, files.daily, period=period),
        ytd_raw=sheets.load_ytd(spark, files.ytd, period=period, rows=sheet_rows),
    )


def reconcile_panels(
    star: Star, monthly: DataFrame, quarterly: DataFrame, *, carried: str, tol: float = 1e-9
) -> DataFrame:
    """The star against the wide panels it came from, series by series.

    The quarterly series ``carried`` is shown month by month for the monthly
    panel; quarters are averaged from days where a series has days.
    """
    by_month = carried_monthly(star.observations, star.dim_fecha, series=carried)
    by_quarter = quarterly_from_finest_grain(star.daily, star.observations)
    return concat(
        [
            reconcile(melt_panel(panel), actual, tol=tol).withColumn("panel", F.lit(name))
            for name, panel, actual in (
                ("mensual", monthly, by_month),
                ("trimestral", quarterly, by_quarter),
            )
        ]
    )


@dataclass(frozen=True)
class Warehouse:
    dim_serie: DataFrame
    observations: DataFrame
    flows: DataFrame
    monthly: DataFrame
    yoy: DataFrame
    averages: DataFrame
    report: DataFrame
    counts: Mapping[str, int] | None = None  # of the report, seen while it was written


def build_warehouse(
    dim_serie: DataFrame,
    observations: DataFrame,
    ytd_raw: DataFrame,
    *,
    folder: str | None = None,
    prefix: str = "",
) -> Warehouse:
    """From the loaded star to the marts and the quality report.

    With a ``folder`` (shared by all executors) flows, the monthly panel and the
    report are written there, clustered by series and date, because several
    later steps read them; without one everything stays a plan.
    """

    def mart(df: DataFrame, name: str, **more) -> DataFrame:
        if folder is None:
            return df
        path = f"{folder}/{prefix}{name}"
        return publish(df, layer="marts", path=path, cluster_by=("serie_id", "fecha"), **more)

    series = stage_series(dim_serie)
    facts = stage_observations(observations)
    flows = mart(deaccumulate_ytd(ytd_raw), "desacumulado")
    monthly = mart(unified_monthly(flows, facts, series), "mensual")
    seen = Observation()
    report = mart(
        quality.quality_report(monthly, fact=facts, dim_serie=series, flows=flows),
        "reporte_calidad",
        observe=(seen, quality.report_counts()),
    )
    return Warehouse(
        dim_serie=series,
        observations=facts,
        flows=flows,
        monthly=monthly,
        yoy=yoy_change(monthly),
        averages=moving_average(monthly),
        report=report,
        counts=None if folder is None else seen.get,
    )


def assertion(name: str, failing: DataFrame) -> DataFrame:
    """One row: how many rows fail, and whether none does."""
    return failing.agg(F.count(F.lit(1)).alias("fallas")).select(
        F.lit(name).alias("prueba"), (F.col("fallas") == 0).alias("ok"), "fallas"
    )


def count_assertion(name: str, df: DataFrame, rows: int) -> DataFrame:
    """One row: by how much the row count is off."""
    return df.agg(F.abs(F.count(F.lit(1)) - rows).alias("fallas")).select(
        F.lit(name).alias("prueba"), (F.col("fallas") == 0).alias("ok"), "fallas"
    )


def verify(
    warehouse: Warehouse, expected_monthly: DataFrame, *, series: int, tol: float = 1e-8
) -> DataFrame:
    """The assertions on a rebuilt warehouse, one row each.

    What the report has found was counted while it was written; a report that is
    only a plan is counted here, in one pass.
    """
    matched = reconcile_inner(expected_monthly, warehouse.monthly, tol=tol)
    counts = warehouse.counts or warehouse.report.agg(*quality.report_counts()).first().asDict()
    found = {
        "sin huerfanas": quality.ORPHAN,
        "flujos suman diciembre": quality.MISMATCH,
        "sin errores de calidad": quality.ERROR,
    }
    rows = [(name, counts[key] == 0, counts[key]) for name, key in found.items()]
    reported = warehouse.report.sparkSession.createDataFrame(rows, "prueba string, ok boolean, fallas bigint")
    return concat(
        [
            count_assertion("series declaradas", warehouse.dim_serie, series),
            assertion("sin duplicados", unique(warehouse.observations, ["serie_id", "fecha"])),
            assertion("reconcilia", matched.where(~F.col("ok"))),
            reported,
        ]
    )
