"""Quality checks: each returns the rows that fail, never just a verdict.

``error``: the data cannot be used.  ``aviso``: look before publishing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriata.functions.dates import next_period, period_start, periods_between
from seriata.functions.exact import exact_moments, exact_totals
from seriata.functions.numbers import number_text
from seriata.operators.reshape import concat
from seriata.operators.windows import SLICE, slices_needed, with_lookback

# Severities, check names and texts of the report.
ERROR = "error"
WARNING = "aviso"
GAP = "hueco en la serie"
GAP_DETAIL = "no hay observacion para este mes"
DUPLICATE = "duplicado"
NULL_VALUE = "valor nulo"
NULL_DETAIL = "valor NULL"
ORPHAN = "serie huerfana"
ORPHAN_DETAIL = "la serie no existe en dim_serie"
JUMP = "salto improbable"
MISMATCH = "descuadre de desacumulacion"
STALE = "serie desactualizada"
STALE_DETAIL = "termina antes que el resto del panel"


_KEY = "__key"


class QualityError(ValueError):
    """The report holds errors."""


def _report(df: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return df.select(
        F.lit(check).alias("chequeo"),
        F.lit(severity).alias("severidad"),
        F.col("serie_id").cast("string").alias("serie_id"),
        F.col("fecha").cast("date").alias("fecha"),
        detail.alias("detalle"),
    )


def find_gaps(df: DataFrame, step: str = "month") -> DataFrame:
    """Periods missing between the first and the last of each series.

    One pass over the distinct periods: only the missing ones are written out,
    not the whole expected calendar.  After ``distinct`` a series is no longer
    than its calendar.
    """
    start = period_start(F.col("fecha"), step).alias("fecha")
    return _gaps_between(df.select("serie_id", start).distinct(), step)


def _gaps_between(present: DataFrame, step: str) -> DataFrame:
    """Gaps of period starts; a period may occur more than once, or be NULL."""
    window = Window.partitionBy("serie_id").orderBy("fecha")
    following = present.withColumn("__next", F.lead("fecha").over(window))
    first_missing = next_period(F.col("fecha"), step)
    last_missing = (F.col("__next") - F.expr("INTERVAL 1 DAY")).cast("date")
    return following.where(F.col("__next") > first_missing).select(
        "serie_id", F.explode(periods_between(first_missing, last_missing, step)).alias("fecha")
    )


def check_gaps(df: DataFrame, step: str = "month") -> DataFrame:
    return _report(find_gaps(df, step), GAP, ERROR, F.lit(GAP_DETAIL))


def _key_counts(df: DataFrame, key: Sequence[str] = ("serie_id", "fecha")) -> DataFrame:
    """Rows per key; copies of a hot key are combined before the shuffle."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("veces"))


def find_duplicates(df: DataFrame, key: Sequence[str] = ("serie_id", "fecha")) -> DataFrame:
    """Keys that occur more than once; NULL counts as a key of its own here."""
    return _key_counts(df, key).where(F.col("veces") > 1)


def _duplicates_report(duplicates: DataFrame) -> DataFrame:
    text = F.concat(F.lit("aparece "), F.col("veces").cast("string"), F.lit(" veces"))
    return _report(duplicates, DUPLICATE, ERROR, text)


def check_duplicates(df: DataFrame) -> DataFrame:
    return _duplicates_report(find_duplicates(df))


def check_nulls(df: DataFrame, value: str = "valor") -> DataFrame:
    return _report(df.where(F.col(value).isNull()), NULL_VALUE, ERROR, F.lit(NULL_DETAIL))


def check_orphans(fact: DataFrame, dim_serie: DataFrame) -> DataFrame:
    """Facts without their series; a NULL series is an orphan too."""
    known = dim_serie.select("serie_id")
    orphans = fact.select("serie_id", "fecha").join(known, "serie_id", "left_anti")
    return _report(orphans, ORPHAN, ERROR, F.lit(ORPHAN_DETAIL))


def find_jumps(
    df: DataFrame,
    *,
    sigmas: float = 5,
    order: Sequence[str] = ("fecha",),
    value: str = "valor",
    slices: int | str | None = None,
) -> DataFrame:
    """Rows whose change is more than ``sigmas`` deviations from the series' mean change.

    Adds ``cambio`` and ``desviaciones``.  ``order`` identifies a row within
    its series; ``slices="auto"`` cuts series too long for one task.  Mean and
    deviation come from exact sums: the same to the last bit in any order and
    any number of slices, whatever the size of the changes.
    """
    if slices == "auto":
        slices = slices_needed(df, ["serie_id"])
    changes = with_lookback(
        df.withColumn(_KEY, F.struct("serie_id")).drop("serie_id"),  # equal to itself even if the series is NULL
        lambda w: {"cambio": F.col(value) - F.lag(value).over(w)},
        series=[_KEY],
        order=order,
        back=1,
        slices=slices,
        keep_slice=True,
    )
    moments = exact_moments(changes, [_KEY], "cambio").select(_KEY, "media", "desviacion")
    if slices:
        # A row per series and slice meets the changes, so that no task holds a whole series.
        moments = changes.select(_KEY, SLICE).distinct().join(moments, _KEY)
    # Without slices the changes already lie together by series: both sides read one exchange.
    measured = changes.join(moments, [_KEY, SLICE] if slices else _KEY)
    away = F.abs(F.col("cambio") - F.col("media")) / F.col("desviacion")
    return (
        measured.withColumn("desviaciones", F.when(F.col("desviacion") > 0, away))
        .where(F.col("desviaciones") > sigmas)
        .withColumn("serie_id", F.col(_KEY)["serie_id"])
        .select(*df.columns, "cambio", "desviaciones")
    )


def check_jumps(df: DataFrame, **options) -> DataFrame:
    text = F.concat(
        F.lit("cambio "),
        number_text(F.col("cambio"), 2),
        F.lit(" = "),
        number_text(F.col("desviaciones"), 1),
        F.lit(" desviaciones"),
    )
    return _report(find_jumps(df, **options), JUMP, WARNING, text)


def find_ytd_mismatches(flows: DataFrame, *, tol: float = 1e-6) -> DataFrame:
    """Series-years whose flows do not add up to the December total.

    Flows are added exactly; years without a December total are left out.
    """
    key = F.struct("serie_id", F.year("fecha").alias("anio")).alias(_KEY)
    dated = flows.select(key, "flujo", F.when(F.month("fecha") == 12, F.col("acumulado")).alias("diciembre"))
    sums = exact_totals(dated, [_KEY], {"suma_flujos": [F.col("flujo")]}).select(_KEY, "suma_flujos")
    december = dated.groupBy(_KEY).agg(F.max("diciembre").alias("acumulado_diciembre"))
    by_year = sums.join(december, _KEY).select(f"{_KEY}.*", "suma_flujos", "acumulado_diciembre")
    difference = F.abs(F.col("suma_flujos") - F.col("acumulado_diciembre"))
    return by_year.withColumn("diferencia", difference).where(F.col("diferencia") > tol)


def check_ytd_reconciles(flows: DataFrame, *, tol: float = 1e-6) -> DataFrame:
    text = F.concat(
        F.lit("suma de flujos "),
        number_text(F.col("suma_flujos"), 2),
        F.lit(" != acumulado de diciembre "),
        number_text(F.col("acumulado_diciembre"), 2),
    )
    dated = find_ytd_mismatches(flows, tol=tol).withColumn(
        "fecha", F.make_date("anio", F.lit(12), F.lit(1))
    )
    return _report(dated, MISMATCH, ERROR, text)


def find_stale(df: DataFrame) -> DataFrame:
    """Series whose last date lies before the last date of the panel."""
    ends = df.groupBy("serie_id").agg(F.max("fecha").alias("ultima_fecha"))
    top = ends.agg(F.max("ultima_fecha")).scalar()
    return ends.withColumn("tope", top).where(F.col("ultima_fecha") < F.col("tope"))


def check_stale(df: DataFrame) -> DataFrame:
    ends = find_stale(df).withColumnRenamed("ultima_fecha", "fecha")
    return _report(ends, STALE, WARNING, F.lit(STALE_DETAIL))


def quality_report(
    monthly: DataFrame,
    *,
    fact: DataFrame,
    dim_serie: DataFrame,
    flows: DataFrame,
    step: str = "month",
    sigmas: float = 5,
    tol: float = 1e-6,
    slices: int | str | None = None,
) -> DataFrame:
    """The seven checks in one frame.

    ``monthly`` is read by five of them: pass a published table, not a long
    plan.  Gaps, duplicates and last dates are all read from one count per
    key, so that Spark can reuse its exchange.
    """
    counts = _key_counts(monthly)
    present = counts.where(F.col("veces") > 0)
    starts = present.select("serie_id", period_start(F.col("fecha"), step).alias("fecha"))
    return concat(
        [
            _report(_gaps_between(starts, step), GAP, ERROR, F.lit(GAP_DETAIL)),
            _duplicates_report(counts.where(F.col("veces") > 1)),
            check_nulls(monthly),
            check_orphans(fact, dim_serie),
            check_jumps(monthly, sigmas=sigmas, slices=slices),
            check_ytd_reconciles(flows, tol=tol),
            check_stale(present),
        ]
    )


def severity_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("severidad").agg(F.count(F.lit(1)).alias("filas"))


def report_counts() -> list[Column]:
    """Aggregates for ``publish(observe=...)``: rows of each severity and check, counted as the report is written."""
    by = [("severidad", ERROR), ("severidad", WARNING), ("chequeo", ORPHAN), ("chequeo", MISMATCH)]
    return [F.count_if(F.col(column) == value).alias(value) for column, value in by]


def require_no_errors(report: DataFrame, counts: Mapping[str, int] | None = None) -> int:
    """Raise if the report holds errors; warnings are only counted and returned.

    With ``counts`` (what ``report_counts`` has observed) the report is not read.
    """
    if counts is None:
        counts = {r["severidad"]: r["filas"] for r in severity_counts(report).collect()}
    if counts.get(ERROR):
        raise QualityError(f"the quality report holds {counts[ERROR]} errors")
    return counts.get(WARNING, 0)
