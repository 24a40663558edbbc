"""Transforms of long panels.

Panels are keyed by (serie_id, fecha).  At month grain a (series, year) window
holds at most 12 rows and a series window at most the months of the calendar;
``slices`` (see ``windows``) is for tables without such a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriata.functions.dates import month_start, quarter_start
from seriata.functions.exact import exact_moments
from seriata.functions.numbers import mean_of, ratio, round_at
from seriata.operators.anti import not_in
from seriata.operators.windows import with_lookback, with_running_total


def deaccumulate_ytd(
    df: DataFrame,
    *,
    series: str = "serie_id",
    date: str = "fecha",
    value: str = "valor",
    slices: int | str | None = None,
) -> DataFrame:
    """Year-to-date totals to flows of the month.

    The total of the row before in the same year is taken off; the first row
    of a year is its own flow.  Rows are ordered by the published date and
    dated at month start afterwards.
    """
    flows = with_lookback(
        df.withColumn("__year", F.year(date)),
        lambda w: {"flujo": F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0.0))},
        series=[series, "__year"],
        order=[date],
        back=1,
        slices=slices,
    )
    return flows.select(
        series,
        month_start(F.col(date)).alias(date),
        F.col(value).alias("acumulado"),
        "flujo",
    )


def accumulate_ytd(
    df: DataFrame,
    *,
    series: str = "serie_id",
    date: str = "fecha",
    value: str = "valor",
    name: str = "acumulado",
    digits: int | None = None,
    exact: bool = False,
    slices: int | str | None = None,
) -> DataFrame:
    """Running total within each series and year; rows of one date count together.

    ``digits``: the values' decimals, for totals that are exact in any row
    order; ``exact``: the same for doubles of any size.
    """
    totals = with_running_total(
        df.withColumn("__year", F.year(date)),
        value,
        name,
        group=[series, "__year"],
        order=[date],
        digits=digits,
        exact=exact,
        slices=slices,
    )
    return totals.drop("__year")


def unified_monthly(
    flows: DataFrame,
    observations: DataFrame,
    dim_serie: DataFrame,
    *,
    ytd_series: DataFrame | None = None,
    freq: str = "M",
) -> DataFrame:
    """Flows of the year-to-date series plus the series observed at ``freq``.

    The wanted series are settled among the names first, so that the
    observations are joined once.  ``ytd_series`` may be any frame with the
    year-to-date series in ``serie_id``; their list or dimension spares a pass
    over their totals.  Nothing runs before the result is asked for, and Spark
    decides by size whether the names are broadcast.  As with NOT IN, a NULL
    among the year-to-date series leaves no series observed at ``freq``.
    """
    published = (flows if ytd_series is None else ytd_series).select("serie_id").distinct()
    wanted = not_in(dim_serie.where(F.col("frecuencia") == freq).select("serie_id"), "serie_id", published)
    observed = observations.join(wanted, "serie_id", "left_semi")
    return flows.select("serie_id", "fecha", F.col("flujo").alias("valor")).unionByName(
        observed.select("serie_id", "fecha", "valor")
    )


def yoy_change(
    df: DataFrame,
    *,
    lag: int = 12,
    digits: int = 2,
    series: str = "serie_id",
    date: str = "fecha",
    value: str = "valor",
    slices: int | str | None = None,
) -> DataFrame:
    """Percent change against the row ``lag`` rows before; NULL if that is NULL or 0.

    Rows are counted, not months: check for gaps first.
    """
    out = with_lookback(
        df,
        lambda w: {"hace_un_anio": F.lag(value, lag).over(w)},
        series=[series],
        order=[date],
        back=lag,
        slices=slices,
    )
    change = (ratio(F.col(value), F.col("hace_un_anio")) - 1) * 100
    return out.withColumn("var_interanual_pc", round_at(change, digits))


def moving_average(
    df: DataFrame,
    *,
    n: int = 3,
    digits: int = 4,
    name: str | None = None,
    series: str = "serie_id",
    date: str = "fecha",
    value: str = "valor",
    slices: int | str | None = None,
) -> DataFrame:
    """Mean of the row and the ``n - 1`` before it, fewer at the start."""
    column = name or f"mm{n}"
    out = with_lookback(
        df,
        lambda w: {column: F.avg(value).over(w.rowsBetween(-(n - 1), Window.currentRow))},
        series=[series],
        order=[date],
        back=n - 1,
        slices=slices,
    )
    return out.withColumn(column, round_at(F.col(column), digits))


def quarter_to_month_broadcast(
    observations: DataFrame, calendar: DataFrame, *, series: str | None = None
) -> DataFrame:
    """Quarterly values on every calendar date of their quarter, at query time.

    The calendar is a row per date; with adaptive execution Spark broadcasts
    it when it measures small.
    """
    quarterly = observations
    if series is not None:
        quarterly = quarterly.where(F.col("serie_id") == series)
    quarterly = quarterly.select("serie_id", F.col("fecha").alias("trimestre"), "valor")
    days = calendar.select("fecha", quarter_start(F.col("fecha")).alias("trimestre"))
    return quarterly.join(days, "trimestre").select("serie_id", "fecha", "valor")


def carried_monthly(
    observations: DataFrame, calendar: DataFrame, *, series: str
) -> DataFrame:
    """All observations, with the quarterly ``series`` shown month by month."""
    rest = observations.where(F.col("serie_id") != series).select("serie_id", "fecha", "valor")
    return rest.unionByName(quarter_to_month_broadcast(observations, calendar, series=series))


def quarterly_means(df: DataFrame, *, decimals: int | None = None) -> DataFrame:
    """Quarterly means, the same in any order of rows; ``decimals`` of the values, if known, makes that cheaper."""
    quarter = quarter_start(F.col("fecha")).alias("fecha")
    if decimals is None:
        means = exact_moments(df.select("serie_id", quarter, "valor"), ["serie_id", "fecha"], "valor")
        return means.select("serie_id", "fecha", F.col("media").alias("valor"))
    return df.groupBy("serie_id", quarter).agg(mean_of(F.col("valor"), decimals).alias("valor"))


def quarterly_from_finest_grain(
    daily: DataFrame, observations: DataFrame, *, decimals: int | None = None
) -> DataFrame:
    """Quarterly means from days where a series has days, else from its own grain.

    Both sides are averaged first; the anti join then sees quarters only.
    """
    from_days = quarterly_means(daily, decimals=decimals)
    from_own = quarterly_means(observations, decimals=decimals).join(
        daily.select("serie_id").distinct(), "serie_id", "left_anti"
    )
    return from_days.unionByName(from_own)


def quarterly_mean_of_means(daily: DataFrame, *, decimals: int | None = None) -> DataFrame:
    """Day to month to quarter: not the same number, kept to show the difference.

    With ``decimals`` the months are rounded to four decimals more.
    """
    month = month_start(F.col("fecha")).alias("fecha")
    months = daily.groupBy("serie_id", month).agg(mean_of(F.col("valor"), decimals).alias("valor"))
    if decimals is None:
        return quarterly_means(months)
    rounded = months.withColumn("valor", round_at(F.col("valor"), decimals + 4))
    return quarterly_means(rounded, decimals=decimals + 4)
