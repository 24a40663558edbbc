"""Registered queries, each with a twin in DuckDB's SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, folder) under its own name."""

    def register(function: Query) -> Query:
        name = function.__name__
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def half(value: str, digits: int) -> str:
    """SQL text of rounding half away from zero on the scaled double."""
    return f"(ROUND(({value}) * 1e{digits}, 0) / 1e{digits})"


def mean(value: str, digits: int) -> str:
    """SQL text of the mean of values of ``digits`` decimals, exact in any row order."""
    return f"(CAST(SUM(CAST({value} AS DECIMAL(18,{digits}))) AS DOUBLE) / COUNT({value}))"


NATION_MONTH = """
    SELECT n_name AS serie_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS valor
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    GROUP BY 1, 2"""

SUPPLIER_MONTH = """
    SELECT CAST(l_suppkey AS VARCHAR) AS serie_id,
           CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha,
           CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS valor
    FROM lineitem GROUP BY 1, 2"""

_BY_PRIORITY = """
    SELECT o_orderpriority AS serie_id, CAST({when} AS DATE) AS fecha,
           CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE){mean} AS valor
    FROM orders GROUP BY 1, 2"""
PRIORITY_MONTH = _BY_PRIORITY.format(when="date_trunc('month', o_orderdate)", mean="")
PRIORITY_QUARTER = _BY_PRIORITY.format(when="date_trunc('quarter', o_orderdate)", mean="")
PRIORITY_DAY = _BY_PRIORITY.format(when="o_orderdate", mean=" / COUNT(o_totalprice)")

CALENDAR = "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha FROM orders"

EVENT_STEPS = "SELECT event_type AS serie_id, ts AS fecha, event_id, value AS valor FROM events"

NATION_SERIES = """
    SELECT n_name AS serie_id, n_name || ' / ' || r_name AS etiqueta,
           CASE n_nationkey % 3 WHEN 0 THEN 'D' WHEN 1 THEN 'M' ELSE 'Q' END AS frecuencia,
           r_name || ' - ' || CAST(n_nationkey AS VARCHAR) AS origen, r_name AS proveedor,
           CASE WHEN n_nationkey <> 7 THEN n_name END AS titulo_original
    FROM nation JOIN region ON n_regionkey = r_regionkey"""

def so_far(panel: str) -> str:
    """SQL text of money added up from the start of the year, by the rows up to each date."""
    return f"""
    SELECT a.serie_id, a.fecha, CAST(SUM(CAST(b.valor AS DECIMAL(18,2))) AS DOUBLE) AS valor
    FROM ({panel}) a JOIN ({panel}) b
      ON b.serie_id = a.serie_id AND YEAR(b.fecha) = YEAR(a.fecha) AND b.fecha <= a.fecha
    GROUP BY a.serie_id, a.fecha"""


def flows_of(totals: str, more: str = "0") -> str:
    """SQL text of totals less the latest earlier total of their year."""
    dated = f"SELECT serie_id, fecha, YEAR(fecha) AS anio, valor FROM ({totals}) t"
    return f"""
    SELECT now.serie_id, CAST(date_trunc('month', now.fecha) AS DATE) AS fecha, now.valor AS acumulado,
           now.valor - COALESCE(earlier.valor, 0) + {more} AS flujo
    FROM ({dated}) now ASOF LEFT JOIN ({dated}) earlier
      ON earlier.serie_id = now.serie_id AND earlier.anio = now.anio AND now.fecha > earlier.fecha"""


# Nations as totals of the year so far, dated at month end.
YTD_RAW = f"SELECT serie_id, last_day(fecha) AS fecha, valor FROM ({so_far(NATION_MONTH)}) n"

FLOWS = flows_of(YTD_RAW)


def ranked(panel: str, order: str = "fecha") -> str:
    return f"SELECT *, ROW_NUMBER() OVER (PARTITION BY serie_id ORDER BY {order}) AS k FROM ({panel}) p"


def three_month_mean(panel: str) -> str:
    """SQL text of a panel of money with the mean of up to three rows, by a join on ranks."""
    mean3 = half("CAST(SUM(CAST(b.valor AS DECIMAL(18,2))) AS DOUBLE) / COUNT(b.valor)", 4)
    return f"""
    SELECT a.serie_id, a.fecha, ANY_VALUE(a.valor) AS valor, {mean3} AS mm3
    FROM ({ranked(panel)}) a JOIN ({ranked(panel)}) b ON b.serie_id = a.serie_id AND b.k BETWEEN a.k - 2 AND a.k
    GROUP BY a.serie_id, a.fecha"""


def a_year_before(panel: str) -> str:
    """SQL text of a panel with the value twelve ranks lower."""
    return f"""
    SELECT a.serie_id, a.fecha, a.valor, b.valor AS hace_un_anio
    FROM ({ranked(panel)}) a LEFT JOIN ({ranked(panel)}) b ON b.serie_id = a.serie_id AND b.k = a.k - 12"""
