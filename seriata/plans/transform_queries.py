"""Queries over the transforms, the reshaping and the profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriata.functions.dates import month_start
from seriata.functions.numbers import round_at
from seriata.operators import profiles, reshape, staging
from seriata.operators import transforms as tr
from seriata.plans import panels
from seriata.plans.registry import (
    CALENDAR,
    FLOWS,
    NATION_MONTH,
    NATION_SERIES,
    PRIORITY_DAY,
    PRIORITY_MONTH,
    PRIORITY_QUARTER,
    SUPPLIER_MONTH,
    YTD_RAW,
    a_year_before,
    flows_of,
    half,
    mean,
    query,
    three_month_mean,
)


def _even(name: str = "serie_id"):
    """Every second nation: the ones held as year-to-date totals."""
    return F.split_part(name, F.lit("_"), F.lit(2)).cast("int") % 2 == 0


_EVEN = "CAST(split_part(serie_id, '_', 2) AS INT) % 2 = 0"


@query(FLOWS)
def deaccumulate_ytd(spark, folder):
    return tr.deaccumulate_ytd(panels.ytd_raw(spark, folder))


@query(YTD_RAW)
def accumulate_ytd(spark, folder):
    return panels.ytd_raw(spark, folder)


@query(flows_of(f"SELECT serie_id, CAST(date_trunc('month', fecha) AS DATE) AS fecha, valor FROM ({YTD_RAW}) y"))
def staged_deaccumulated(spark, folder):
    staged = staging.stage_ytd(panels.ytd_raw(spark, folder))
    return tr.deaccumulate_ytd(staged, value="acumulado")


@query("""
    SELECT CAST(o_orderkey AS VARCHAR) AS serie_id, CAST(o_orderdate AS DATE) AS fecha,
           CAST(o_totalprice AS DOUBLE) AS valor FROM orders""")
def staging_casts(spark, folder):
    orders = panels.table(spark, folder, "orders")
    return staging.staging(
        orders,
        {"o_orderkey": "string", "o_orderdate": "date", "o_totalprice": "double"},
        {"o_orderkey": "serie_id", "o_orderdate": "fecha", "o_totalprice": "valor"},
    )


@query(f"""
    SELECT serie_id, fecha, flujo AS valor FROM ({FLOWS}) f WHERE {_EVEN}
    UNION ALL
    SELECT serie_id, fecha, valor FROM ({NATION_MONTH}) n
    WHERE NOT ({_EVEN}) AND EXISTS (
        SELECT 1 FROM ({NATION_SERIES}) s WHERE s.serie_id = n.serie_id AND s.frecuencia = 'M')""")
def unified_monthly(spark, folder):
    observed = panels.nation_month(spark, folder)
    raw = panels.as_ytd(observed.where(_even()))
    dim = reshape.build_dim_serie(panels.nation_metadata(spark, folder))
    return tr.unified_monthly(tr.deaccumulate_ytd(raw), observed, dim, ytd_series=raw)


_YOY = f"""
    SELECT *, {half("(valor / NULLIF(hace_un_anio, 0) - 1) * 100", 2)} AS var_interanual_pc
    FROM ({a_year_before(SUPPLIER_MONTH)}) y"""


@query(_YOY)
def yoy_change(spark, folder):
    return tr.yoy_change(panels.supplier_month(spark, folder))


@query(three_month_mean(SUPPLIER_MONTH))
def moving_average_3(spark, folder):
    return tr.moving_average(panels.supplier_month(spark, folder))


@query(f"""
    SELECT y.*, m.mm3 FROM ({_YOY}) y
    JOIN ({three_month_mean(SUPPLIER_MONTH)}) m USING (serie_id, fecha)""")
def yoy_and_average(spark, folder):
    """Both windows over one exchange and one sort."""
    return tr.moving_average(tr.yoy_change(panels.supplier_month(spark, folder)))


@query(f"""
    SELECT q.serie_id, c.fecha, q.valor FROM ({CALENDAR}) c
    JOIN ({PRIORITY_QUARTER}) q ON q.fecha = CAST(date_trunc('quarter', c.fecha) AS DATE)""")
def quarter_broadcast(spark, folder):
    quarterly = panels.priority_quarter(spark, folder)
    return tr.quarter_to_month_broadcast(quarterly, panels.order_calendar(spark, folder))


_CARRIED = "'1-URGENT'"


@query(f"""
    WITH obs AS (SELECT * FROM ({PRIORITY_MONTH}) m WHERE serie_id <> {_CARRIED}
                 UNION ALL SELECT * FROM ({PRIORITY_QUARTER}) q WHERE serie_id = {_CARRIED})
    SELECT serie_id, fecha, valor FROM obs WHERE serie_id <> {_CARRIED}
    UNION ALL
    SELECT o.serie_id, c.fecha, o.valor FROM ({CALENDAR}) c
    JOIN obs o ON o.serie_id = {_CARRIED} AND o.fecha = CAST(date_trunc('quarter', c.fecha) AS DATE)""")
def carried_monthly(spark, folder):
    carried = F.col("serie_id") == "1-URGENT"
    monthly = panels.priority_month(spark, folder).where(~carried)
    quarterly = panels.priority_quarter(spark, folder).where(carried)
    calendar = panels.order_calendar(spark, folder)
    return tr.carried_monthly(monthly.unionByName(quarterly), calendar, series="1-URGENT")


_IS_DAILY = "serie_id IN ('1-URGENT', '2-HIGH')"
_QUARTER = "CAST(date_trunc('quarter', fecha) AS DATE)"


# Published days have two decimals; their means are then exact in any row order.
_DAYS = f"SELECT serie_id, fecha, {half('valor', 2)} AS valor FROM ({PRIORITY_DAY}) d"


def _days(spark, folder):
    days = panels.priority_day(spark, folder)
    return days.withColumn("valor", round_at(F.col("valor"), 2))


@query(f"""
    WITH daily AS (SELECT * FROM ({_DAYS}) d WHERE {_IS_DAILY}),
    obs AS ({PRIORITY_MONTH})
    SELECT serie_id, {_QUARTER} AS fecha, {mean("valor", 2)} AS valor FROM daily GROUP BY 1, 2
    UNION ALL
    SELECT serie_id, {_QUARTER} AS fecha, {mean("valor", 2)} AS valor FROM obs
    WHERE serie_id NOT IN (SELECT DISTINCT serie_id FROM daily) GROUP BY 1, 2""")
def quarterly_from_daily(spark, folder):
    daily = _days(spark, folder).where(F.col("serie_id").isin("1-URGENT", "2-HIGH"))
    monthly = panels.priority_month(spark, folder)
    return tr.quarterly_from_finest_grain(daily, monthly, decimals=2)


@query(f"""
    WITH daily AS ({_DAYS}),
    once AS (SELECT serie_id, {_QUARTER} AS fecha, {mean("valor", 2)} AS v FROM daily GROUP BY 1, 2),
    months AS (SELECT serie_id, CAST(date_trunc('month', fecha) AS DATE) AS fecha,
                      {half(mean("valor", 2), 6)} AS valor FROM daily GROUP BY 1, 2),
    twice AS (SELECT serie_id, {_QUARTER} AS fecha, {mean("valor", 6)} AS v FROM months GROUP BY 1, 2)
    SELECT serie_id, fecha, once.v AS una_vez, twice.v AS dos_veces
    FROM once JOIN twice USING (serie_id, fecha)""")
def avg_of_avg_gap(spark, folder):
    """Day to quarter against day to month to quarter: the numbers differ."""
    daily = _days(spark, folder)
    once = tr.quarterly_means(daily, decimals=2).withColumnRenamed("valor", "una_vez")
    twice = tr.quarterly_mean_of_means(daily, decimals=2).withColumnRenamed("valor", "dos_veces")
    return once.join(twice, ["serie_id", "fecha"])


# ---------------------------------------------------------------- reshaping


def _wide(spark, folder, panel):
    return panel.groupBy("fecha").pivot("serie_id", panels.priorities(spark, folder)).agg(F.max("valor"))


def _monthly_wide(spark, folder):
    """The monthly panel with one empty cell."""
    gap = panels.is_month(1996, 5)
    wide = _wide(spark, folder, panels.priority_month(spark, folder))
    return wide.withColumn("3-MEDIUM", F.when(~gap, F.col("3-MEDIUM")))


_GRID = f"""
    SELECT s.serie_id, c.fecha,
           CASE WHEN s.serie_id = '3-MEDIUM' AND c.fecha = DATE '1996-05-01' THEN NULL ELSE m.valor END AS valor
    FROM (SELECT DISTINCT o_orderpriority AS serie_id FROM orders) s
    CROSS JOIN (SELECT DISTINCT fecha FROM ({PRIORITY_MONTH}) p) c
    LEFT JOIN ({PRIORITY_MONTH}) m ON m.serie_id = s.serie_id AND m.fecha = c.fecha"""


@query(_GRID)
def melt_panel(spark, folder):
    return reshape.melt_panel(_monthly_wide(spark, folder))


_QUARTER_GRID = f"""
    SELECT s.serie_id, c.fecha, m.valor
    FROM (SELECT DISTINCT o_orderpriority AS serie_id FROM orders) s
    CROSS JOIN (SELECT DISTINCT fecha FROM ({PRIORITY_QUARTER}) p) c
    LEFT JOIN ({PRIORITY_QUARTER}) m ON m.serie_id = s.serie_id AND m.fecha = c.fecha"""


def _priority_dim(spark, folder):
    """Frequencies of the priorities; the last one is not declared."""
    names = panels.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("serie_id"))
    urgent = F.col("serie_id").isin("1-URGENT", "2-HIGH")
    return names.where(F.col("serie_id") != "5-LOW").distinct().select(
        "serie_id", F.when(urgent, "Q").otherwise("M").alias("frecuencia")
    )


_ROUTES = {"routes": {"trimestral": "Q"}, "otherwise": "mensual"}
_ROUTED = f"""
    SELECT {{extra}}serie_id, fecha, valor FROM ({_QUARTER_GRID}) q WHERE {_IS_DAILY}
    UNION ALL
    SELECT {{other}}serie_id, fecha, valor FROM ({_GRID}) g WHERE NOT {_IS_DAILY}"""


@query(_ROUTED.format(extra="", other=""))
def wide_to_long(spark, folder):
    return reshape.wide_to_long(
        {
            "mensual": _monthly_wide(spark, folder),
            "trimestral": _wide(spark, folder, panels.priority_quarter(spark, folder)),
        },
        _priority_dim(spark, folder),
        **_ROUTES,
    )


@query(_ROUTED.format(extra="'trimestral' AS archivo, ", other="'mensual' AS archivo, "))
def route_by_frequency(spark, folder):
    parts = {
        "mensual": _monthly_wide(spark, folder),
        "trimestral": _wide(spark, folder, panels.priority_quarter(spark, folder)),
    }
    tagged = [reshape.melt_panel(p).withColumn("archivo", F.lit(t)) for t, p in parts.items()]
    return reshape.route_by_frequency(
        reshape.concat(tagged), _priority_dim(spark, folder), **_ROUTES
    )


@query("""
    SELECT o_custkey, fecha, o_totalprice FROM (
        SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha, o_totalprice,
               ROW_NUMBER() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate)
                                  ORDER BY o_orderkey) AS n
        FROM orders) o WHERE n = 1""")
def dedup_first(spark, folder):
    orders = panels.table(spark, folder, "orders").select(
        "o_custkey", month_start("o_orderdate").alias("fecha"), "o_orderkey", "o_totalprice"
    )
    return reshape.dedup_first(orders, ["o_custkey", "fecha"], ["o_orderkey"])


@query(NATION_SERIES)
def dim_serie(spark, folder):
    return reshape.build_dim_serie(panels.nation_metadata(spark, folder))


@query(f"""
    SELECT fecha, CAST(YEAR(fecha) AS SMALLINT) AS anio, CAST(QUARTER(fecha) AS TINYINT) AS trimestre,
           CAST(MONTH(fecha) AS TINYINT) AS mes, MONTH(fecha) = 12 AS fin_de_anio
    FROM ({CALENDAR}) c""")
def dim_fecha(spark, folder):
    orders = panels.table(spark, folder, "orders")
    return reshape.build_dim_fecha(orders.select(month_start("o_orderdate").alias("fecha")))


# ---------------------------------------------------------------- profiles

_AFRICA_GONE = "proveedor <> 'AFRICA'"
_SOME_NULL = "CASE WHEN fecha <> DATE '1997-03-01' THEN valor END AS valor"


@query(f"""
    SELECT s.serie_id, s.frecuencia AS frec, COUNT(p.valor) AS obs, MIN(p.fecha) AS desde,
           MAX(p.fecha) AS hasta, COUNT(*) FILTER (WHERE p.valor IS NULL) AS nulos
    FROM ({NATION_SERIES}) s
    LEFT JOIN (SELECT serie_id, fecha, {_SOME_NULL} FROM ({NATION_MONTH}) n) p
           ON p.serie_id = s.serie_id AND s.{_AFRICA_GONE}
    GROUP BY ALL""")
def series_profile(spark, folder):
    """Some NULLs, and the series of one region without any row."""
    dim = reshape.build_dim_serie(panels.nation_metadata(spark, folder))
    kept = dim.where("proveedor <> 'AFRICA'").select("serie_id")
    observed = panels.nation_month(spark, folder).join(kept, "serie_id", "left_semi")
    holed = observed.withColumn("valor", F.when(~panels.is_month(1997, 3), F.col("valor")))
    return profiles.series_profile(dim, holed)


@query(f"""
    SELECT serie_id, COUNT(*) AS obs, MIN(fecha) AS desde, MAX(fecha) AS hasta
    FROM ({PRIORITY_DAY}) d GROUP BY 1""")
def daily_profile(spark, folder):
    return profiles.daily_profile(panels.priority_day(spark, folder))


@query(f"""
    SELECT serie_id, COUNT(*) AS obs, MIN(fecha) AS desde, MAX(fecha) AS hasta,
           {half("MIN(valor)", 1)} AS min, {half("MAX(valor)", 1)} AS max
    FROM ({YTD_RAW}) y GROUP BY 1""")
def ytd_profile(spark, folder):
    return profiles.ytd_profile(panels.ytd_raw(spark, folder))


@query(f"""
    SELECT CAST(MONTH(fecha) AS INT) AS mes, {half("valor", 1)} AS acumulado FROM ({YTD_RAW}) y
    WHERE serie_id = 'NATION_4' AND YEAR(fecha) = 1998 ORDER BY 1 LIMIT 4""")
def ytd_peek(spark, folder):
    return profiles.ytd_peek(panels.ytd_raw(spark, folder), "NATION_4", 1998)
