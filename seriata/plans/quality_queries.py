"""Queries over the checks, the constraints and the reconciliation."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from seriata.functions.dates import month_start
from seriata.functions.numbers import round_at
from seriata.operators import constraints, fingerprint, quality, reconcile, reshape
from seriata.operators import transforms as tr
from seriata.operators.anti import not_in
from seriata.plans import panels
from seriata.plans.registry import (
    EVENT_STEPS,
    FLOWS,
    NATION_MONTH,
    NATION_SERIES,
    SUPPLIER_MONTH,
    flows_of,
    half,
    query,
    ranked,
    so_far,
)
from seriata.session import new_folder
from seriata.plans.warehouse import (
    Files,
    Warehouse,
    build_warehouse,
    load_star,
    reconcile_panels,
    verify,
)
from seriata.sources import tables
from seriata.sources.delimited import read_panel


def _checked(check: str, severity: str, detail: str, fecha: str = "fecha") -> str:
    return (
        f"SELECT '{check}' AS chequeo, '{severity}' AS severidad, serie_id, "
        f"CAST({fecha} AS DATE) AS fecha, {detail} AS detalle"
    )


def _gaps(panel: str, step: str = "MONTH") -> str:
    return f"""(
        SELECT serie_id, CAST(due AS DATE) AS fecha FROM (
            SELECT serie_id, UNNEST(generate_series(first_seen, last_seen, INTERVAL 1 {step})) AS due FROM (
                SELECT serie_id, MIN(fecha) AS first_seen, MAX(fecha) AS last_seen
                FROM ({panel}) p GROUP BY ALL) ends) calendar
        EXCEPT SELECT serie_id, fecha FROM ({panel}) seen) g"""


def _stale(panel: str) -> str:
    return f"""(
        SELECT serie_id, MAX(fecha) AS ultima_fecha, (SELECT MAX(fecha) FROM ({panel}) q) AS tope
        FROM ({panel}) p GROUP BY serie_id
        HAVING MAX(fecha) < (SELECT MAX(fecha) FROM ({panel}) q)) t"""


def jumps(panel: str, sigmas: int, order: str = "fecha") -> str:
    """Changes by a join on ranks, by how many deviations they are off; DuckDB's own mean and deviation."""
    return f"""(
        WITH r AS ({ranked(panel, order)}),
        steps AS (SELECT now.*, now.valor - before.valor AS cambio
                  FROM r now LEFT JOIN r before ON before.serie_id = now.serie_id AND before.k = now.k - 1),
        typical AS (SELECT serie_id, AVG(cambio) AS mean, STDDEV_SAMP(cambio) AS deviation FROM steps GROUP BY serie_id)
        SELECT steps.* EXCLUDE (k), ABS(cambio - mean) / deviation AS desviaciones
        FROM steps JOIN typical USING (serie_id) WHERE deviation > 0 AND ABS(cambio - mean) / deviation > {sigmas}) j"""


_JUMP_TEXT = (
    f"'cambio ' || {half('cambio', 2)} || ' = ' || {half('desviaciones', 1)} || ' desviaciones'"
)

# The December 1997 flow of one supplier is off by one and a half.
_OFF = "serie_id = '7' AND YEAR(fecha) = 1997 AND MONTH(fecha) = 12"
_SUPPLIER_FLOWS = f"""SELECT serie_id, fecha, acumulado, flujo + CASE WHEN {_OFF} THEN 1.5 ELSE 0 END AS flujo
    FROM ({flows_of(so_far(SUPPLIER_MONTH))}) f"""
_MISMATCHES = """(
    SELECT f.serie_id, CAST(YEAR(f.fecha) AS INT) AS anio, SUM(f.flujo) AS suma_flujos,
           ANY_VALUE(d.acumulado) AS acumulado_diciembre, ABS(SUM(f.flujo) - ANY_VALUE(d.acumulado)) AS diferencia
    FROM ({flows}) f JOIN ({flows}) d ON d.serie_id = f.serie_id AND d.fecha = make_date(CAST(YEAR(f.fecha) AS INT), 12, 1)
    GROUP BY f.serie_id, YEAR(f.fecha)
    HAVING ABS(SUM(f.flujo) - ANY_VALUE(d.acumulado)) > 1e-6) x"""

_MISMATCH_TEXT = (
    f"'suma de flujos ' || {half('suma_flujos', 2)} || "
    f"' != acumulado de diciembre ' || {half('acumulado_diciembre', 2)}"
)


def _supplier_flows(spark, folder):
    return _with_one_off(tr.deaccumulate_ytd(panels.as_ytd(panels.supplier_month(spark, folder))))


def _with_one_off(flows):
    off = (F.col("serie_id") == "7") & panels.is_month(1997, 12)
    return flows.withColumn("flujo", F.col("flujo") + F.when(off, 1.5).otherwise(0.0))


# ---------------------------------------------------------------- checks


@query(f"""{_checked("hueco en la serie", "error", "'no hay observacion para este mes'")}
    FROM {_gaps(SUPPLIER_MONTH)}""")
def check_gaps(spark, folder):
    return quality.check_gaps(panels.supplier_month(spark, folder))


_USER_DAY = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS serie_id, CAST(ts AS DATE) AS fecha FROM events"


@query(f"SELECT serie_id, fecha FROM {_gaps(_USER_DAY, 'DAY')}")
def gaps_by_day(spark, folder):
    """Event rows straight in: days are told apart before the window."""
    events = panels.table(spark, folder, "events")
    seen = events.select(F.col("user_id").cast("string").alias("serie_id"), F.col("ts").alias("fecha"))
    return quality.find_gaps(seen, "day")


_CUSTOMER_MONTH = """
    SELECT CAST(o_custkey AS VARCHAR) AS serie_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS fecha
    FROM orders"""


def _customer_month(spark, folder):
    return panels.table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("serie_id"), month_start("o_orderdate").alias("fecha")
    )


_DUPLICATES = f"""(SELECT serie_id, fecha, COUNT(*) AS veces FROM ({_CUSTOMER_MONTH}) c
                   GROUP BY 1, 2 HAVING COUNT(*) > 1) d"""


@query(f"""{_checked("duplicado", "error", "'aparece ' || veces || ' veces'")} FROM {_DUPLICATES}""")
def check_duplicates(spark, folder):
    return quality.check_duplicates(_customer_month(spark, folder))


@query(f"SELECT serie_id, fecha, veces FROM {_DUPLICATES}")
def find_duplicates(spark, folder):
    return quality.find_duplicates(_customer_month(spark, folder))


@query(f"""{_checked("valor nulo", "error", "'valor NULL'")}
    FROM ({SUPPLIER_MONTH}) p WHERE fecha = DATE '1997-05-01'""")
def check_nulls(spark, folder):
    panel = panels.supplier_month(spark, folder)
    return quality.check_nulls(
        panel.withColumn("valor", F.when(~panels.is_month(1997, 5), F.col("valor")))
    )


@query(f"""{_checked("serie huerfana", "error", "'la serie no existe en dim_serie'")}
    FROM ({NATION_MONTH}) n WHERE serie_id NOT IN
        (SELECT serie_id FROM ({NATION_SERIES}) s WHERE proveedor <> 'ASIA')""")
def check_orphans(spark, folder):
    dim = reshape.build_dim_serie(panels.nation_metadata(spark, folder))
    return quality.check_orphans(panels.nation_month(spark, folder), dim.where("proveedor <> 'ASIA'"))


@query(f"""{_checked("salto improbable", "aviso", _JUMP_TEXT)}
    FROM {jumps(EVENT_STEPS, 5, "fecha, event_id")}""")
def check_jumps(spark, folder):
    """Five series share all events: cut into slices once they are too long."""
    steps = panels.event_steps(spark, folder)
    return quality.check_jumps(steps, order=("fecha", "event_id"), slices="auto")


@query(f"""SELECT serie_id, fecha, event_id, {half("cambio", 6)} AS cambio
    FROM {jumps(EVENT_STEPS, 4, "fecha, event_id")}""")
def jumps_4_sigma(spark, folder):
    steps = panels.event_steps(spark, folder)
    found = quality.find_jumps(steps, sigmas=4, order=("fecha", "event_id"), slices="auto")
    return found.select("serie_id", "fecha", "event_id", round_at(F.col("cambio"), 6).alias("cambio"))


@query(f"""SELECT * EXCLUDE (desviaciones), {half("desviaciones", 6)} AS desviaciones
    FROM {jumps(EVENT_STEPS, 4, 'fecha, event_id')}""")
def jumps_sliced(spark, folder):
    """All columns, with every series cut into slices; deviations to six decimals, as far as DuckDB's own are good."""
    steps = panels.event_steps(spark, folder)
    found = quality.find_jumps(steps, sigmas=4, order=("fecha", "event_id"), slices=7)
    return found.withColumn("desviaciones", round_at(F.col("desviaciones"), 6))


@query(f"""{_checked("salto improbable", "aviso", _JUMP_TEXT)} FROM {jumps(SUPPLIER_MONTH, 3)}""")
def panel_jumps(spark, folder):
    return quality.check_jumps(panels.supplier_month(spark, folder), sigmas=3)


@query(f"""{_checked("descuadre de desacumulacion", "error", _MISMATCH_TEXT, "make_date(anio, 12, 1)")}
    FROM {_MISMATCHES.format(flows=_SUPPLIER_FLOWS)}""")
def check_ytd_reconciles(spark, folder):
    return quality.check_ytd_reconciles(_supplier_flows(spark, folder))


@query(f"""SELECT serie_id, anio, {half("suma_flujos", 4)} AS suma_flujos, acumulado_diciembre,
                  {half("diferencia", 4)} AS diferencia
    FROM {_MISMATCHES.format(flows=_SUPPLIER_FLOWS)}""")
def ytd_mismatches(spark, folder):
    found = quality.find_ytd_mismatches(_supplier_flows(spark, folder))
    return found.withColumns({c: round_at(F.col(c), 4) for c in ("suma_flujos", "diferencia")})


@query(f"""{_checked("serie desactualizada", "aviso", "'termina antes que el resto del panel'", "ultima_fecha")}
    FROM {_stale(SUPPLIER_MONTH)}""")
def check_stale(spark, folder):
    return quality.check_stale(panels.supplier_month(spark, folder))


@query(f"SELECT serie_id, ultima_fecha, tope FROM {_stale(SUPPLIER_MONTH)}")
def stale_series(spark, folder):
    return quality.find_stale(panels.supplier_month(spark, folder))


# One panel with every defect: a gap, a doubled month, a NULL, undeclared series, a flow that is off.
_DIM_OF_SUPPLIERS = """
    SELECT CAST(s_suppkey AS VARCHAR) AS serie_id FROM supplier WHERE s_suppkey % 10 <> 9"""
_SICK = f"""
    SELECT serie_id, fecha, CASE WHEN serie_id = '5' AND fecha = DATE '1997-02-01' THEN NULL
                                 WHEN serie_id = '6' AND fecha = DATE '1999-08-01' THEN valor * 50
                                 ELSE valor END AS valor
    FROM ({SUPPLIER_MONTH}) p WHERE NOT (serie_id = '3' AND fecha = DATE '1998-04-01')
    UNION ALL SELECT serie_id, fecha, valor FROM ({SUPPLIER_MONTH}) p
    WHERE serie_id = '4' AND fecha = DATE '1998-04-01'"""
_REPORT = f"""
    {_checked("hueco en la serie", "error", "'no hay observacion para este mes'")} FROM {_gaps(_SICK)}
    UNION ALL {_checked("duplicado", "error", "'aparece ' || veces || ' veces'")}
    FROM (SELECT serie_id, fecha, COUNT(*) AS veces FROM ({_SICK}) c GROUP BY 1, 2 HAVING COUNT(*) > 1) d
    UNION ALL {_checked("valor nulo", "error", "'valor NULL'")} FROM ({_SICK}) n WHERE valor IS NULL
    UNION ALL {_checked("serie huerfana", "error", "'la serie no existe en dim_serie'")}
    FROM ({_SICK}) o WHERE serie_id NOT IN ({_DIM_OF_SUPPLIERS})
    UNION ALL {_checked("salto improbable", "aviso", _JUMP_TEXT)} FROM {jumps(_SICK, 5, "fecha, valor")}
    UNION ALL {_checked("descuadre de desacumulacion", "error", _MISMATCH_TEXT, "make_date(anio, 12, 1)")}
    FROM {_MISMATCHES.format(flows=_SUPPLIER_FLOWS)}
    UNION ALL {_checked("serie desactualizada", "aviso", "'termina antes que el resto del panel'", "ultima_fecha")}
    FROM {_stale(_SICK)}"""


def _sick_plan(spark, folder):
    panel = panels.published(panels.supplier_month(spark, folder))

    def cell(series, year, month):
        return (F.col("serie_id") == series) & panels.is_month(year, month)

    spoiled = (
        F.when(cell("5", 1997, 2), F.lit(None))
        .when(cell("6", 1999, 8), F.col("valor") * 50)
        .otherwise(F.col("valor"))
    )
    sick = (
        panel.where(~cell("3", 1998, 4))
        .withColumn("valor", spoiled)
        .unionByName(panel.where(cell("4", 1998, 4)))
    )
    dim = panels.table(spark, folder, "supplier").where(F.col("s_suppkey") % 10 != 9)
    return quality.quality_report(
        sick,
        fact=sick,
        dim_serie=dim.select(F.col("s_suppkey").cast("string").alias("serie_id")),
        flows=_with_one_off(tr.deaccumulate_ytd(panels.as_ytd(panel))),
    )


def _sick_report(spark, folder):
    return panels.published(_sick_plan(spark, folder))


@query(_REPORT)
def quality_report(spark, folder):
    return _sick_report(spark, folder)


@query(f"SELECT severidad, COUNT(*) AS filas FROM ({_REPORT}) r GROUP BY 1")
def severity_counts(spark, folder):
    return quality.severity_counts(_sick_report(spark, folder))


@query(f"SELECT severidad, COUNT(*) AS filas FROM ({_REPORT}) r GROUP BY 1")
def counted_report(spark, folder):
    """The report's errors and warnings, counted by the job that writes it."""
    seen = Observation()
    tables.publish(
        _sick_plan(spark, folder), layer="marts", path=new_folder(spark), observe=(seen, quality.report_counts())
    )
    counts = [(s, seen.get[s]) for s in (quality.ERROR, quality.WARNING) if seen.get[s]]
    return spark.createDataFrame(counts, "severidad string, filas bigint")


# ---------------------------------------------------------------- constraints


@query("""
    SELECT l_orderkey, l_linenumber, COUNT(*) AS veces FROM lineitem
    WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def unique_failures(spark, folder):
    return constraints.unique(panels.table(spark, folder, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority
    FROM orders WHERE o_orderstatus = 'P'""")
def not_null_failures(spark, folder):
    orders = panels.table(spark, folder, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority")
    )
    return constraints.not_null(orders, "o_orderkey", "o_orderpriority")


@query("""
    SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'MACHINERY')""")
def relationship_failures(spark, folder):
    customers = panels.table(spark, folder, "customer").where("c_mktsegment <> 'MACHINERY'")
    orders = panels.table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return constraints.relationships(orders, "o_custkey", customers, "c_custkey")


_OPEN_ORDERS = "SELECT CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey, o_orderpriority FROM orders"
_NOT_IN_LISTS = {
    "con NULL": f"SELECT o_custkey FROM ({_OPEN_ORDERS}) l WHERE o_orderpriority = '1-URGENT'",
    "sin NULL": f"SELECT o_custkey FROM ({_OPEN_ORDERS}) l WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL",
    "vacia": f"SELECT o_custkey FROM ({_OPEN_ORDERS}) l WHERE o_orderpriority = 'NINGUNA'",
}


@query(" UNION ALL ".join(f"""SELECT '{name}' AS lista, o_custkey, COUNT(*) AS filas
    FROM ({_OPEN_ORDERS}) o WHERE o_custkey NOT IN ({listed}) GROUP BY o_custkey""" for name, listed in _NOT_IN_LISTS.items()))
def not_in_lists(spark, folder):
    """Orders, some without a customer, whose customer is not in a list: with a NULL in it, without, and empty."""
    orders = panels.table(spark, folder, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"), "o_orderpriority"
    )
    urgent = orders.where("o_orderpriority = '1-URGENT'")
    lists = (urgent, urgent.where("o_custkey IS NOT NULL"), orders.where("o_orderpriority = 'NINGUNA'"))
    return reshape.concat(
        [
            not_in(orders, "o_custkey", listed).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("filas")).select(
                F.lit(name).alias("lista"), "o_custkey", "filas"
            )
            for name, listed in zip(_NOT_IN_LISTS, lists)
        ]
    )


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD')")
def accepted_values_failures(spark, folder):
    parts = panels.table(spark, folder, "part").select("p_partkey", "p_type")
    return constraints.accepted_values(parts, "p_type", ["ECONOMY", "STANDARD"])


@query("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 45")
def range_failures(spark, folder):
    parts = panels.table(spark, folder, "part").select("p_partkey", "p_size")
    return constraints.in_range(parts, "p_size", 5, 45)


# ---------------------------------------------------------------- reconciliation

_COPY = f"""
    SELECT serie_id, fecha,
           CASE WHEN CAST(serie_id AS INT) % 11 = 0 AND fecha = DATE '1997-05-01' THEN valor + 0.5
                WHEN CAST(serie_id AS INT) % 13 = 0 AND fecha = DATE '1998-02-01' THEN NULL
                ELSE valor END AS valor
    FROM ({SUPPLIER_MONTH}) p
    WHERE NOT (CAST(serie_id AS INT) % 7 = 0 AND fecha = DATE '1996-03-01')
      AND CAST(serie_id AS INT) % 50 <> 0"""


def _copy(panel):
    """The panel with changed, emptied and missing cells, and some series gone."""
    number = F.col("serie_id").cast("int")
    changed = (
        F.when((number % 11 == 0) & panels.is_month(1997, 5), F.col("valor") + 0.5)
        .when((number % 13 == 0) & panels.is_month(1998, 2), F.lit(None))
        .otherwise(F.col("valor"))
    )
    kept = ~((number % 7 == 0) & panels.is_month(1996, 3)) & (number % 50 != 0)
    return panel.where(kept).withColumn("valor", changed)


_PAIRED = f"""
    SELECT COALESCE(e.serie_id, a.serie_id) AS serie_id, e.fecha AS fe, a.fecha AS fa,
           e.valor AS ve, a.valor AS va
    FROM ({SUPPLIER_MONTH}) e FULL OUTER JOIN ({_COPY}) a ON e.serie_id = a.serie_id AND e.fecha = a.fecha"""


@query(f"""
    SELECT serie_id, dif, filas, sin_pareja, nulos_de_un_lado,
           sin_pareja = 0 AND COALESCE(dif <= 1e-9, FALSE) AS ok
    FROM (SELECT serie_id, MAX(ABS(ve - va)) AS dif, COUNT(*) AS filas,
                 COUNT(*) FILTER (WHERE fe IS NULL OR fa IS NULL) AS sin_pareja,
                 COUNT(*) FILTER (WHERE fe IS NOT NULL AND fa IS NOT NULL
                                  AND (ve IS NULL) <> (va IS NULL)) AS nulos_de_un_lado, COUNT(fa) AS n
          FROM ({_PAIRED}) p GROUP BY 1) s WHERE n > 0""")
def reconcile_full(spark, folder):
    panel = panels.supplier_month(spark, folder)
    return reconcile.reconcile(panel, _copy(panel))


@query(f"""
    SELECT serie_id, dif, n, COALESCE(dif <= 1e-8, FALSE) AND n = due AS ok
    FROM (SELECT serie_id, MAX(ABS(ve - va)) AS dif, COUNT(fe) AS due,
                 COUNT(*) FILTER (WHERE fe IS NOT NULL AND fa IS NOT NULL) AS n
          FROM ({_PAIRED}) p GROUP BY 1) s""")
def reconcile_inner(spark, folder):
    panel = panels.supplier_month(spark, folder)
    return reconcile.reconcile_inner(panel, _copy(panel))


@query(f"""
    SELECT *, 'izquierda' AS solo_en FROM (SELECT * FROM ({SUPPLIER_MONTH}) l EXCEPT SELECT * FROM ({_COPY}) r) x
    UNION ALL
    SELECT *, 'derecha' AS solo_en FROM (SELECT * FROM ({_COPY}) l EXCEPT SELECT * FROM ({SUPPLIER_MONTH}) r) y""")
def relations_difference(spark, folder):
    panel = panels.supplier_month(spark, folder)
    return reconcile.relations_difference(panel, _copy(panel))


@query("""
    SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
           CAST(9007199254740992 + l_orderkey AS VARCHAR) AS grande, COUNT(*) AS izquierda, 1 AS derecha
    FROM lineitem GROUP BY 1, 2, 3 HAVING COUNT(*) <> 1""")
def results_difference(spark, folder):
    """Rows against their distinct rows: what is left over are the copies."""
    keys = panels.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_orderkey") + 9007199254740992).alias("grande")
    )
    return reconcile.results_difference(keys, keys.distinct())


_LINES = "SELECT l_orderkey, l_linenumber, l_extendedprice AS precio FROM lineitem"
_LINES_COPY = f"""
    SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1009 = 3 THEN precio + 0.25 ELSE precio END AS precio
    FROM ({_LINES}) c WHERE l_orderkey % 997 <> 5
    UNION ALL SELECT * FROM ({_LINES}) d WHERE l_orderkey % 1013 = 7"""


@query(f"""
    SELECT l_orderkey, l_linenumber, precio, CAST(SUM(i) AS BIGINT) AS izquierda, CAST(SUM(d) AS BIGINT) AS derecha
    FROM (SELECT *, 1 AS i, 0 AS d FROM ({_LINES}) l UNION ALL SELECT *, 0, 1 FROM ({_LINES_COPY}) r) b
    GROUP BY ALL HAVING SUM(i) <> SUM(d)""")
def multiset_difference(spark, folder):
    """Order lines against a copy with rows lost, changed and doubled, found by sums of hashes per range."""
    lines = panels.table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("precio"))
    price = F.when(F.col("l_orderkey") % 1009 == 3, F.col("precio") + 0.25).otherwise(F.col("precio"))
    copy = lines.where("l_orderkey % 997 <> 5").withColumn("precio", price)
    copy = copy.unionByName(lines.where("l_orderkey % 1013 = 7")).select("precio", "l_linenumber", "l_orderkey")
    return fingerprint.multiset_difference(lines, copy)


# ---------------------------------------------------------------- end to end

_VERDICT = f"""
    WITH obs AS ({NATION_MONTH}), dim AS ({NATION_SERIES}), flows AS ({FLOWS}),
    known AS (SELECT * FROM dim WHERE serie_id <> 'NATION_7'),
    dec AS (SELECT * FROM {_MISMATCHES.format(flows="SELECT * FROM flows")}),
    orphans AS (SELECT * FROM obs WHERE serie_id NOT IN (SELECT serie_id FROM known)),
    doubled AS (SELECT 1 FROM obs GROUP BY serie_id, fecha HAVING COUNT(*) > 1),
    errors AS (SELECT 1 FROM orphans UNION ALL SELECT * FROM doubled UNION ALL SELECT 1 FROM dec
               UNION ALL SELECT 1 FROM flows WHERE flujo IS NULL
               UNION ALL SELECT 1 FROM {_gaps("SELECT * FROM obs")})
    SELECT 'series declaradas' AS prueba, COUNT(*) = 25 AS ok, ABS(COUNT(*) - 25) AS fallas FROM known
    UNION ALL SELECT 'sin huerfanas', COUNT(*) = 0, COUNT(*) FROM orphans
    UNION ALL SELECT 'sin duplicados', COUNT(*) = 0, COUNT(*) FROM doubled
    UNION ALL SELECT 'reconcilia', COUNT(*) = 0, COUNT(*)
        FROM (SELECT serie_id, MAX(ABS(o.valor - f.flujo)) AS dif
              FROM obs o LEFT JOIN flows f USING (serie_id, fecha) GROUP BY 1
              HAVING NOT COALESCE(MAX(ABS(o.valor - f.flujo)) <= 1e-6, FALSE) OR COUNT(*) <> COUNT(f.fecha)) r
    UNION ALL SELECT 'flujos suman diciembre', COUNT(*) = 0, COUNT(*) FROM dec
    UNION ALL SELECT 'sin errores de calidad', COUNT(*) = 0, COUNT(*) FROM errors"""


@query(_VERDICT)
def warehouse_verdict(spark, folder):
    """Rebuild from the star and verify: all series published year to date, one of them undeclared."""
    observed = panels.published(panels.nation_month(spark, folder))
    dim = reshape.build_dim_serie(panels.nation_metadata(spark, folder)).where("serie_id <> 'NATION_7'")
    raw = panels.as_ytd(observed)
    built: Warehouse = build_warehouse(dim, observed, raw, folder=new_folder(spark), prefix="w_")
    return verify(built, observed, series=25, tol=1e-6)


@query(f"""
    WITH series AS (SELECT DISTINCT o_orderpriority AS serie_id FROM orders),
    months AS (SELECT DISTINCT date_trunc('month', o_orderdate) AS fecha FROM orders),
    quarters AS (SELECT DISTINCT date_trunc('quarter', o_orderdate) AS fecha FROM orders)
    SELECT 'mensual' AS panel, serie_id, COUNT(*) AS filas, 0 AS sin_pareja, TRUE AS ok
    FROM series CROSS JOIN months GROUP BY serie_id
    UNION ALL SELECT 'trimestral', serie_id, COUNT(*), 0, TRUE FROM series CROSS JOIN quarters GROUP BY serie_id""")
def star_reconciled(spark, folder):
    """Panels, metadata and days written as files, loaded as a star, and shown to hold the panels again."""
    path, carried, by_day = new_folder(spark), "1-URGENT", "2-HIGH"
    monthly, quarterly = panels.priority_month(spark, folder), panels.priority_quarter(spark, folder)
    days = panels.priority_day(spark, folder).where(F.col("serie_id") == by_day)
    quarter = F.trunc("fecha", "quarter").alias("fecha")
    months = panels.order_calendar(spark, folder).select(F.col("fecha").alias("mes"), quarter)
    shown = quarterly.where(F.col("serie_id") == carried).join(months, "fecha")
    means = [
        df.groupBy("serie_id", quarter).agg(F.avg("valor").alias("valor"))
        for df in (monthly.where(~F.col("serie_id").isin(carried, by_day)), days)
    ]
    names = panels.priorities(spark, folder)
    wide = {
        "mensual": monthly.where(F.col("serie_id") != carried).unionByName(
            shown.select("serie_id", F.col("mes").alias("fecha"), "valor")
        ),
        "trimestral": reshape.concat([quarterly.where(F.col("serie_id") == carried), *means]),
    }
    for tag, panel in wide.items():
        cells = panel.groupBy("fecha").pivot("serie_id", names).agg(F.max("valor"))
        cells.write.option("header", True).csv(f"{path}/{tag}")
    days.select("fecha", "valor").write.option("header", True).csv(f"{path}/dias")
    series = panels.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("variable")).distinct()
    series.select(
        "variable",
        F.col("variable").alias("etiqueta"),
        F.when(F.col("variable") == carried, "Q").otherwise("M").alias("frecuencia"),
        F.lit("FRED - X").alias("origen"),
        F.col("variable").alias("titulo_original"),
    ).write.option("header", True).csv(f"{path}/series")

    star = load_star(
        spark,
        Files(
            metadata=f"{path}/series",
            panels={tag: f"{path}/{tag}" for tag in wide},
            routes={"trimestral": "Q"},
            otherwise="mensual",
            daily={by_day: f"{path}/dias"},
        ),
        period=None,
    )
    read = [read_panel(spark, f"{path}/{tag}").drop("archivo", "orden") for tag in wide]
    out = reconcile_panels(star, *read, carried=carried, tol=1e-5)
    return out.select("panel", "serie_id", "filas", "sin_pareja", "ok")
