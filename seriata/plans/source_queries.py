"""Queries over sources, sinks and scalar expressions.

Files are written below the shared folder from the given tables and read back
through the loaders, so their size follows the tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriata.functions import dates, numbers, text
from seriata.operators import reshape
from seriata.operators.transforms import moving_average, yoy_change
from seriata.plans import panels
from seriata.plans.registry import (
    NATION_MONTH,
    NATION_SERIES,
    PRIORITY_DAY,
    PRIORITY_MONTH,
    SUPPLIER_MONTH,
    half,
    query,
    three_month_mean,
)
from seriata.plans.transform_queries import _GRID, _YOY, _monthly_wide
from seriata.session import new_folder, settle
from seriata.sources import delimited, sheets, tables


@query(_GRID)
def csv_panel(spark, folder):
    """Wide CSV files with an empty cell, half of them with the columns in reverse; melted."""
    path = new_folder(spark)
    wide = _monthly_wide(spark, folder)
    early = F.year("fecha") < 1998
    wide.where(early).write.option("header", True).csv(path)
    wide.where(~early).select(*reversed(wide.columns)).write.mode("append").option("header", True).csv(path)
    return reshape.melt_panel(delimited.read_panel(spark, path).drop("archivo", "orden"))


@query(f"""
    SELECT serie_id, fecha, valor FROM ({_GRID}) g WHERE serie_id NOT IN ('1-URGENT', '2-HIGH')""")
def csv_observations(spark, folder):
    """Load of wide panels into the fact: one of the two files is absent."""
    path = new_folder(spark)
    _monthly_wide(spark, folder).write.option("header", True).csv(path)
    urgent = F.col("serie_id").isin("1-URGENT", "2-HIGH")
    names = panels.table(spark, folder, "orders").select(F.col("o_orderpriority").alias("serie_id"))
    dim = names.distinct().withColumn("frecuencia", F.when(urgent, "Q").otherwise("M"))
    return delimited.load_observations(
        spark,
        {"mensual": path, "trimestral": f"{path}-absent"},
        dim,
        routes={"trimestral": "Q"},
        otherwise="mensual",
    )


@query(NATION_SERIES)
def csv_metadata(spark, folder):
    """Columns in another order, and one more."""
    path = new_folder(spark)
    shuffled = panels.nation_metadata(spark, folder).select(
        "titulo_original", "variable", F.lit("x").alias("nota"), "frecuencia", "origen", "etiqueta"
    )
    shuffled.write.option("header", True).csv(path)
    return delimited.load_dim_serie(spark, path)


@query(f"""
    SELECT serie_id, fecha, valor FROM ({PRIORITY_DAY}) d
    WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND DAY(fecha) <> 13""")
def csv_daily(spark, folder):
    """Two-column CSVs, one folder per series, with other headers and empty values."""
    path = new_folder(spark)
    daily = panels.priority_day(spark, folder).select(
        "serie_id",
        F.col("fecha").alias("observation_date"),
        F.when(F.day("fecha") != 13, F.col("valor")).alias("VALUE"),
    )
    daily.write.partitionBy("serie_id").option("header", True).csv(path)
    files = {p: f"{path}/serie_id={p}" for p in panels.priorities(spark, folder)}
    files["absent"] = f"{path}/serie_id=absent"
    return delimited.load_daily(spark, files, period=(date(1996, 1, 1), date(2000, 12, 31)))


@query(f"""
    WITH d AS ({PRIORITY_DAY})
    SELECT serie_id, fecha, valor, NULL AS texto, NULL AS motivo FROM d WHERE DAY(fecha) NOT IN (7, 13)
    UNION ALL SELECT serie_id, NULL, NULL, CAST(fecha AS VARCHAR) || ',n.d.', 'no number' FROM d WHERE DAY(fecha) = 13
    UNION ALL SELECT serie_id, NULL, NULL, 'day ' || CAST(fecha AS VARCHAR) || ',1.5', 'no date' FROM d WHERE DAY(fecha) = 7""")
def daily_rejects(spark, folder):
    """Two-column CSVs with unreadable values and dates: rows that load, and lines kept apart."""
    path = new_folder(spark)
    day, text = F.day("fecha"), F.col("fecha").cast("string")
    panels.priority_day(spark, folder).select(
        "serie_id",
        F.when(day == 7, F.concat(F.lit("day "), text)).otherwise(text).alias("DATE"),
        F.when(day == 7, "1.5").when(day == 13, "n.d.").otherwise(F.col("valor").cast("string")).alias("VALUE"),
    ).write.partitionBy("serie_id").option("header", True).csv(path)
    files = {p: f"{path}/serie_id={p}" for p in panels.priorities(spark, folder)}
    good, rejects = delimited.load_daily_or_reject(spark, files, period=None)
    both = good.unionByName(rejects, allowMissingColumns=True)
    return both.select("serie_id", "fecha", "valor", "texto", "motivo")


@query(f"SELECT serie_id, fecha, valor FROM ({SUPPLIER_MONTH}) p WHERE MONTH(fecha) <> 12")
def sheet_scan(spark, folder):
    """A sheet per supplier: title rows, a header somewhere below, unreadable Decembers."""
    return sheets.scan_sheets(_supplier_sheets(spark, folder), 2).withColumnRenamed("archivo", "serie_id")


@query(f"""
    SELECT serie_id, CAST(CAST(serie_id AS INT) % 10 + 2 + (YEAR(fecha) - 1990) * 12 + MONTH(fecha) - 1 AS INT) AS row_idx,
           'valor' AS columna, 'n.d.' AS texto, 'no number' AS motivo, NULL AS fecha, NULL AS valor
    FROM ({SUPPLIER_MONTH}) p WHERE MONTH(fecha) = 12
    UNION ALL SELECT serie_id, NULL, NULL, NULL, NULL, fecha, valor FROM ({SUPPLIER_MONTH}) p WHERE MONTH(fecha) <> 12""")
def sheet_rejects(spark, folder):
    """The same sheets: rows that parse, and the cells for which rows are left out."""
    good, rejects = sheets.scan_or_reject(_supplier_sheets(spark, folder), 2)
    both = rejects.unionByName(good, allowMissingColumns=True)
    return both.withColumnRenamed("archivo", "serie_id")


def _supplier_sheets(spark, folder):
    panel = panels.supplier_month(spark, folder)
    number = F.col("serie_id").cast("bigint")
    titles = (number % 10 + 1).cast("int")
    shown = F.when(F.month("fecha") == 12, F.lit("n.d.")).otherwise(F.col("valor").cast("string"))
    series = panel.select("serie_id").distinct()
    above = series.select(
        F.col("serie_id").alias("archivo"),
        F.explode(F.sequence(F.lit(0), titles)).alias("row_idx"),
        titles.alias("header"),
    ).select(
        "archivo",
        "row_idx",
        F.when(F.col("row_idx") == F.col("header"), F.array(F.lit("  Fecha de corte"), F.lit("Nota"), F.lit("Total")))
        .otherwise(F.array(F.lit("Cuadro"), F.lit(None).cast("string"), F.lit("1.0")))
        .alias("cells"),
    )
    first = F.lit(date(1990, 1, 1))
    below = panel.select(
        F.col("serie_id").alias("archivo"),
        (titles + 1 + F.months_between("fecha", first)).cast("int").alias("row_idx"),
        F.array(F.col("fecha").cast("string"), F.lit("x"), shown).alias("cells"),
    )
    return above.unionByName(below)


@query(f"""
    WITH s AS (SELECT CAST(l_suppkey % 2 AS VARCHAR) AS mitad, CAST(date_trunc('month', l_shipdate) AS DATE) AS fecha,
                      CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, COUNT(*) AS lineas
               FROM lineitem GROUP BY 1, 2)
    SELECT 'total ' || mitad AS serie_id, fecha, total AS valor FROM s
    WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'
    UNION ALL SELECT 'lineas ' || mitad, fecha, CAST(lineas AS DOUBLE) FROM s
    WHERE fecha BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""")
def ytd_loaded(spark, folder):
    """Two sheets of one name in two folders, each with two series in columns of their own."""
    lines = panels.table(spark, folder, "lineitem")
    sums = lines.groupBy(
        (F.col("l_suppkey") % 2).cast("string").alias("mitad"), dates.month_start("l_shipdate").alias("fecha")
    ).agg(panels.money("l_extendedprice"), F.count(F.lit(1)).alias("lineas"))
    file = F.concat(F.lit("/"), "mitad", F.lit("/cuadro.xlsx")).alias("archivo")
    months = F.months_between("fecha", F.lit(date(1990, 1, 1))).cast("int")
    below = sums.select(
        file,
        (months + 2).alias("row_idx"),
        F.array(F.col("fecha").cast("string"), F.col("lineas").cast("string"), F.col("valor").cast("string")).alias("cells"),
    )
    head = F.array(F.lit("Fecha"), F.lit("Lineas"), F.lit("Total")).alias("cells")
    above = sums.select("mitad").distinct().select(file, F.lit(1).alias("row_idx"), head)
    files = {}
    for half_ in "01":
        files |= {f"total {half_}": (f"/{half_}/cuadro.xlsx", 2), f"lineas {half_}": (f"/{half_}/cuadro.xlsx", 1)}
    period = (date(1996, 1, 1), date(2000, 12, 31))
    return sheets.load_ytd(spark, files, period=period, rows=above.unionByName(below))


@query("SELECT o_orderkey, o_custkey FROM orders")
def declared_source(spark, folder):
    source = tables.Sources(spark, folder, ["orders"])
    return source.table("orders").select("o_orderkey", "o_custkey")


@query(f"""SELECT serie_id, fecha, valor FROM ({SUPPLIER_MONTH}) p
    WHERE fecha >= DATE '1998-01-01' AND fecha < DATE '1999-01-01'""")
def published_table(spark, folder):
    """Written clustered by series and date, read back by a pushable range."""
    written = panels.published(panels.supplier_month(spark, folder))
    return written.where(dates.in_year(F.col("fecha"), 1998))


@query(f"""SELECT serie_id, fecha, valor FROM ({PRIORITY_MONTH}) p
    UNION ALL SELECT serie_id, fecha, valor FROM ({SUPPLIER_MONTH}) q""")
def appended_table(spark, folder):
    """A typed empty table, then two batches appended."""
    path = new_folder(spark)
    schema = T.StructType.fromDDL("serie_id string, fecha date, valor double")
    tables.publish(tables.empty(spark, schema), "facts", kind="table", path=path)
    tables.publish(panels.priority_month(spark, folder), "facts", kind="table", path=path, mode="append")
    return tables.publish(
        panels.supplier_month(spark, folder), "facts", kind="table", path=path, mode="append"
    )


@query(f"""
    SELECT 'antes' AS vez, COUNT(*) AS filas, CAST(SUM(CAST(valor AS DECIMAL(18,2))) AS DOUBLE) AS suma
    FROM ({SUPPLIER_MONTH}) p
    UNION ALL SELECT 'despues', COUNT(*), CAST(SUM(CAST(valor AS DECIMAL(18,2))) AS DOUBLE) FROM ({PRIORITY_MONTH}) q
    UNION ALL SELECT 'vacia', 0, NULL UNION ALL SELECT 'sin vista', 0, NULL""")
def rebuilt_table(spark, folder):
    """One path written, replaced, emptied; its view dropped; what was there each time."""
    path, seen = new_folder(spark), []

    def look(when, df):
        sums = df.agg(F.count(F.lit(1)).alias("filas"), numbers.exact_sum(F.col("valor")).alias("suma"))
        seen.append(settle(sums.select(F.lit(when).alias("vez"), "filas", "suma")))

    view = f"rebuilt_{path.rsplit('/', 1)[-1]}"
    look("antes", tables.publish(panels.supplier_month(spark, folder), view, kind="table", path=path))
    look("despues", tables.publish(panels.priority_month(spark, folder), view, kind="table", path=path))
    schema = T.StructType.fromDDL("serie_id string, fecha date, valor double")
    emptied = tables.publish(tables.empty(spark, schema), view, kind="table", path=path)
    look("vacia", emptied)
    tables.drop_all(spark, [view])
    if not spark.catalog.tableExists(view):
        look("sin vista", emptied)
    return reshape.concat(seen)


@query(f"SELECT serie_id, fecha, valor FROM ({PRIORITY_MONTH}) p")
def staging_view(spark, folder):
    tables.publish(panels.priority_month(spark, folder), "priority_month_view", layer="staging")
    return spark.table("priority_month_view")


@query(f"""
    SELECT y.*, m.mm3 FROM ({_YOY}) y
    JOIN ({three_month_mean(SUPPLIER_MONTH)}) m USING (serie_id, fecha)""")
def marts_from_table(spark, folder):
    """The derived relations read from a published panel, in one exchange."""
    panel = panels.published(panels.supplier_month(spark, folder))
    return moving_average(yoy_change(panel))


@query(f"""
    SELECT y.*, m.mm3 FROM ({_YOY}) y
    JOIN ({three_month_mean(SUPPLIER_MONTH)}) m USING (serie_id, fecha)""")
def bucketed_marts(spark, folder):
    """The same from a bucketed mart, without an exchange."""
    path = new_folder(spark)
    name = f"panel_{path.rsplit('/', 1)[-1]}"
    panel = tables.publish_bucketed(panels.supplier_month(spark, folder), name, buckets=8, path=path)
    return moving_average(yoy_change(panel))


@query(f"""
    SELECT s_suppkey % 7 AS grupo, CAST(s_suppkey AS VARCHAR) AS serie_id, fecha, valor
    FROM ({SUPPLIER_MONTH}) p JOIN supplier ON serie_id = CAST(s_suppkey AS VARCHAR)""")
def enforced_table(spark, folder):
    """Written with NOT NULL, accepted values and a range held by the writing job; replaced once by itself."""
    panel = panels.supplier_month(spark, folder)
    rows = panel.select((F.col("serie_id").cast("bigint") % 7).alias("grupo"), "serie_id", "fecha", "valor")
    schema = T.StructType(
        [
            T.StructField("grupo", T.LongType(), False),
            T.StructField("serie_id", T.StringType(), False),
            T.StructField("fecha", T.DateType(), False),
            T.StructField("valor", T.DoubleType(), True),
        ]
    )
    rules = {"schema": schema, "accepted": {"grupo": range(7)}, "ranges": {"valor": (0.0, 1e15)}}
    path = new_folder(spark)
    first = tables.publish(rows, path=path, cluster_by=("serie_id", "fecha"), **rules)
    return tables.publish(first, path=path, cluster_by=("serie_id", "fecha"), **rules)


@query(f"""SELECT 1 AS carga, serie_id, fecha, valor FROM ({PRIORITY_MONTH}) p
    UNION ALL SELECT 2, serie_id, fecha, valor FROM ({SUPPLIER_MONTH}) q WHERE YEAR(fecha) < 1998""")
def repeated_load(spark, folder):
    """Two loads; the first put twice, the second put again with fewer rows."""
    path = new_folder(spark)
    one, two = panels.priority_month(spark, folder), panels.supplier_month(spark, folder)
    tables.put_load(one, path, 1)
    tables.put_load(two, path, 2)
    tables.put_load(one, path, 1)
    return tables.put_load(two.where(F.col("fecha") < date(1998, 1, 1)), path, 2)


# ---------------------------------------------------------------- scalar expressions


@query("""
    SELECT o_orderkey, CAST(YEAR(o_orderdate) AS INT) AS anio, CAST(QUARTER(o_orderdate) AS INT) AS trimestre,
           CAST(MONTH(o_orderdate) AS INT) AS mes, CAST(date_trunc('month', o_orderdate) AS DATE) AS inicio_mes,
           CAST(date_trunc('quarter', o_orderdate) AS DATE) AS inicio_trimestre,
           make_date(CAST(YEAR(o_orderdate) AS INT), 12, 1) AS diciembre,
           o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-01-01' AS en_1998
    FROM orders""")
def date_functions(spark, folder):
    day = F.col("o_orderdate").cast("date")
    return panels.table(spark, folder, "orders").select(
        "o_orderkey",
        F.year(day).alias("anio"),
        F.quarter(day).alias("trimestre"),
        F.month(day).alias("mes"),
        dates.month_start(day).alias("inicio_mes"),
        dates.quarter_start(day).alias("inicio_trimestre"),
        F.make_date(F.year(day), F.lit(12), F.lit(1)).alias("diciembre"),
        dates.in_year(day, 1998).alias("en_1998"),
    )


_SHARE = "l_extendedprice / 7 - 5000"


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           ROUND({_SHARE}, 1) AS r1, ROUND({_SHARE}, 2) AS r2, ROUND({_SHARE}, 4) AS r4 FROM lineitem""")
def rounding(spark, folder):
    """Against the plain ROUND of the other engine, on every line."""
    share = F.col("l_extendedprice") / 7 - 5000
    return panels.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        *[numbers.round_at(share, n).alias(f"r{n}") for n in (1, 2, 4)],
    )


@query(f"""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           CAST({half(_SHARE, 2)} AS VARCHAR) AS t2, CAST({half("l_discount - 0.05", 1)} AS VARCHAR) AS t1
    FROM lineitem""")
def number_text(spark, folder):
    share = F.col("l_extendedprice") / 7 - 5000
    return panels.table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        numbers.number_text(share, 2).alias("t2"),
        numbers.number_text(F.col("l_discount") - 0.05, 1).alias("t1"),
    )


@query("""
    SELECT o_orderkey, TRY_CAST(trozo AS DOUBLE) AS numero, TRY_CAST(dia AS DATE) AS fecha, cociente
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'n.d.' ELSE CAST(o_custkey AS VARCHAR) END AS trozo,
                 CASE WHEN o_orderstatus = 'F' THEN 'total' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS dia,
                 o_totalprice / NULLIF(o_custkey % 5, 0) AS cociente FROM orders) o""")
def parse_or_null(spark, folder):
    """Text that is no number or date, and a zero divisor: NULL, not an error."""
    status = F.col("o_orderstatus")
    piece = F.when(status == "P", F.lit("n.d.")).otherwise(F.col("o_custkey").cast("string"))
    day = F.when(status == "F", F.lit("total")).otherwise(F.col("o_orderdate").cast("date").cast("string"))
    return panels.table(spark, folder, "orders").select(
        "o_orderkey",
        numbers.try_number(piece).alias("numero"),
        dates.try_date(day).alias("fecha"),
        numbers.ratio(F.col("o_totalprice"), F.col("o_custkey") % 5).alias("cociente"),
    )


@query("""
    SELECT o_orderkey, TRIM(split_part(o_orderpriority || ' - ' || o_orderstatus, ' - ', 1)) AS proveedor,
           LOWER(TRIM('  ' || o_orderpriority)) LIKE '5-low%' AS empieza FROM orders""")
def text_functions(spark, folder):
    origin = F.concat("o_orderpriority", F.lit(" - "), "o_orderstatus")
    return panels.table(spark, folder, "orders").select(
        "o_orderkey",
        text.provider_of(origin).alias("proveedor"),
        text.starts_like(F.concat(F.lit("  "), "o_orderpriority"), "5-low").alias("empieza"),
    )


@query(f"""
    WITH p AS (SELECT * FROM ({NATION_MONTH}) m WHERE serie_id > 'C' OR fecha < DATE '1998-01-01')
    SELECT serie_id, COUNT(*) AS filas, COUNT(CASE WHEN MONTH(fecha) <> 5 THEN valor END) AS n_valor,
           MIN(fecha) AS min_fecha, MAX(fecha) AS max_fecha, MAX(fecha) < (SELECT MAX(fecha) FROM p) AS rezagada
    FROM p GROUP BY serie_id""")
def footer_profile(spark, folder):
    """Counts, first and last dates and laggards of a mart by series, from footers only; some series end early."""
    path = new_folder(spark)
    panel = panels.nation_month(spark, folder).where((F.col("serie_id") > "C") | (F.col("fecha") < date(1998, 1, 1)))
    mart = panel.select("serie_id", "fecha", F.when(F.month("fecha") != 5, F.col("valor")).alias("valor"))
    tables.clustered(mart, ["serie_id", "fecha"]).write.partitionBy("serie_id").parquet(path)
    found = tables.footer_profile(spark, path, by=["serie_id"], counted=["valor"], extremes=["fecha"])
    return found.withColumn("rezagada", F.col("max_fecha") < found.agg(F.max("max_fecha")).scalar())
