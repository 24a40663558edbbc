"""Panels derived from the given tables; the registered queries run on them.

Each panel is aggregated before anything else, so a supplier or customer with
a third of all rows is combined inside the map tasks.  Money has two decimals
and is summed exactly.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriata.functions.dates import month_start, quarter_start
from seriata.functions.numbers import exact_sum, round_at
from seriata.operators.transforms import accumulate_ytd
from seriata.session import new_folder
from seriata.sources.tables import Sources, publish

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

MOST_PRIORITIES = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return Sources(spark, folder, TABLES).table(name)


def money(amount: str) -> Column:
    return exact_sum(F.col(amount)).alias("valor")


def mean_money(amount: str) -> Column:
    return (money(amount) / F.count(amount)).alias("valor")


def nation_month(spark: SparkSession, folder: str) -> DataFrame:
    """Nations are named before the orders come in: a filter on the series then
    thins out the customers, and with them the orders, ahead of the shuffle."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), month_start("o_orderdate").alias("fecha"), "o_totalprice"
    )
    nations = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("serie_id")
    )
    customers = table(spark, folder, "customer").join(nations, "c_nationkey")
    named = orders.join(customers.select("c_custkey", "serie_id"), "c_custkey")
    return named.groupBy("serie_id", "fecha").agg(money("o_totalprice"))


def supplier_month(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "lineitem")
        .groupBy("l_suppkey", month_start("l_shipdate").alias("fecha"))
        .agg(money("l_extendedprice"))
        .select(F.col("l_suppkey").cast("string").alias("serie_id"), "fecha", "valor")
    )


def _by_priority(spark: SparkSession, folder: str, when: Column, value: Column) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("serie_id"), when.alias("fecha")).agg(value)


def priority_month(spark: SparkSession, folder: str) -> DataFrame:
    return _by_priority(spark, folder, month_start("o_orderdate"), money("o_totalprice"))


def priority_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return _by_priority(spark, folder, quarter_start("o_orderdate"), money("o_totalprice"))


def priority_day(spark: SparkSession, folder: str) -> DataFrame:
    return _by_priority(spark, folder, F.col("o_orderdate").cast("date"), mean_money("o_totalprice"))


def order_calendar(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(month_start("o_orderdate").alias("fecha")).distinct()


def event_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Event grain: five series that share all rows, ordered by (fecha, event_id)."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("serie_id"), F.col("ts").alias("fecha"), "event_id", F.col("value").alias("valor")
    )


def nation_metadata(spark: SparkSession, folder: str) -> DataFrame:
    regions = table(spark, folder, "region")
    nations = table(spark, folder, "nation")
    letter = F.element_at(F.array(F.lit("D"), F.lit("M"), F.lit("Q")), F.col("n_nationkey") % 3 + 1)
    return nations.join(regions, nations.n_regionkey == regions.r_regionkey).select(
        F.col("n_name").alias("variable"),
        F.concat("n_name", F.lit(" / "), "r_name").alias("etiqueta"),
        letter.alias("frecuencia"),
        F.concat("r_name", F.lit(" - "), F.col("n_nationkey").cast("string")).alias("origen"),
        F.when(F.col("n_nationkey") != 7, F.col("n_name")).alias("titulo_original"),
    )


def ytd_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as published: totals of the year so far, dated at month end."""
    return as_ytd(nation_month(spark, folder))


def as_ytd(panel: DataFrame) -> DataFrame:
    totals = accumulate_ytd(panel).select(
        "serie_id", F.last_day("fecha").alias("fecha"), round_at(F.col("acumulado"), 2).alias("valor")
    )
    return totals


def published(panel: DataFrame) -> DataFrame:
    """The panel written as a mart, for what reads it more than once."""
    path = new_folder(panel.sparkSession)
    return publish(panel, layer="marts", path=path, cluster_by=("serie_id", "fecha"))


def priorities(spark: SparkSession, folder: str) -> list[str]:
    """The order priorities that there are; they become columns, so too many fail."""
    names = table(spark, folder, "orders").select("o_orderpriority").distinct().limit(MOST_PRIORITIES + 1)
    found = sorted(r[0] for r in names.collect())
    if len(found) > MOST_PRIORITIES:
        raise ValueError(f"more than {MOST_PRIORITIES} order priorities")
    return found


def is_month(year: int, month: int) -> Column:
    return F.col("fecha") == F.lit(date(year, month, 1))
