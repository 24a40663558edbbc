"""Rows whose value is not in a list, with the three-valued logic of SQL's NOT IN."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def not_in(df: DataFrame, column: str, listed: DataFrame, field: str | None = None) -> DataFrame:
    """Rows of ``df`` for which ``column NOT IN (SELECT field FROM listed)`` is true.

    An empty list keeps every row, also those with NULL.  Otherwise a row with
    NULL goes, and a list that holds NULL keeps nothing: no value can be told
    to be absent from it.  Spark's own NOT IN compares every row with the whole
    list in one broadcast; here the list is asked twice for one number, and the
    rest is a plain anti join, whose sides meet right after their exchange, so
    that adaptive execution can split a hot value.
    """
    values = listed.select(F.col(field or column).alias("__listed"))
    facts = values.agg(
        F.struct(F.count(F.lit(1)).alias("rows"), F.count("__listed").alias("known")).alias("__list")
    ).scalar()
    judged = df.withColumn("__list", facts)
    empty = F.col("__list.rows") == 0
    known = (F.col("__list.rows") == F.col("__list.known")) & F.col(column).isNotNull()
    asked = judged.where(empty | known)
    return asked.join(values, F.col(column) == F.col("__listed"), "left_anti").drop("__list")
