"""Declared constraints as functions that return the rows that break them.

As in SQL, NULL passes every constraint but NOT NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    broken = F.lit(False)
    for c in columns:
        broken = broken | F.col(c).isNull()
    return df.where(broken)


def unique(df: DataFrame, columns: Sequence[str], *, count: str = "veces") -> DataFrame:
    """Keys that occur more than once, with how often."""
    return (
        df.na.drop("any", subset=list(columns))
        .groupBy(*columns)
        .agg(F.count(F.lit(1)).alias(count))
        .where(F.col(count) > 1)
    )


def relationships(df: DataFrame, column: str, to: DataFrame, field: str | None = None) -> DataFrame:
    """Rows whose value is not among the values of the referenced column.

    Both sides meet right after their exchange, which lets adaptive execution
    split a hot value.
    """
    known = to.select(F.col(field or column).alias(column))
    return df.where(F.col(column).isNotNull()).join(known, column, "left_anti").select(df.columns)


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(~F.col(column).isin(list(values)))


def in_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows outside ``low``..``high``; both bounds belong to the range."""
    return df.where(~F.col(column).between(low, high))


def schema_failures(df: DataFrame, schema: T.StructType) -> list[str]:
    """What keeps ``df`` from having the declared columns and types."""
    found = {f.name: f.dataType for f in df.schema}
    out = [f"missing column {f.name}" for f in schema if f.name not in found]
    out += [
        f"column {f.name} is {found[f.name].simpleString()}, declared {f.dataType.simpleString()}"
        for f in schema
        if f.name in found and found[f.name] != f.dataType
    ]
    return out


def null_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows with a NULL in a column that the schema declares NOT NULL."""
    return not_null(df, *[f.name for f in schema if not f.nullable])
