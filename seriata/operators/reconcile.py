"""Reconciliation: two relations against each other, value by value.

Both sides are put under one another and grouped by key, so one shuffle with
pre-aggregation replaces a full outer join, and copies of a hot key never
meet as pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriata.functions.numbers import no_nan
from seriata.operators.fingerprint import multisets_equal

KEY = ("serie_id", "fecha")


def _per_key(
    expected: DataFrame, actual: DataFrame, key: Sequence[str], value: str
) -> DataFrame:
    """Per key: pairs and unpaired rows, as a full outer join would list them.

    The largest difference among the pairs of a key needs only the extremes
    of each side.  Pairs are counted as doubles: copies of a hot key on both
    sides can make more of them than a BIGINT holds.
    """
    sides = [
        df.select(*key, no_nan(F.col(value).cast("double")).alias("v"), F.lit(tag).alias("side"))
        for tag, df in (("e", expected), ("a", actual))
    ]

    def of(side: str, what: Column) -> Column:
        return F.when(F.col("side") == side, what)

    one, v = F.lit(1), F.col("v")
    aggregates = {}
    for side in ("e", "a"):
        aggregates |= {
            f"n_{side}": F.count(of(side, one)),
            f"k_{side}": F.count(of(side, v)),
            f"lo_{side}": F.min(of(side, v)),
            f"hi_{side}": F.max(of(side, v)),
        }
    grouped = sides[0].unionByName(sides[1]).groupBy(*key)
    per_key = grouped.agg(*[c.alias(name) for name, c in aggregates.items()])

    n_e, n_a, k_e, k_a = (F.col(c).cast("double") for c in ("n_e", "n_a", "k_e", "k_a"))
    widest = F.greatest(F.col("hi_e") - F.col("lo_a"), F.col("hi_a") - F.col("lo_e"))
    return per_key.select(
        *key,
        "n_e",
        "n_a",
        (n_e * n_a).alias("pares"),
        F.when((n_e == 0) | (n_a == 0), F.col("n_e") + F.col("n_a")).otherwise(0).alias("sin_pareja"),
        no_nan(widest).alias("dif"),
        (k_e * (n_a - k_a) + k_a * (n_e - k_e)).alias("nulos_de_un_lado"),
    )


def _count(n: Column) -> Column:
    """As BIGINT; NULL if there are more than that holds."""
    return n.try_cast("bigint")


def _per_series(per_key: DataFrame, series: str) -> DataFrame:
    return per_key.groupBy(series).agg(
        F.sum("n_e").alias("n_e"),
        F.sum("n_a").alias("n_a"),
        F.sum("pares").alias("pares"),
        F.sum("sin_pareja").alias("sin_pareja"),
        F.max("dif").alias("dif"),
        F.sum("nulos_de_un_lado").alias("nulos_de_un_lado"),
    )


def _compared(per_series: DataFrame, missing: str) -> DataFrame:
    """Expected series only; those absent on the other side go or stay to fail."""
    if missing not in ("skip", "fail"):
        raise ValueError("missing is 'skip' or 'fail'")
    wanted = per_series.where(F.col("n_e") > 0)
    return wanted.where(F.col("n_a") > 0) if missing == "skip" else wanted


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    *,
    tol: float = 1e-9,
    missing: str = "skip",
    key: Sequence[str] = KEY,
    value: str = "valor",
) -> DataFrame:
    """Per series: full outer on the key, largest difference and verdict.

    A value against a NULL is no difference for the verdict, as published;
    ``nulos_de_un_lado`` tells how many there are.
    """
    out = _compared(_per_series(_per_key(expected, actual, key, value), key[0]), missing)
    ok = (F.col("sin_pareja") == 0) & F.coalesce(F.col("dif") <= tol, F.lit(False))
    return out.select(
        key[0],
        "dif",
        _count(F.col("pares") + F.col("sin_pareja")).alias("filas"),
        "sin_pareja",
        _count(F.col("nulos_de_un_lado")).alias("nulos_de_un_lado"),
        ok.alias("ok"),
    )


def reconcile_inner(
    expected: DataFrame,
    actual: DataFrame,
    *,
    rows: int | None = None,
    tol: float = 1e-8,
    missing: str = "fail",
    key: Sequence[str] = KEY,
    value: str = "valor",
) -> DataFrame:
    """Per series: matched rows only; they must be ``rows`` (all expected, if None)."""
    out = _compared(_per_series(_per_key(expected, actual, key, value), key[0]), missing)
    due = F.col("n_e") if rows is None else F.lit(rows)
    ok = F.coalesce(F.col("dif") <= tol, F.lit(False)) & (F.col("pares") == due)
    return out.select(key[0], "dif", _count(F.col("pares")).alias("n"), ok.alias("ok"))


def _sides_by_row(left: DataFrame, right: DataFrame) -> DataFrame:
    columns = left.columns
    if len(set(columns)) != len(columns) or set(columns) != set(right.columns):
        raise ValueError(f"columns differ: {columns} and {right.columns}")
    both = left.withColumn("__l", F.lit(1)).unionByName(right.withColumn("__l", F.lit(0)))
    return both.groupBy(*columns).agg(
        F.sum("__l").alias("izquierda"), F.sum(1 - F.col("__l")).alias("derecha")
    )


def relations_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """EXCEPT in both directions; ``solo_en`` tells the side that has the row."""
    rows = _sides_by_row(left, right)
    side = F.when(F.col("derecha") == 0, "izquierda").when(F.col("izquierda") == 0, "derecha")
    return rows.withColumn("solo_en", side).where(F.col("solo_en").isNotNull()).drop(
        "izquierda", "derecha"
    )


def relations_identical(left: DataFrame, right: DataFrame) -> bool:
    return relations_difference(left, right).isEmpty()


def normalised(df: DataFrame, digits: int = 6) -> DataFrame:
    """Names lower-cased, numbers comparable across types, everything else as text.

    Whole numbers and decimals stay exact, decimals to ``digits`` decimals;
    doubles become the decimal of their value rounded to as many.  So 1 equals
    1.0, and two numbers beyond what a double can tell apart differ.  A double
    too large for a decimal is compared as text, NaN is NULL.
    """
    scale = float(10**digits)
    columns = []
    for field in df.schema:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            value = no_nan(column.cast("double"))
            rounded = F.rint(value * scale) / scale
            plain = F.round(rounded.try_cast(f"decimal(38,{digits})"), digits)
            column = F.coalesce(_number_key(plain), rounded.cast("string"))
        elif isinstance(kind, T.NumericType):
            column = _number_key(F.round(column.cast("decimal(38,0)" if isinstance(kind, T.IntegralType) else kind), digits))
        else:
            column = column.cast("string")
        columns.append(column.alias(field.name.strip().lower()))
    return df.select(*columns)


def _number_key(value: Column) -> Column:
    """A decimal as text without zeros at its end."""
    text = value.cast("string")
    short = F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))
    return F.when(F.contains(text, F.lit(".")), short).otherwise(text)


def results_difference(left: DataFrame, right: DataFrame, digits: int = 6) -> DataFrame:
    """Rows that two results do not hold equally often, whatever their order."""
    rows = _sides_by_row(normalised(left, digits), normalised(right, digits))
    return rows.where(F.col("izquierda") != F.col("derecha"))


def results_equal(left: DataFrame, right: DataFrame, digits: int = 6) -> bool:
    """Whether two results hold the same rows equally often; told from sums of hashes, no row is shuffled."""
    names = [sorted(c.strip().lower() for c in df.columns) for df in (left, right)]
    return names[0] == names[1] and multisets_equal(normalised(left, digits), normalised(right, digits))
