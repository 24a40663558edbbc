"""Equality of relations as multisets, without moving their rows.

Rows fall into ranges by a hash of themselves.  Of a range it is enough to know
how many rows it has and the sums of two independent hashes: sums do not depend
on the order, and are taken in the map tasks, so that only a few numbers for
each range are shuffled.  Where the numbers differ, only the rows of that range
are cut into smaller ranges, until few enough are left to be compared as rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriata.session import settle

RANGES = 1024  # ranges at first, and parts that a range is cut into
LEVELS = 3
_MARK, _RANGE = "__mark", "__range"


def _canonical(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Values for the hashes: equal values have equal ones, NULL and "" do not."""
    out = []
    for name in columns:
        column, kind = F.col(f"`{name}`"), df.schema[name].dataType
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            column = F.when(column == 0, F.abs(column)).otherwise(column)  # one zero
        out += [column, column.isNull()]
    return out


def marked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with their two hashes."""
    values = _canonical(df, columns)
    one, two = F.xxhash64(*values), F.xxhash64(F.lit("other"), *values)
    return df.select(*[f"`{c}`" for c in columns], F.struct(one.alias("one"), two.alias("two")).alias(_MARK))


def _range(level: int) -> Column:
    return F.pmod(F.shiftrightunsigned(F.col(f"{_MARK}.one"), 10 * level), F.lit(RANGES)).cast("int")


def _sums(df: DataFrame, keys: Sequence[Column], side: str) -> DataFrame:
    whole = "decimal(20,0)"
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"rows_{side}"),
        F.sum(F.col(f"{_MARK}.one").cast(whole)).alias(f"one_{side}"),
        F.sum(F.col(f"{_MARK}.two").cast(whole)).alias(f"two_{side}"),
    )


def differing_ranges(left: DataFrame, right: DataFrame, level: int = 1) -> DataFrame:
    """``(r0, r1, ...)``: the ranges of ``level`` that two marked relations fill in another way."""
    names = [f"r{i}" for i in range(level)]
    keys = [_range(i).alias(name) for i, name in enumerate(names)]
    parts = ("rows", "one", "two")
    sides = []
    for df, side, other in ((left, "l", "r"), (right, "r", "l")):
        sums = _sums(df, keys, side)
        sides.append(sums.select(*names, *[(F.col(f"{p}_{s}") if s == side else F.lit(0)).cast("decimal(38,0)").alias(f"{p}_{s}") for p in parts for s in (side, other)]))
    both = sides[0].unionByName(sides[1]).groupBy(*names).agg(*[F.sum(f"{p}_{s}").alias(f"{p}_{s}") for p in parts for s in "lr"])
    apart = F.lit(False)
    for p in parts:
        apart = apart | (F.col(f"{p}_l") != F.col(f"{p}_r"))
    return both.where(apart).select(*names)


def _same_columns(left: DataFrame, right: DataFrame) -> list[str]:
    if len(set(left.columns)) != len(left.columns) or set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {left.columns} and {right.columns}")
    kinds = [{f.name: f.dataType for f in df.schema} for df in (left, right)]
    if kinds[0] != kinds[1]:
        raise ValueError("types differ: cast one side, or compare results with results_difference")
    return left.columns


def multisets_equal(left: DataFrame, right: DataFrame) -> bool:
    """Whether two relations hold the same rows equally often; columns may stand in another order.

    One pass over each; rows are not shuffled, at most ``RANGES`` rows of sums
    per task are.  Two different relations are taken for equal only if all
    counts and both 64-bit sums agree by chance.
    """
    columns = _same_columns(left, right)
    return differing_ranges(marked(left, columns), marked(right, columns)).isEmpty()


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two relations do not hold equally often, with ``izquierda`` and ``derecha``, how often each does.

    Descends level by level, into ranges that differ only; the rows of the last
    ones are the only rows that are shuffled.  NULL equals NULL, NaN equals NaN
    and 0.0 equals -0.0; a row that both hold as often is not given, however often that is.
    """
    columns = _same_columns(left, right)
    sides = [marked(df, columns) for df in (left, right)]
    for level in range(1, LEVELS + 1):
        ranges = settle(differing_ranges(*sides, level))
        if level < LEVELS and ranges.count() * RANGES > 1 << 20:
            break  # most ranges differ: smaller ones would not leave rows out
        sides = [_inside(df, ranges, level) for df in sides]
        if level == LEVELS or ranges.isEmpty():
            break
    tagged = [df.select(*columns, F.lit(int(i == 0)).alias("__l")) for i, df in enumerate(sides)]
    counts = tagged[0].unionByName(tagged[1]).groupBy(*columns).agg(
        F.sum("__l").alias("izquierda"), F.sum(1 - F.col("__l")).alias("derecha")
    )
    return counts.where(F.col("izquierda") != F.col("derecha"))


def _inside(df: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    """Rows of the given ranges, which are few: at most ``RANGES`` at first, a million later."""
    keys = {f"r{i}": _range(i) for i in range(level)}
    return df.withColumns(keys).join(F.broadcast(ranges), list(keys), "left_semi").drop(*keys)
