"""Windows that look a few rows back inside each series.

A panel keyed by (series, period) has at most one row per calendar period, so
a plain window over a series is bounded by the calendar.  A series at event
grain is not: one may hold a third of all rows.  Such a series is cut into
contiguous slices of near-equal size, and every slice gets the few rows that
come before it, so that no task ever holds a whole series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from seriata.functions.exact import SPAN, carried, place_of, put_together, running_places
from seriata.session import settle

ROWS_PER_SLICE = 5_000_000

SLICE = "__slice"
_BEFORE = "__before"
_FIRST = "__first"
_PLACE = "__place"


def slices_needed(
    df: DataFrame, series: Sequence[str], rows_per_slice: int | None = None
) -> int:
    """How many slices the rows ask for; 0 if every series fits one task.

    Runs a job over the series columns alone: counts per series are combined
    before the shuffle and only two numbers reach the driver.
    """
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    longest, rows = (
        df.groupBy(*series).count().agg(F.max("count"), F.sum("count")).first()
    )
    if longest is None or longest <= rows_per_slice:
        return 0
    return max(2, math.ceil(rows / rows_per_slice))


def with_lookback(
    df: DataFrame,
    build: Callable[[WindowSpec], dict[str, Column]],
    *,
    series: Sequence[str],
    order: Sequence[str],
    back: int,
    slices: int | str | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Add window columns that need at most ``back`` earlier rows of the series.

    ``build`` gets the ordered window of one series and returns the columns.
    ``order`` (ascending) must identify a row within its series.

    ``slices=None``: one window per series, one shuffle; for panels.
    ``slices="auto"``: measure the longest series and cut only if it is too big.
    ``slices=n``: cut into n slices, which are written to the shared folder.

    ``keep_slice`` leaves the slice number in column ``SLICE`` (0 if uncut).
    The rows then lie together by series and slice.
    """
    if slices == "auto":
        slices = slices_needed(df, series)
    if not slices:
        window = Window.partitionBy(*series).orderBy(*order)
        out = df.withColumns(build(window))
        return out.withColumn(SLICE, F.lit(0)) if keep_slice else out

    cut = _cut(df, series, order, int(slices))
    before = _rows_before_each_slice(cut, series, order, back)
    window = Window.partitionBy(*series, SLICE).orderBy(*order)
    out = (
        cut.withColumn(_BEFORE, F.lit(False))
        .unionByName(before.withColumn(_BEFORE, F.lit(True)))
        .withColumns(build(window))
        .where(~F.col(_BEFORE))
        .drop(_BEFORE, _PLACE)
    )
    return out if keep_slice else out.drop(SLICE)


def with_running_total(
    df: DataFrame,
    value: str,
    name: str,
    *,
    group: Sequence[str],
    order: Sequence[str],
    digits: int | None = None,
    exact: bool = False,
    slices: int | str | None = None,
) -> DataFrame:
    """Add the running total of ``value`` in each group; equal ``order`` counts together.

    With ``digits`` the values have at most that many decimals and are added as
    whole units.  With ``exact``, or with slices but no ``digits``, doubles of
    any size are added as whole numbers at powers of 2^32 (see
    ``functions.exact``).  Both give the same total, to the last bit, whatever
    the slices.  With neither doubles are added one after another.
    """
    if slices == "auto":
        slices = slices_needed(df, group)
    if digits is None and (exact or slices):
        return _exact_running_total(df, value, name, group, order, slices)
    if digits is None:
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*group).orderBy(*order)))
    units = F.rint(F.col(value) * float(10**digits)).cast("bigint").cast("decimal(38,0)")
    amount = lambda total: (total * F.lit(Decimal(1).scaleb(-digits))).cast("double")
    if not slices:
        total = F.sum(units).over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn(name, amount(total))

    cut = _cut(df.withColumn("__units", units), group, order, int(slices))
    totals = cut.groupBy(*group, SLICE).agg(F.sum("__units").alias("__total"))
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(c).alias(f"__{c}") for c in (*group, SLICE)],
        F.sum("__total").over(earlier).alias("__carried"),
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*group, SLICE)]
    within = F.sum("__units").over(Window.partitionBy(*group, SLICE).orderBy(*order))
    none = F.lit(Decimal(0)).cast("decimal(38,0)")
    together = F.coalesce(F.col("__within") + F.coalesce("__carried", none), F.col("__carried"))
    return (
        cut.withColumn("__within", within)
        .join(carried, same)
        .withColumn(name, amount(together))
        .select(*df.columns, name)
    )


def _exact_running_total(
    df: DataFrame, value: str, name: str, group: Sequence[str], order: Sequence[str], slices: int | str | None
) -> DataFrame:
    """Running totals by place below the group's largest value; in slices with what earlier ones add up to."""
    number = F.col(value).cast("double")
    if not slices:
        top = place_of(F.max(F.abs(number)).over(Window.partitionBy(*group)))
        ordered = Window.partitionBy(*group).orderBy(*order)
        placed = df.withColumn("__top", top)
        return _as_double(placed, lambda x: F.sum(x).over(ordered), number, F.count(value).over(ordered), name, df.columns)

    cut = _cut(df, group, order, int(slices))
    tops = cut.groupBy(*group, SLICE).agg(F.max(F.abs(number)).alias("__most"))
    tops = tops.withColumn("__top", place_of(F.max("__most").over(Window.partitionBy(*group))))
    keys = (*group, SLICE)
    tops = tops.select(*[F.col(c).alias(f"__{c}") for c in keys], "__top")
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    placed = cut.join(tops, same).drop(*[f"__{c}" for c in keys])
    sums = placed.groupBy(*keys, "__top").agg(running_places(number, F.col("__top"), F.sum).alias("__places"), F.count(value).alias("__count"))
    earlier = Window.partitionBy(*group).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    parts = ("high", "middle", "low")
    before = sums.select(
        *[F.col(c).alias(f"__{c}") for c in keys],
        F.array(*[F.sum(F.get("__places", i)[p]).over(earlier) for i in range(SPAN // 3) for p in parts]).alias("__carried"),
        F.sum("__count").over(earlier).alias("__counted"),
    )
    together = placed.join(before, same).drop(*[f"__{c}" for c in keys])
    ordered = Window.partitionBy(*keys).orderBy(*order)
    at = iter(range(SPAN))

    def with_earlier(x: Column) -> Column:
        return F.sum(x).over(ordered) + F.coalesce(F.get("__carried", next(at)), F.lit(Decimal(0)))

    n = F.count(value).over(ordered) + F.coalesce("__counted", F.lit(0))
    return _as_double(together, with_earlier, number, n, name, df.columns)


def _as_double(df, total, number: Column, n: Column, name: str, columns: Sequence[str]) -> DataFrame:
    """Places of running totals put together; NULL before the first value."""
    placed = df.withColumns({"__sums": running_places(number, F.col("__top"), total), f"__odd_{name}": F.lit(None).cast("double"), "__n": n})
    out = put_together(placed.withColumn(f"__{name}", carried(F.col("__sums"))), name)
    return out.withColumn(name, F.when(F.col("__n") > 0, F.col(name))).select(*columns, name)


def _cut(df: DataFrame, series: Sequence[str], order: Sequence[str], slices: int) -> DataFrame:
    """Rows in near-equal slices by series and order, numbered in ``SLICE``.

    A range exchange balances rows whatever the series sizes are.  Its bounds
    come from a sample, so slice and place are written down once.
    """
    ranged = df.repartitionByRange(slices, *series, *order).sortWithinPartitions(*series, *order)
    return settle(
        ranged.withColumns({SLICE: F.spark_partition_id(), _PLACE: F.monotonically_increasing_id()})
    )


def _rows_before_each_slice(
    cut: DataFrame, series: Sequence[str], order: Sequence[str], back: int
) -> DataFrame:
    """For every slice but a series' first: the ``back`` rows just before it.

    The n slices have n - 1 borders, so at most 2 * (n - 1) parts belong to
    series that go over a border; these are broadcast.  Their last rows number
    at most 2 * n * back, whatever the size of the data.
    """
    parts = Window.partitionBy(*series)
    over_border = (
        cut.groupBy(*series, SLICE)
        .agg(F.max(_PLACE).alias("__last"))
        .withColumn("__parts", F.count(F.lit(1)).over(parts))
        .where(F.col("__parts") > 1)
        .select(*[F.col(c).alias(f"__{c}") for c in (*series, SLICE)], "__last")
    )
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*series, SLICE)]
    among_last = F.col(_PLACE) > F.col("__last") - back
    ends = cut.join(F.broadcast(over_border), [*same, among_last], "left_semi")

    columns = [c for c in cut.columns if c != SLICE]
    whole = Window.partitionBy(*series).orderBy(SLICE, _PLACE)
    own = Window.partitionBy(*series, SLICE).orderBy(_PLACE)
    return (
        ends.withColumn(
            _BEFORE, F.collect_list(F.struct(*columns)).over(whole.rowsBetween(-back, -1))
        )
        .withColumn(_FIRST, F.row_number().over(own))
        .where(F.col(_FIRST) == 1)
        .select(SLICE, F.explode(_BEFORE).alias("row"))
        .select("row.*", SLICE)
    )
