"""Sums of any doubles that do not depend on the order of rows, to the last bit.

A double is three whole numbers at powers of 2^32: scaling by a power of two is
exact, and 53 bits span three such places at most.  Whole numbers are summed as
decimals, a place at a time, combined in the map tasks and again behind the
shuffle; only the totals of a group, at most some seventy places, are put
together as a double, once.  The sum is known to some 95 bits, in two doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 32
BASE = float(2**BITS)

_WHOLE = "decimal(38,0)"
_REST, _N = "__rest", "__n"
SPAN = 6
_SPLIT = float(2**27 + 1)  # cuts a double into two halves of 26 bits


def _power(place: Column) -> Column:
    """``2^(16 * place)``, half of a place."""
    return F.pow(F.lit(2.0), place * (BITS // 2))


def _with_places(df: DataFrame, value: str) -> DataFrame:
    """Add the place of a finite double, and whole numbers that belong there and at the two places below.

    A column at a time: as one expression each would be worked out many times over.
    """
    x, first, high, second, middle = (F.col(c) for c in (value, "__first", "high", "__second", "middle"))
    for step in (
        {"place": F.when(x.isNotNull(), place_of(x))},
        {"__scale": _power(-F.col("place"))},
        {"__first": x * F.col("__scale") * F.col("__scale")},  # in two steps: one power could leave the range of doubles
        {"high": first.cast("bigint")},
        {"__second": (first - high) * BASE},
        {"middle": second.cast("bigint")},
        {"low": ((second - middle) * BASE).cast("bigint")},
    ):
        df = df.withColumns(step)
    return df.drop("__scale", "__first", "__second")


def square(value: Column) -> tuple[Column, Column]:
    """The square of a double as the sum of two doubles; for zero, and values from 1e-145 to 1e150."""
    return product(value, value)


def exact_totals(df: DataFrame, keys: Sequence[str], amounts: dict[str, Sequence[Column]]) -> DataFrame:
    """The exact sum of each of ``amounts`` per key: ``name``, and ``name__rest``, what rounding it to a double left.

    ``name__n`` counts what was added.  An amount is the sum of several columns,
    NULL adding nothing; the total of NULLs alone is NULL.  NaN and infinities give what a sum of doubles gives.  ``keys``
    may be NULL.  Two aggregates on the keys and the place, then on the keys: one
    exchange if ``df`` already lies by ``keys``, or none.
    """
    parts = [
        F.struct(F.lit(i).alias("name"), part.cast("double").alias("value"))
        for i, columns in enumerate(amounts.values())
        for part in columns
    ]
    rows = df.select(*keys, F.explode(F.array(*parts)).alias("part")).select(*keys, "part.*")
    value = F.col("value")
    finite = F.abs(value) < float("inf")  # NaN is larger than any number
    rows = rows.withColumns({"odd": F.when(~finite, value), "value": F.when(finite, value).when(value.isNotNull(), 0.0)})
    sums = [F.sum(F.col(c).cast("decimal(20,0)")).cast(_WHOLE).alias(c) for c in ("high", "middle", "low")]
    placed = _with_places(rows, "value").groupBy(*keys, "name", "place").agg(*sums, F.sum("odd").alias("odd"), F.count("value").alias("n"))
    columns = []
    for i, name in enumerate(amounts):
        own = F.col("name") == i
        limbs = F.collect_list(F.when(own & F.col("place").isNotNull(), F.struct("place", "high", "middle", "low")))
        columns += [
            carried(limbs).alias(f"__{name}"),  # in the aggregate, below which no filter goes: it would be worked out again
            F.sum(F.when(own, F.col("odd"))).alias(f"__odd_{name}"),
            F.sum(F.when(own, F.col("n"))).alias(name + _N),
        ]
    gathered = placed.groupBy(*keys).agg(*columns)
    for name in amounts:
        gathered = put_together(gathered, name)
    return gathered.select(*keys, *[c for name in amounts for c in (name, name + _REST, name + _N)])


def exact_moments(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key ``n``, ``suma``, ``media`` and ``desviacion`` (of a sample) of a column, the same in any order of rows.

    NULLs do not count; a deviation of fewer than two values is NULL.  It is
    taken of exact sums of values and of their squares, so a mean far from zero
    costs nothing; squares need values of 1e-145 to 1e150, or zero.
    """
    x = F.col(value).cast("double")
    totals = exact_totals(df, keys, {"s": [x], "q": square(x)})
    n = F.col("s__n").cast("double")
    squared, squared_rest = product(F.col("s"), F.col("s"))
    scaled, scaled_rest = product(n, F.col("q"))
    difference = scaled - squared
    back = scaled - difference  # what rounding the difference left, exactly
    left = (back - squared) + ((scaled - (difference + back)) + scaled_rest - squared_rest + n * F.col("q__rest") - 2 * F.col("s") * F.col("s__rest"))
    variance = F.try_divide(difference + left, n * (n - 1))
    return totals.select(
        *keys,
        F.col("s__n").alias("n"),
        F.col("s").alias("suma"),
        F.try_divide(F.col("s"), n).alias("media"),
        F.sqrt(F.when(variance < 0, 0.0).otherwise(variance)).alias("desviacion"),
    )


def running_places(value: Column, top: Column, sum_over: Callable[[Column], Column]) -> Column:
    """Running sums of ``value`` by place, for ``carried``; ``top`` is the place of the group's largest value.

    ``SPAN`` places are kept: a value counts to 2^-160 of the largest at least.
    """
    left = F.coalesce(value, F.lit(0.0)) * _power(-top) * _power(-top)
    sums = []
    for _ in range(SPAN):
        whole = left.cast("bigint")
        sums.append(sum_over(whole.cast("decimal(20,0)")).cast(_WHOLE))
        left = (left - whole) * BASE
    return F.array(
        *[
            F.struct((top - at).alias("place"), sums[at].alias("high"), sums[at + 1].alias("middle"), sums[at + 2].alias("low"))
            for at in range(0, SPAN, 3)
        ]
    )


def place_of(value: Column) -> Column:
    """The place of a finite double; 0 for zero and NULL."""
    return F.coalesce(F.floor(F.log2(F.abs(value)) / BITS), F.lit(0)).cast("int")


def product(a: Column, b: Column) -> tuple[Column, Column]:
    """The product of two doubles as the sum of two doubles, without an error (Dekker, 1971)."""
    (high_a, low_a), (high_b, low_b) = _halves(a), _halves(b)
    whole = a * b
    return whole, ((high_a * high_b - whole) + high_a * low_b + low_a * high_b) + low_a * low_b


def _halves(value: Column) -> tuple[Column, Column]:
    bent = value * _SPLIT
    high = bent - (bent - value)
    return high, value - high


def carried(limbs: Column) -> Column:
    """Carry from place to place, lowest first, so that each holds less than half of 2^32; NULL if there is none."""
    lowest, highest = F.array_min(F.transform(limbs, lambda x: x["place"])), F.array_max(F.transform(limbs, lambda x: x["place"]))
    places, zero = F.sequence(lowest - 2, highest + 3), F.lit(0).cast(_WHOLE)

    def at(place: Column) -> Column:
        def add(total: Column, x: Column) -> Column:
            down = x["place"] - place
            part = F.when(down == 0, x["high"]).when(down == 1, x["middle"]).when(down == 2, x["low"]).otherwise(zero)
            return (total + part).cast(_WHOLE)

        return F.struct(place.alias("place"), F.aggregate(limbs, zero, add).alias("total"))

    nothing = F.struct(zero.alias("carry"), F.array().cast("array<struct<place:int,whole:bigint>>").alias("done"))
    half, base = F.lit(2 ** (BITS - 1)).cast(_WHOLE), F.lit(2**BITS).cast(_WHOLE)

    def carry(state: Column, limb: Column) -> Column:
        total = (limb["total"] + state["carry"]).cast(_WHOLE)
        rest = (F.pmod((total + half).cast(_WHOLE), base) - half).cast("bigint")
        over = (total - rest.cast(_WHOLE)).cast(_WHOLE) / base
        kept = F.when(rest != 0, F.array(F.struct(limb["place"].alias("place"), rest.alias("whole"))))
        done = F.concat(state["done"], F.coalesce(kept, F.array().cast("array<struct<place:int,whole:bigint>>")))
        return F.struct(over.cast(_WHOLE).alias("carry"), done.alias("done"))

    return F.when(F.size(limbs) > 0, F.aggregate(F.transform(places, at), nothing, carry, lambda state: state["done"]))


def put_together(df: DataFrame, name: str) -> DataFrame:
    """Add up the four highest of the ``carried`` places in ``__name``; ``__odd_name``, if not NULL, takes their place."""
    df = df.withColumnRenamed(f"__{name}", "__whole")
    df = df.withColumn("__top", F.get("__whole", F.size("__whole") - 1)["place"])

    def below(steps: int) -> Column:
        found = F.filter("__whole", lambda x: x["place"] == F.col("__top") - steps)
        return F.coalesce(F.get(found, 0)["whole"], F.lit(0)).cast("double") * BASE ** (3 - steps)

    # Columns of their own, one after another: as one expression each would be worked out many times over.
    a, b, c, d, first, left, total = (F.col(f"__{x}") for x in ("a", "b", "c", "d", "first", "left", "total"))
    for step in (
        {"__a": below(0), "__b": below(1), "__c": below(2), "__d": below(3)},
        {"__first": a + b},
        {"__left": b - (first - a) + c},  # whole numbers of less than 53 bits, so far without an error
        {"__total": first + left, "__scale": _power(F.col("__top") - 3)},
        {"__rest": left - (total - first) + d},
    ):
        df = df.withColumns(step)
    empty, scale, odd = F.when(F.size("__whole") == 0, F.lit(0.0)), F.col("__scale"), F.col(f"__odd_{name}")
    found = {
        name: F.coalesce(odd, empty, total * scale * scale),  # NULL if there is no place at all
        name + _REST: F.when(odd.isNotNull(), F.lit(0.0)).otherwise(F.coalesce(empty, F.col("__rest") * scale * scale)),
    }
    used = ("whole", "top", "a", "b", "c", "d", "first", "left", "total", "scale", "rest")
    return df.withColumns(found).drop(f"__odd_{name}", *[f"__{x}" for x in used])
