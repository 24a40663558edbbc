"""Numbers: NaN, rounding, safe ratios and number-to-text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(value: Column) -> Column:
    """NaN means "no value" at the sources; here that is NULL."""
    return F.when(~F.isnan(value), value)


def try_number(text: Column) -> Column:
    """Text to DOUBLE; NULL where the text is no number."""
    return no_nan(text.try_cast("double"))


def round_at(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled double.

    ``F.round`` goes through the decimal text of the double and so rounds 1.005
    to 1.01; scaling first gives 1.0, as the published results have it.  Plain
    double arithmetic: ``rint`` rounds a half to even, so halves are moved by
    hand.  The sign of a negative that rounds to zero is kept.
    """
    scale = F.lit(float(10**digits))
    scaled = value * scale
    nearest = F.rint(scaled)
    is_half = F.abs(scaled - nearest) == 0.5
    return F.when(is_half, scaled + F.signum(scaled) * 0.5).otherwise(nearest) / scale


def exact_sum(amount: Column, digits: int = 2) -> Column:
    """Sum of amounts of at most ``digits`` decimals, the same in any row order.

    Summed as whole units in a BIGINT and turned into a DOUBLE once per group;
    an overflow fails the query.
    """
    units = F.sum(F.rint(amount * float(10**digits)).cast("bigint"))
    step = F.lit(Decimal(1).scaleb(-digits))
    return (units.cast("decimal(20,0)") * step).cast("double")


def mean_of(amount: Column, digits: int | None = None) -> Column:
    """Mean; with ``digits`` the amounts have at most that many decimals, and
    the mean is the same in any row order, to the last bit."""
    if digits is None:
        return F.avg(amount)
    return F.try_divide(exact_sum(amount, digits), F.count(amount))


def ratio(part: Column, whole: Column) -> Column:
    """Quotient, NULL where the divisor is zero or NULL."""
    return F.try_divide(part, whole)


def number_text(value: Column, digits: int) -> Column:
    """Rounded double as the shortest plain text: ``-0.9``, ``5.0``, ``12345678.9``.

    Plain digits up to 1e15; Spark's own cast would switch to ``1.23E7``.
    """
    rounded = round_at(value, digits)
    plain = rounded.cast(f"decimal(38,{digits})").cast("string")
    short = F.rtrim(plain, F.lit("0"))
    shortest = F.when(short.endswith("."), F.concat(short, F.lit("0"))).otherwise(short)
    return F.when((rounded == 0) & (value < 0), F.lit("-0.0")).otherwise(shortest)
