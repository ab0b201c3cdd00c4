"""Exact sums of money.

A sum of doubles changes in its last digits with the order of the rows, so two runs over the same 100 TB would not agree.
Here an amount that is a whole number of units (cents by default) is summed in BIGINT, in two halves (20 bits and the rest, which
is a shift and a mask) so that no sum overflows below 8e12 rows per group; any other amount (more decimals, or a billion and more) is summed as
DECIMAL(38, 6), so a seventh decimal is lost. Nothing else is rounded before the end, and what is no number, or out of the range of a decimal, fails the job
rather than leave the sum. A missing amount stays missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_BITS = 20
PLAIN_BELOW = 1e9
EXACT = "decimal(38,6)"


def _col(amount: str | Column) -> Column:
    return F.col(amount) if isinstance(amount, str) else amount


def units(amount: str | Column, digits: int = 2) -> Column:
    """Whole units of an amount that is a whole number of them; NULL for any other, which `rest` then holds."""
    amount, scale = _col(amount), float(10**digits)
    whole = F.rint(amount * scale)
    return F.when((F.abs(amount) < PLAIN_BELOW) & (whole / scale == amount), whole.cast("bigint"))


def rest(amount: str | Column, digits: int = 2) -> Column:
    """The amount as a decimal where it is not a whole number of units."""
    return F.when(_col(amount).isNotNull() & units(amount, digits).isNull(), exact(amount))


def exact(amount: str | Column) -> Column:
    """One amount as a decimal; fails where it is no number or out of range."""
    amount = _col(amount)
    wrong = F.isnan(amount) | (F.abs(amount) >= 1e32)
    return F.when(wrong, F.raise_error(F.concat(F.lit("not an amount of money: "), amount.cast("string"))).cast(EXACT)).otherwise(amount.cast(EXACT))


def _unit(digits: int) -> Column:
    return F.lit(f"{10.0**-digits:.{digits}f}").cast(f"decimal({digits},{digits})")


def total_of(whole: Column, others: Column, digits: int = 2) -> Column:
    """Exact sum of units and of the amounts that are none, as a decimal."""
    high, low = F.sum(F.shiftright(whole, HALF_BITS)), F.sum(whole.bitwiseAND(F.lit(2**HALF_BITS - 1)))
    joined = (high.cast("decimal(20,0)") * F.lit(2**HALF_BITS).cast("decimal(7,0)") + low.cast("decimal(20,0)")) * _unit(digits)
    other = F.sum(others)
    return F.when(high.isNotNull() | other.isNotNull(), F.coalesce(joined.cast(EXACT), F.lit(0).cast(EXACT)) + F.coalesce(other, F.lit(0).cast(EXACT)))


def total_exact(amount: str | Column, digits: int = 2) -> Column:
    """Exact sum of amounts, as a decimal."""
    return total_of(units(amount, digits), rest(amount, digits), digits)


def total(amount: str | Column, digits: int = 2) -> Column:
    """Exact sum of amounts, as DOUBLE: rounded once, here."""
    return total_exact(amount, digits).cast("double")


def mean(amount: str | Column, digits: int = 2) -> Column:
    """Exact sum over the count of amounts that are there."""
    return total(amount, digits) / F.count(_col(amount))


def mean_rounded(amount: str | Column, digits: int = 2) -> Column:
    """Mean rounded half up to a whole unit, in decimals: a mean of 41.545 is not 41.54499 first."""
    sums, count = total_exact(amount, digits), F.count(_col(amount)).cast("decimal(20,0)")
    doubled = (F.abs(sums) * F.lit(2 * 10**digits).cast("decimal(6,0)")).cast(EXACT) + count
    by = (count * F.lit(2).cast("decimal(1,0)")).cast(EXACT)
    rounded = ((doubled - F.pmod(doubled, by)).cast("double") / by.cast("double")).cast("double")
    return F.signum(sums.cast("double")) * F.rint(rounded) / F.lit(float(10**digits))


def net_units(price: str | Column, discount: str | Column) -> Column:
    """Ten-thousandths of price less discount share, both with two decimals; NULL where either has more.

    Used for a column of its own: the sum reads it twice, and the units are found once.
    """
    return units(price) * (F.lit(100).cast("bigint") - units(discount))


def net_total(net: Column, price: str | Column, discount: str | Column) -> Column:
    """Exact sum of net prices, as a decimal, from a column of `net_units` and, where that is NULL, from decimals."""
    price, discount = _col(price), _col(discount)
    other = exact(price) * exact(F.round(F.lit(1.0) - discount, 6))
    return total_of(net, F.when(net.isNull() & price.isNotNull() & discount.isNotNull(), other.cast(EXACT)), 4)
