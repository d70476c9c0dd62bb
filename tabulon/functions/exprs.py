"""Column-expression helpers that carry the reference's missing-value semantics.

All of these are built-in Catalyst expressions (no Python UDF), so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- comparisons
def ne_keep_null(x: str | Column, value) -> Column:
    """``x != v`` that keeps missing rows (pandas: NaN != v is True)."""
    return ~c(x).eqNullSafe(F.lit(value))


def eq_flag(x: str | Column, value) -> Column:
    """1 when ``x == value`` else 0; a missing x gives 0."""
    return F.when(c(x).eqNullSafe(F.lit(value)), F.lit(1)).otherwise(F.lit(0))


def any_null(cols: Iterable[str | Column]) -> Column:
    return reduce(operator.or_, [c(x).isNull() for x in cols])


def count_equal(cols: Sequence[str | Column], value) -> Column:
    """How many of ``cols`` equal ``value`` (F17); missing counts as not equal."""
    return reduce(operator.add, [eq_flag(x, value) for x in cols])


# ---------------------------------------------------------------- arithmetic
def safe_ratio(a: str | Column, b: str | Column, eps: float = 0.0) -> Column:
    """``a / (b + eps)``; a zero denominator gives NULL instead of +-inf."""
    den = c(b) + F.lit(float(eps)) if eps else c(b)
    return F.try_divide(c(a).cast("double"), den.cast("double"))


def trunc_to_int(x: str | Column) -> Column:
    """Python ``int(x)``: truncation toward zero, kept as double."""
    return F.when(c(x) >= 0, F.floor(c(x))).otherwise(F.ceil(c(x))).cast("double")


def product(cols: Sequence[str | Column]) -> Column:
    """Product of columns in double (ANSI would raise on long overflow)."""
    return reduce(operator.mul, [c(x).cast("double") for x in cols])


# ---------------------------------------------------------------- row statistics
# Written as plain column arithmetic (no lambda functions), so they stay in codegen.
def _d(x):
    return c(x).cast("double")


def row_count(cols: Sequence[str | Column]) -> Column:
    return reduce(operator.add, [F.when(_d(x).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for x in cols])


def row_sum(cols: Sequence[str | Column]) -> Column:
    """Sum skipping missing values; a row with nothing present sums to 0."""
    return reduce(operator.add, [F.coalesce(_d(x), F.lit(0.0)) for x in cols])


def row_mean(cols: Sequence[str | Column]) -> Column:
    """Mean skipping missing values; NULL when nothing is present."""
    return F.try_divide(row_sum(cols), row_count(cols).cast("double"))


def row_std(cols: Sequence[str | Column]) -> Column:
    """Sample std (ddof=1) skipping missing values, two-pass like pandas."""
    n = row_count(cols).cast("double")
    mean = row_mean(cols)
    ss = reduce(operator.add, [F.when(_d(x).isNotNull(), (_d(x) - mean) * (_d(x) - mean)).otherwise(F.lit(0.0))
                               for x in cols])
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def row_min(cols: Sequence[str | Column]) -> Column:
    return F.least(*[c(x).cast("double") for x in cols])


def row_max(cols: Sequence[str | Column]) -> Column:
    return F.greatest(*[c(x).cast("double") for x in cols])


def row_median(cols: Sequence[str | Column]) -> Column:
    """Median skipping missing values: ``sort_array`` puts the nulls first, so the middle
    of the present values is offset by the number of nulls."""
    arr = F.sort_array(F.array(*[_d(x) for x in cols]))
    n = row_count(cols)
    off = F.lit(len(cols)) - n
    mid = F.floor(n / 2).cast("int")
    odd = F.element_at(arr, off + mid + 1)
    even = (F.element_at(arr, off + F.greatest(mid, F.lit(1))) + F.element_at(arr, off + mid + 1)) / 2.0
    return F.when(n == 0, F.lit(None).cast("double")).when(n % 2 == 1, odd).otherwise(even)


# ---------------------------------------------------------------- moments
def skew_g1_to_G1(g1: Column, n: Column) -> Column:
    """Biased skewness g1 (Spark ``skewness``) -> bias-corrected G1 (pandas ``skew``)."""
    nd = n.cast("double")
    return F.when(nd > 2, g1 * F.sqrt(nd * (nd - 1)) / (nd - 2))


def skewtest_z(g1: Column, n: Column) -> Column:
    """D'Agostino's z for skewness as a closed form in (n, g1) (n >= 8)."""
    nd = n.cast("double")
    y = g1 * F.sqrt(((nd + 1) * (nd + 3)) / (6.0 * (nd - 2)))
    beta2 = (3.0 * (nd * nd + 27 * nd - 70) * (nd + 1) * (nd + 3)) / (
        (nd - 2.0) * (nd + 5) * (nd + 7) * (nd + 9))
    w2 = -1 + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y2 = F.when(y == 0, F.lit(1.0)).otherwise(y)
    return F.when(nd >= 8, delta * F.log(y2 / alpha + F.sqrt((y2 / alpha) * (y2 / alpha) + 1)))


def seconds_between(a: str | Column, b: str | Column) -> Column:
    """``(a - b).total_seconds()`` as double.

    ``timestamp_diff`` works on wall-clock (``timestamp_ntz``) values directly,
    so the result does not depend on the session time zone.
    """
    return F.timestamp_diff("MICROSECOND", c(b), c(a)) / 1e6
