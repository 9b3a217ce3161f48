"""Statistics of short arrays (event windows) as column expressions; sizes are bounded by window constants.

Projections may be merged by the optimiser, and an expression used inside a lambda is then evaluated once per
element. `let` binds a value to a lambda variable, so it is evaluated once per row.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def asum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def amean(a: Column) -> Column:
    return asum(a) / F.nullif(F.size(a), F.lit(0))


def minus(a: Column, m: Column) -> Column:
    return let(m, lambda c: F.transform(a, lambda x: x - c))


def adev(a: Column) -> Column:
    """Array minus its mean."""
    return let(a, lambda v: minus(v, amean(v)))


def astd(a: Column) -> Column:
    """Sample standard deviation."""
    ss = let(adev(a), lambda e: F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(F.size(a) > 1, F.sqrt(ss / (F.size(a) - 1)))


def autocov_sum(e: Column, k: Column) -> Column:
    """sum_t e[t]*e[t-k] over an array that is already demeaned."""
    n = F.size(e)
    lead, lagged = F.slice(e, k + 1, n - k), F.slice(e, F.lit(1), n - k)
    return F.aggregate(F.arrays_zip(lead.alias("a"), lagged.alias("b")), F.lit(0.0), lambda s, p: s + p["a"] * p["b"])


def running(e: Column) -> Column:
    """Prefix sums with a leading zero."""
    return F.aggregate(e, F.array(F.lit(0.0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))


def long_run_sum(e: Column, lags: int) -> Column:
    """Bartlett-weighted sum of autocovariance sums up to `lags` of a demeaned array.

    The weights 1 - k/(L+1) make this the mean square of the sums over all L+1 long stretches of the zero-padded
    array, which prefix sums give in one pass instead of one pass per lag.
    """

    def body(p: Column) -> Column:
        n = F.size(p) - 1
        ends = F.sequence(F.lit(1), n + lags)
        cut = lambda s: F.element_at(p, F.least(s, n) + 1) - F.element_at(p, F.greatest(s - lags - 1, F.lit(0)) + 1)
        return F.aggregate(ends, F.lit(0.0), lambda acc, s: acc + F.pow(cut(s), F.lit(2.0))) / F.lit(float(lags + 1))

    return let(running(e), body)


def ar1(e: Column) -> Column:
    return let(e, lambda v: autocov_sum(v, F.lit(1)) / F.nullif(autocov_sum(v, F.lit(0)), F.lit(0.0)))


def ljung_box(e: Column, lags: int) -> Column:
    def body(v: Column) -> Column:
        n = F.size(v)
        tail = lambda g: F.aggregate(F.sequence(F.lit(1), F.lit(lags)), F.lit(0.0), lambda s, k: s + F.pow(autocov_sum(v, k) / g, F.lit(2.0)) / (n - k))
        return F.when(n > lags + 1, n * (n + 2) * let(autocov_sum(v, F.lit(0)), tail))

    return let(e, body)


def quantile_of_sorted(s: Column, q: float) -> Column:
    """Linear-interpolated quantile of an ascending array."""
    h = (F.size(s) - 1) * F.lit(q)
    lo = F.floor(h).cast("int")
    return F.try_element_at(s, lo + 1) * (1 - (h - lo)) + F.coalesce(F.try_element_at(s, lo + 2), F.lit(0.0)) * (h - lo)
