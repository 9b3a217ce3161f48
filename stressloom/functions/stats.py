"""Aggregates that stay null where the built-in would divide by zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-24


def corr(x, y) -> Column:
    """Correlation over complete pairs; null when either side is constant up to rounding. Built from the regression sums:
    the built-in evaluates its division before any guard around it."""
    sxx, syy = F.regr_sxx(y, x), F.regr_syy(y, x)
    den = F.when((sxx > TINY) & (syy > TINY), F.sqrt(sxx) * F.sqrt(syy))
    return F.regr_sxy(y, x) / den
