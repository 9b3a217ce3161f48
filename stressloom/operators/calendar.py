"""Calendars: full daily index per series, forward and backward fill, stepped targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_calendar(df: DataFrame, keys: list[str], step: int = 1) -> DataFrame:
    """One row per key and date between the first and last date of the key."""
    span = df.groupBy(*keys).agg(F.min("ds").alias("_a"), F.max("ds").alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", F.expr(f"interval {step} day"))).alias("ds"))


def fill_calendar(df: DataFrame, keys: list[str], cols: list[str], backfill: bool = True) -> DataFrame:
    full = daily_calendar(df, keys).join(df.select(*keys, "ds", *cols), [*keys, "ds"], "left")
    w = Window.partitionBy(*keys).orderBy("ds")
    ahead, behind = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    def filled(c):
        f = F.last(c, ignorenulls=True).over(ahead)
        return (F.coalesce(f, F.first(c, ignorenulls=True).over(behind)) if backfill else f).alias(c)
    return full.select(*keys, "ds", *[filled(c) for c in cols])
