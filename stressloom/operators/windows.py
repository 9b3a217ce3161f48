"""Rolling, trailing and expanding windows per series.

Every input is a daily table with at most one row per (series_id, ds): a partition is bounded by the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions import scoring as fn


def by_day(keys=("series_id",), order="ds"):
    return Window.partitionBy(*keys).orderBy(order)


def epoch_day(c="ds") -> Column:
    return F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))


def day_range(lo: int, hi: int, keys=("series_id",), ds="ds"):
    """Window frame in calendar days relative to the current row."""
    return Window.partitionBy(*keys).orderBy(epoch_day(ds)).rangeBetween(lo, hi)


def last_rows(n: int, keys=("series_id",), order="ds"):
    return by_day(keys, order).rowsBetween(-(n - 1), 0)


def expanding(keys=("series_id",), order="ds"):
    return by_day(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def trailing_days(df: DataFrame, days: int, **aggs: Column) -> DataFrame:
    w = day_range(-days, 0)
    return reduce(lambda d, kv: d.withColumn(kv[0], kv[1].over(w)), aggs.items(), df)


def full_window(agg: Column, n: int, counted: str, w=None) -> Column:
    """Aggregate over the last n rows, null until n values are there."""
    w = w or last_rows(n)
    return F.when(F.count(counted).over(w) >= n, agg.over(w))


def board(panel: DataFrame) -> DataFrame:
    """Composite, 30-row average, alert band and trend per day."""
    p = panel.select("series_id", "ds", "idx").withColumn("avg_30", F.avg("idx").over(last_rows(30)))
    return p.select(
        "series_id", "ds", "idx", "avg_30",
        fn.alert_four("idx").alias("alert_level"),
        fn.trend_vs_avg("idx", "avg_30").alias("trend"),
    )
