"""Joins of daily series with dated events. An event window is unfolded to its dates, so every range join becomes
an equality join on ds; Spark picks broadcast or shuffle from the size of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unfold(events: DataFrame, before: int | str, after: int | str) -> DataFrame:
    """Rows (event, event_date, rel, ds) for rel in [-before, after]; bounds may be column names."""
    lo = F.col(before) if isinstance(before, str) else F.lit(before)
    hi = F.col(after) if isinstance(after, str) else F.lit(after)
    rel = events.withColumn("rel", F.explode(F.sequence(-lo, hi)))
    return rel.withColumn("ds", F.date_add("event_date", F.col("rel")))


def event_window(series: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    return series.join(unfold(events.select("event", "event_date"), before, after), "ds")


def lead_label(series: DataFrame, events: DataFrame, days: int = 30, name: str = "label") -> DataFrame:
    """1 when some event falls in [ds, ds + days]."""
    marked = unfold(events, days, 0).select("ds").distinct().withColumn(name, F.lit(1))
    return series.join(marked, "ds", "left").withColumn(name, F.coalesce(name, F.lit(0)))


def near_event(events: DataFrame, days: int, inclusive: bool) -> DataFrame:
    """Distinct dates closer to an event than `days` (or at most that far)."""
    d = days if inclusive else days - 1
    return unfold(events, d, d).select("ds").distinct()


def eligible_dates(series: DataFrame, events: DataFrame, gap: int = 90, margin: int = 90) -> DataFrame:
    """Dates at least `gap` days from every event and `margin` days inside the span of their series."""
    span = series.groupBy("series_id").agg(F.min("ds").alias("_lo"), F.max("ds").alias("_hi"))
    far = series.join(near_event(events, gap, inclusive=False), "ds", "left_anti")
    return (
        far.join(span, "series_id")
        .filter((F.col("ds") >= F.date_add("_lo", margin)) & (F.col("ds") <= F.date_sub("_hi", margin)))
        .drop("_lo", "_hi")
    )


def alert_event_hits(series: DataFrame, events: DataFrame, threshold: float, days: int = 30) -> DataFrame:
    """Alert rows (idx > threshold) flagged when an event follows within (0, days]; events flagged when any alert
    precedes within [1, days] days. Returns per series: alerts, true alerts, events, detected events."""
    alerts = series.filter(F.col("idx") > threshold).select("series_id", "ds")
    ahead = unfold(events.select("event", "event_date"), days, -1)
    hit = alerts.join(ahead, "ds")
    tp = hit.groupBy("series_id").agg(F.countDistinct("ds").alias("tp"), F.countDistinct("event").alias("detected"))
    n = alerts.groupBy("series_id").agg(F.count(F.lit(1)).alias("alerts"))
    ids = series.select("series_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return ids.join(n, "series_id", "left").join(tp, "series_id", "left").select("series_id", zero("alerts"), zero("tp"), zero("detected"))
