"""Alignment of series: common dates, common positions, lag designs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr


def inner_dates(a: DataFrame, b: DataFrame, x: str, y: str) -> DataFrame:
    """Rows present in both with both values known."""
    j = a.select("series_id", "ds", F.col(x).alias("x")).join(b.select("series_id", "ds", F.col(y).alias("y")), ["series_id", "ds"])
    return j.na.drop(subset=["x", "y"])


def against(series: DataFrame, other: str, value: str) -> DataFrame:
    """Every series next to one chosen series on equal dates."""
    o = series.filter(F.col("series_id") == other).select("ds", F.col(value).alias("y"))
    return series.filter(F.col("series_id") != other).select("series_id", "ds", F.col(value).alias("x")).join(o, "ds")


def positions(df: DataFrame, from_end: bool = False) -> DataFrame:
    order = F.desc("ds") if from_end else F.asc("ds")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy(order)))


def positional(series: DataFrame, other: str, value: str, from_end: bool = False) -> DataFrame:
    """Pair by row position, truncated to the shorter series."""
    d = positions(series.filter(F.col(value).isNotNull()).select("series_id", "ds", value), from_end)
    o = d.filter(F.col("series_id") == other).select("pos", F.col(value).alias("y"))
    return d.filter(F.col("series_id") != other).select("series_id", "ds", "pos", F.col(value).alias("x")).join(o, "pos")


def tail_aligned_correlation(series: DataFrame, other: str, value: str) -> DataFrame:
    """Correlation of simple returns after aligning both price lists at their ends."""
    p = positional(series, other, value, from_end=True)
    w = Window.partitionBy("series_id").orderBy("ds")
    r = p.select("series_id", (F.try_divide(F.col("x"), F.lag("x").over(w)) - 1).alias("rx"), (F.try_divide(F.col("y"), F.lag("y").over(w)) - 1).alias("ry"))
    r = finite_pairs(r, "rx", "ry")
    return r.groupBy("series_id").agg(F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(corr("rx", "ry")).alias("r"))


def finite_pairs(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return df


def lag_design(df: DataFrame, cols: list[str], lags: int) -> DataFrame:
    """Columns c_1..c_p of lagged values per series, rows without full history removed."""
    w = Window.partitionBy("series_id").orderBy("ds")
    out = df.select("series_id", "ds", *cols, *[F.lag(c, i).over(w).alias(f"{c}_{i}") for c in cols for i in range(1, lags + 1)])
    return out.na.drop()
