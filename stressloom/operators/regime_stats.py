"""Descriptive statistics of a decoded regime path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S


def with_next(df: DataFrame) -> DataFrame:
    return df.withColumn("_next", F.lead("regime").over(Window.partitionBy("series_id").orderBy("ds")))


def regime_profile(df: DataFrame) -> DataFrame:
    level = reduce(lambda a, b: a + b, [F.col(c) for c in S.CHANNELS]) / 4.0
    g = with_next(df).groupBy("series_id", "regime").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(level).alias("level"), F.avg("idx").alias("mean_idx"),
        F.count_if(F.col("_next") == F.col("regime")).alias("_stay"), F.count("_next").alias("_moves"))
    total = F.sum("_n").over(Window.partitionBy("series_id"))
    return g.select("series_id", "regime", (F.col("_n") / total).alias("frequency"), "level", "mean_idx",
                    (F.col("_stay") / F.nullif(F.col("_moves"), F.lit(0))).alias("persistence"))


def transition_counts(df: DataFrame) -> DataFrame:
    return with_next(df).filter(F.col("_next").isNotNull()).groupBy("series_id", "regime", F.col("_next").alias("next")).agg(F.count(F.lit(1)).alias("n"))
