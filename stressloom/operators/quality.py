"""Column canonicalisation, presets, guards and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import eventjoin as ev

# Accepted spellings of the channel names, compared in lower case.
CHANNEL_ALIASES = {
    "stablecoin_risk": ["stablecoin_risk", "scr", "stablecoin"],
    "defi_liquidity_risk": ["defi_liquidity_risk", "defi_liquidity", "dlr", "defi"],
    "contagion_risk": ["contagion_risk", "contagion", "cr"],
    "arbitrage_opacity": ["arbitrage_opacity", "opacity", "or", "regulatory_opacity"],
}
RANGE_PRESETS = {"30D": 30, "90D": 90, "1Y": 365}


def canonical(df: DataFrame, keep: list[str]) -> DataFrame:
    """The four channels under their canonical names and order; an error names what is missing."""
    have = {c.lower(): c for c in df.columns}
    cols, missing = [], []
    for name, spellings in CHANNEL_ALIASES.items():
        hit = next((have[s] for s in spellings if s in have), None)
        if hit is None:
            missing.append(name)
        else:
            cols.append(F.col(hit).alias(name))
    if missing:
        raise ValueError(f"channels not found: {missing}")
    return df.select(*keep, *cols)


def complete_rows(df: DataFrame) -> DataFrame:
    """NaN and NULL are one missing value; rows with a missing channel are dropped."""
    for c in S.CHANNELS:
        df = df.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return df.na.drop(subset=S.CHANNELS)


def range_presets(df: DataFrame) -> DataFrame:
    """Rows inside each preset, counted back from the last date of their series."""
    last = df.groupBy("series_id").agg(F.max("ds").alias("_last"))
    age = F.datediff("_last", "ds")
    d = df.join(last, "series_id")
    names = F.array(*[F.when(age <= n, F.lit(k)) for k, n in RANGE_PRESETS.items()], F.lit("All"))
    return d.withColumn("preset", F.explode(F.array_compact(names))).select("preset", *df.columns)


def window_status(series: DataFrame, events: DataFrame, least_est: int = 20, least_evt: int = 5) -> DataFrame:
    w = ev.event_window(series.select("series_id", "ds"), events, 90, 10)
    g = w.groupBy("series_id", "event").agg(F.count_if(F.col("rel") <= -31).alias("n_est"), F.count_if(F.col("rel") >= -30).alias("n_evt"))
    status = F.when(F.col("n_est") < least_est, "short estimation").when(F.col("n_evt") < least_evt, "short event").otherwise("ok")
    return g.withColumn("status", status)


def consistency(stored: DataFrame) -> DataFrame:
    """Rows whose stored value differs from the recomputed one, and rows whose label is not the band of the value."""
    right = F.round(F.round(fn.composite(), 6), 1)
    return stored.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.round("idx", 1).eqNullSafe(right)).alias("value_mismatches"),
        F.count_if(fn.alert_four("idx") != F.col("alert_level")).alias("band_mismatches"))


def latest_channel(panel: DataFrame, channel: str) -> DataFrame:
    if channel not in S.CHANNEL_WEIGHTS:
        raise ValueError(f"unknown channel {channel}")
    return panel.groupBy("series_id").agg(F.max_by(channel, "ds").alias("value")).withColumn("weight", F.lit(S.CHANNEL_WEIGHTS[channel])).withColumn("channel", F.lit(channel))


def common_keys(df: DataFrame, group: str, key: str) -> DataFrame:
    """Keys that occur in every group."""
    n = df.groupBy().agg(F.countDistinct(group).alias("_all")).withColumn("_k", F.lit(1))
    per = df.select(group, key).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(1))
    return per.join(n, "_k").filter(F.col("_n") == F.col("_all")).select(key)
