"""Structural breaks, level and trend stationarity, circular-shift tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions import arrays as A
from stressloom.operators.paths import cusum, spaced_breaks
from stressloom.operators.windows import by_day
from stressloom.session import spread


def _ssr(y: str, x: str, cond=None) -> tuple[Column, Column]:
    """Residual sum of squares of a line and the row count, from regression sums."""
    yy, xx = (F.when(cond, F.col(y)), F.when(cond, F.col(x))) if cond is not None else (F.col(y), F.col(x))
    syy, sxx, sxy = F.regr_syy(yy, xx), F.regr_sxx(yy, xx), F.regr_sxy(yy, xx)
    return syy - sxy * sxy / sxx, F.regr_count(yy, xx)


def chow(df: DataFrame, x: str = "idx") -> DataFrame:
    """AR(1) split at the midpoint, F statistic with two coefficients."""
    w = by_day()
    d = df.select("series_id", F.col(x).alias("_y"), F.lag(x).over(w).alias("_x"), (F.row_number().over(w) - 1).alias("_i"), F.count(F.lit(1)).over(Window.partitionBy("series_id")).alias("_n"))
    d = d.filter(F.col("_x").isNotNull())
    first = F.col("_i") < F.floor(F.col("_n") / 2)
    full, _ = _ssr("_y", "_x")
    a, _ = _ssr("_y", "_x", first)
    b, _ = _ssr("_y", "_x", ~first)
    g = d.groupBy("series_id").agg(full.alias("_f"), a.alias("_a"), b.alias("_b"), F.max("_n").alias("n"))
    stat = ((F.col("_f") - F.col("_a") - F.col("_b")) / 2.0) / ((F.col("_a") + F.col("_b")) / (F.col("n") - 4))
    return g.select("series_id", "n", stat.alias("chow"))


def cusum_test(df: DataFrame, x: str = "idx", critical: float = 1.36) -> DataFrame:
    c = cusum(df, x)
    g = c.groupBy("series_id").agg(F.max(F.abs("cusum")).alias("max_cusum"))
    n = spaced_breaks(c, critical).groupBy("series_id").agg(F.count(F.lit(1)).alias("n_breaks"))
    score = 1.0 - F.least(F.col("max_cusum") / (2 * critical), F.lit(1.0))
    return g.join(n, "series_id", "left").select(
        "series_id", "max_cusum", F.coalesce("n_breaks", F.lit(0)).alias("n_breaks"), (F.col("max_cusum") < critical).alias("stable"), score.alias("stability"))


def kpss(df: DataFrame, x: str = "idx", trend: bool = False, keys=("series_id",)) -> DataFrame:
    """Level or trend statistic with Bartlett variance, lag 4*(n/100)^0.25. Lag products come from one ordered array per
    series; a series is bounded by the calendar. A constant series has a null statistic."""
    w, e = by_day(keys), Window.partitionBy(*keys)
    d = df.select(*keys, "ds", F.col(x).alias("_x"), F.row_number().over(w).cast("double").alias("_t"))
    if trend:
        fit = F.regr_intercept("_x", "_t").over(e) + F.regr_slope("_x", "_t").over(e) * F.col("_t")
    else:
        fit = F.avg("_x").over(e)
    d = d.withColumn("_r", F.col("_x") - fit)
    d = d.withColumn("_s", F.sum("_r").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_s") * F.col("_s")).alias("_ss"), F.array_sort(F.collect_list(F.struct("_t", "_r"))).alias("_p"))
    g = g.withColumn("_e", F.transform("_p", lambda p: p["_r"])).withColumn("lags", F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(0.25))).cast("int"))
    ks = F.sequence(F.lit(1), F.col("lags"))
    tail = F.aggregate(ks, F.lit(0.0), lambda s, k: s + (1.0 - k / (F.col("lags") + 1.0)) * A.autocov_sum(F.col("_e"), k))
    s2 = (A.autocov_sum(F.col("_e"), F.lit(0)) + 2.0 * tail) / F.col("n")
    return g.select(*keys, "n", "lags", (F.col("_ss") / F.nullif(F.col("n") * F.col("n") * s2, F.lit(0.0))).alias("kpss"))


def circular_shift(df: DataFrame, onset: str, x: str, lag: int = 1, lead_window: int | None = None) -> DataFrame:
    """Mean value ahead of the onsets against all circular shifts of the onset pattern.

    The statistic of every shift is a circular cross-correlation, computed at once by a Fourier transform of the
    calendar-bounded series, instead of pairing shifts with onsets.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        o, v = pdf["_o"].to_numpy(float), pdf["_x"].to_numpy(float)
        n = int(o.sum())
        if n == 0:
            return pd.DataFrame([[pdf["series_id"].iloc[0], None, None, None, 0]], columns=cols)
        src = np.roll(v, lag) if lead_window is None else sum(np.roll(v, k) for k in range(1, lead_window + 1)) / lead_window
        stat = np.fft.irfft(np.conj(np.fft.rfft(o)) * np.fft.rfft(src), len(v)) / n
        p = (1 + int((stat >= stat[0] - 1e-9).sum())) / (1 + len(v))
        return pd.DataFrame([[pdf["series_id"].iloc[0], float((src * o).sum() / n), float(stat.mean()), p, n]], columns=cols)

    cols = ["series_id", "observed", "null_mean", "p", "n_onsets"]
    d = df.select("series_id", "ds", F.col(onset).cast("double").alias("_o"), F.col(x).cast("double").alias("_x"))
    return spread(d, "series_id").groupBy("series_id").applyInPandas(run, "series_id string, observed double, null_mean double, p double, n_onsets bigint")
