"""Rolling estimators whose window content is a bounded array next to each row."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom.functions import arrays as A
from stressloom.operators import aggregates as ag
from stressloom.operators.windows import by_day
from stressloom.session import spread


def delta_covar(paired: DataFrame, width: int = 90, alpha: float = 0.05) -> DataFrame:
    """Conditional-quantile difference over the previous `width` rows, labelled at the next row. The window travels as
    an array of fixed length, so rows are not multiplied."""
    w = by_day().rowsBetween(-width, -1)
    d = spread(paired, "series_id").select("series_id", "ds", F.collect_list(F.struct("asset", "system")).over(w).alias("_w")).filter(F.size("_w") == width)
    asset = lambda w: F.transform(w, lambda p: p["asset"])
    system = lambda w, cond: F.array_sort(F.transform(F.filter(w, cond), lambda p: p["system"]))
    q = A.quantile_of_sorted

    def conditional(w):  # pairs sorted by asset
        cuts = A.let(asset(w), lambda a: F.struct(
            q(a, alpha).alias("lo"), q(a, 0.10).alias("lo2"), q(a, 0.40).alias("m0"), q(a, 0.60).alias("m1")))

        def with_cuts(c):
            few = F.size(F.filter(w, lambda p: p["asset"] <= c["lo"])) < 10
            cut = F.when(few, c["lo2"]).otherwise(c["lo"])
            low = A.let(cut, lambda t: A.let(system(w, lambda p: p["asset"] <= t), lambda s: q(s, alpha)))
            mid = A.let(system(w, lambda p: (p["asset"] >= c["m0"]) & (p["asset"] <= c["m1"])), lambda s: q(s, alpha))
            return low - mid

        return A.let(cuts, with_cuts)

    return d.select("series_id", "ds", A.let(F.array_sort("_w"), conditional).alias("delta_covar"))


def lead_scan(pairs: DataFrame, max_lag: int = 30) -> DataFrame:
    """Lag in 0..max_lag with the largest absolute rank correlation of x[t] with y[t+lag]; the smallest lag wins a tie.
    Ranks are taken inside each (series, lag) sample, so lags run in parallel."""
    ahead = F.collect_list("y").over(by_day().rowsBetween(0, max_lag))
    d = spread(pairs, "series_id").select("series_id", "ds", "x", ahead.alias("_y"))
    d = d.select("series_id", "ds", "x", F.posexplode("_y").alias("lag", "y"))
    keys = ["series_id", "lag"]
    r = d.select(*keys, ag.average_rank("x", keys).alias("rx"), ag.average_rank("y", keys).alias("ry"))
    c = r.groupBy(*keys).agg(F.abs(corr("rx", "ry")).alias("strength"))
    best = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.round("strength", 12)), "lag"))
    return c.withColumn("_rn", best).filter("_rn = 1").drop("_rn")


def expanding_quantiles(df: DataFrame, cols: list[str], q: float) -> DataFrame:
    """Exact quantile of all rows so far, current row included, as q_<col>, with the row number n. The frame grows, so
    a window function would sort it again at each row; one insertion into an ordered list per row does not. One task
    holds one series, which the calendar bounds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds").reset_index(drop=True)
        for c in cols:
            seen, out = [], []
            for v in pdf[c].tolist():
                bisect.insort(seen, v)
                h = (len(seen) - 1) * q
                k = int(h)
                nxt = seen[k + 1] if k + 1 < len(seen) else seen[k]
                out.append(seen[k] + (h - k) * (nxt - seen[k]))
            pdf["q_" + c] = out
        pdf["n"] = range(1, len(pdf) + 1)
        return pdf

    schema = T.StructType(list(df.schema.fields) + [T.StructField("q_" + c, T.DoubleType()) for c in cols] + [T.StructField("n", T.LongType())])
    return spread(df, "series_id").groupBy("series_id").applyInPandas(run, schema)
