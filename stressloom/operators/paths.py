"""Forward paths, expanding confidence bands, runs, breaks and detrending per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.operators.windows import by_day, expanding



def forward_drawdown(df: DataFrame, ret: str, width: int) -> DataFrame:
    """Worst compounded fall over ret[i .. i+width-1], the running peak starting at the first compounded point; null
    in the last `width` rows. One bounded array per row and a fold over it."""
    w = by_day().rowsBetween(0, width - 1)
    ahead = F.count(F.lit(1)).over(by_day().rowsBetween(1, width))
    start = F.struct(F.lit(1.0).alias("c"), F.lit(0.0).alias("p"), F.lit(0.0).alias("dd"))

    def step(s, r):
        c = s["c"] * (1.0 + r)
        p = F.greatest(s["p"], c)
        return F.struct(c.alias("c"), p.alias("p"), F.least(s["dd"], (c - p) / p).alias("dd"))

    d = df.withColumn("_path", F.collect_list(F.coalesce(ret, F.lit(0.0))).over(w)).withColumn("_ahead", ahead)
    dd = F.aggregate("_path", start, step, lambda s: s["dd"])
    return d.withColumn("drawdown", F.when(F.col("_ahead") >= width, dd)).drop("_path", "_ahead")


def forward_labels(df: DataFrame, ret: str, width: int = 30, threshold: float = -0.20) -> DataFrame:
    d = forward_drawdown(df, ret, width)
    return d.withColumn("label", F.coalesce((F.col("drawdown") < threshold).cast("int"), F.lit(0)))


def variance_bounded(x: str, alpha: float = 0.05, bound: float = 2500.0) -> tuple[Column, Column, Column]:
    """Running mean and its time-uniform band for a bounded variance, clipped to 0-100."""
    w = expanding()
    t, m = F.count(x).over(w), F.avg(x).over(w)
    half = F.sqrt(2.0 * bound * F.log(2.0 * F.sqrt(t + 1.0) / alpha) / t)
    return m, F.greatest(m - half, F.lit(0.0)), F.least(m + half, F.lit(100.0))


Z_975 = 1.959963984540054


def student_quantile(z: float, df: Column) -> Column:
    """Student quantile from the normal one by the expansion in 1/df; exact to 8 digits from 29 degrees on."""
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    v = df.cast("double")
    return F.lit(z) + g1 / v + g2 / (v * v) + g3 / (v * v * v) + g4 / (v * v * v * v)


def asymptotic_band(x: str, least: int = 30, z: float = Z_975) -> tuple[Column, Column, Column]:
    """Running mean +- crit*sd_pop/sqrt(t), clipped to 0-100: unbounded below `least` rows, Student quantiles up to
    99 rows, then the normal one."""
    w = expanding()
    t, m = F.count(x).over(w), F.avg(x).over(w)
    sd = F.sqrt(F.greatest(F.var_pop(x).over(w), F.lit(1e-6)))
    crit = F.when(t < 100, student_quantile(z, t - 1)).otherwise(F.lit(z))
    half = crit * sd / F.sqrt(t)
    lo = F.when(t < least, F.lit(0.0)).otherwise(F.greatest(m - half, F.lit(0.0)))
    hi = F.when(t < least, F.lit(100.0)).otherwise(F.least(m + half, F.lit(100.0)))
    return m, lo, hi


def runs(df: DataFrame, state: str) -> DataFrame:
    """Run number of equal consecutive states."""
    w = by_day()
    change = F.coalesce((F.col(state) != F.lag(state).over(w)).cast("int"), F.lit(1))
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(expanding())).drop("_c")


def cusum(df: DataFrame, x: str) -> DataFrame:
    """cumsum(x - mean)/(sd_pop * sqrt n)."""
    every = Window.partitionBy("series_id")
    mu, sd, n = F.avg(x).over(every), F.stddev_pop(x).over(every), F.count(x).over(every)
    d = df.withColumn("_r", F.col(x) - mu).withColumn("_s", sd * F.sqrt(n))
    return d.withColumn("cusum", F.sum("_r").over(expanding()) / F.col("_s")).drop("_r", "_s")


def spaced_breaks(df: DataFrame, critical: float = 1.36, gap: int = 30) -> DataFrame:
    """Breach positions more than `gap` rows after the last kept one, first to last. The fold runs over the breach
    positions of one series, a calendar-bounded list."""
    d = df.withColumn("pos", F.row_number().over(by_day()))
    hits = d.filter(F.abs("cusum") > critical).groupBy("series_id").agg(F.array_sort(F.collect_list("pos")).alias("_p"))
    keep = F.aggregate(
        "_p", F.array().cast("array<int>"),
        lambda acc, p: F.when((F.size(acc) == 0) | (p - F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) > gap), F.array_append(acc, p)).otherwise(acc))
    kept = hits.select("series_id", F.explode(keep).alias("pos"))
    return kept.join(d.select("series_id", "pos", "ds"), ["series_id", "pos"]).select("series_id", F.col("ds").alias("break_date"))


def detrend(df: DataFrame, x: str, how: str) -> DataFrame:
    """linear: residual of a line in the row number; quadratic: of a parabola; difference; log_difference."""
    w, every = by_day(), Window.partitionBy("series_id")
    if how == "difference":
        return df.withColumn("out", F.col(x) - F.lag(x).over(w))
    if how == "log_difference":
        return df.withColumn("out", F.log(x) - F.log(F.lag(x).over(w)))
    d = df.withColumn("_t", F.row_number().over(w).cast("double"))
    if how == "linear":
        slope, mid = F.regr_slope(x, "_t").over(every), F.regr_intercept(x, "_t").over(every)
        return d.withColumn("out", F.col(x) - (mid + slope * F.col("_t"))).drop("_t")
    # centred time makes the linear and quadratic parts orthogonal for an even grid
    d = d.withColumn("_u", F.col("_t") - F.avg("_t").over(every)).withColumn("_q", F.col("_u") * F.col("_u"))
    b1, b2 = F.regr_slope(x, "_u").over(every), F.regr_slope(x, "_q").over(every)
    mu, mq = F.avg(x).over(every), F.avg("_q").over(every)
    return d.withColumn("out", F.col(x) - (mu + b1 * F.col("_u") + b2 * (F.col("_q") - mq))).drop("_t", "_u", "_q")


def sample_skew(x: str, w) -> Column:
    """Bias-corrected skewness over a frame."""
    n, s = F.count(x).over(w), F.skewness(x).over(w)
    return F.when(n > 2, s * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def sample_kurtosis(x: str, w) -> Column:
    n, k = F.count(x).over(w), F.kurtosis(x).over(w)
    return F.when(n > 3, ((n + 1.0) * k + 6.0) * (n - 1.0) / ((n - 2.0) * (n - 3.0)))


def quality_band(x, quality, spread: float = 5.0) -> tuple[Column, Column]:
    half = spread * (2.0 - quality)
    return F.greatest(x - half, F.lit(0.0)), F.least(x + half, F.lit(100.0))
