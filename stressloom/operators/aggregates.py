"""Aggregations over daily panels: descriptives, rank correlation, tail risk, classification counts.

Daily tables are unique on (series_id, ds), so exact percentiles and per-series ranks work on calendar-bounded
groups. Rank correlation counts discordant pairs level by level on the bits of the rank and never forms pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.session import spread


def unpivot(df: DataFrame, keys: list[str], cols: list[str], name="channel", value="value") -> DataFrame:
    return df.unpivot(keys, cols, name, value)


def returns(df: DataFrame, value: str = "idx", keys=("series_id",)) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ds")
    return df.withColumn("ret", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).filter(F.col("ret").isNotNull())


def describe(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = df.groupBy(*keys).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"),
        q.alias("_q"), F.max(x).alias("max"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurt"),
    ).filter(F.col("n") >= 3)
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    return g.select(
        *keys, "n", "mean", "std", "min", F.col("_q")[0].alias("q25"), F.col("_q")[1].alias("median"),
        F.col("_q")[2].alias("q75"), "max", "skew", "kurt", jb.alias("jb"), F.exp(-jb / 2.0).alias("jb_p"),
    )


def average_rank(x: str, keys: list[str]) -> Column:
    """Rank with ties averaged."""
    first = F.rank().over(Window.partitionBy(*keys).orderBy(x))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, x))
    return first + (ties - 1) / 2.0


def channel_pairs(df: DataFrame, keys: list[str], cols: list[str] | None = None) -> DataFrame:
    """Each unordered pair of columns as (ch_a, ch_b, x, y) rows; an explode of a literal list, not a join."""
    cols = cols or S.CHANNELS
    pairs = [
        F.struct(F.lit(a).alias("ch_a"), F.lit(b).alias("ch_b"), F.col(a).alias("x"), F.col(b).alias("y"))
        for i, a in enumerate(cols) for b in cols[i + 1:]
    ]
    return df.select(*keys, F.inline(F.array(*pairs)))


def kendall(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Kendall tau-b per key in O(n log n) rows.

    Sort by (x, y); a discordant pair is an earlier row with a strictly larger y-rank. Two ranks first differ at one
    bit: for each bit level, among rows with the same higher bits, count earlier ones at each zero.
    """
    d = spread(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), *keys)
    on = lambda *c: Window.partitionBy(*keys, *c)
    d = d.select(
        *keys,
        (F.row_number().over(on().orderBy(x, y)) - 1).alias("_pos"),
        (F.dense_rank().over(on().orderBy(y)) - 1).alias("_ry"),
        (F.count(F.lit(1)).over(on(x)) - 1).alias("_tx"),
        (F.count(F.lit(1)).over(on(y)) - 1).alias("_ty"),
        (F.count(F.lit(1)).over(on(x, y)) - 1).alias("_txy"),
        F.count(F.lit(1)).over(on()).alias("_n"),
    )
    top = F.length(F.bin(F.col("_n")))
    lev = d.withColumn("_lv", F.explode(F.sequence(F.lit(0), top - 1)))
    bit = F.expr("shiftright(_ry, _lv) & 1")
    lev = lev.withColumn("_hi", F.expr("shiftright(_ry, _lv + 1)")).withColumn("_bit", bit)
    w = Window.partitionBy(*keys, "_lv", "_hi").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    lev = lev.withColumn("_ones", F.coalesce(F.sum("_bit").over(w), F.lit(0)))
    base = F.col("_lv") == 0
    g = lev.groupBy(*keys).agg(
        F.max("_n").cast("double").alias("n"),
        F.sum(F.when(F.col("_bit") == 0, F.col("_ones")).otherwise(0)).cast("double").alias("disc"),
        *[(F.sum(F.when(base, F.col(t)).otherwise(0)) / 2.0).alias(t) for t in ("_tx", "_ty", "_txy")],
    )
    p0 = F.col("n") * (F.col("n") - 1) / 2.0
    num = p0 - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("disc") * 2.0
    den = F.sqrt((p0 - F.col("_tx")) * (p0 - F.col("_ty")))
    return g.select(*keys, F.col("n").cast("bigint").alias("n"), (num / F.nullif(den, F.lit(0.0))).alias("tau"))


def correlations(df: DataFrame, keys: list[str], method: str) -> DataFrame:
    """Correlation of (x, y) per key with its t statistic (normal z for tau)."""
    d = df.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if method == "kendall":
        n = F.col("n")
        se = F.sqrt(2.0 * (2.0 * n + 5.0) / (9.0 * n * (n - 1.0)))
        return kendall(d, keys).select(*keys, "n", F.col("tau").alias("r"), (F.col("tau") / se).alias("t"))
    if method == "spearman":
        d = d.select(*keys, average_rank("x", keys).alias("x"), average_rank("y", keys).alias("y"))
    r = F.col("r")
    t = r * F.sqrt(F.try_divide(F.col("n") - 2, 1.0 - r * r))
    return d.groupBy(*keys).agg(F.count("x").alias("n"), corr("x", "y").alias("r")).withColumn("t", t)


def pair_with(df: DataFrame, system: str, value: str = "ret") -> DataFrame:
    """Each series next to one system series on the same date: (series_id, ds, asset, system)."""
    sysd = df.filter(F.col("series_id") == system).select("ds", F.col(value).alias("system"))
    return df.filter(F.col("series_id") != system).select("series_id", "ds", F.col(value).alias("asset")).join(sysd, "ds")


def covar_from(df: DataFrame, keys: list[str], alpha: float, min_rows: int) -> DataFrame:
    """Conditional quantile of the system under asset distress and at the asset median.

    Two aggregations on the same keys: the thresholds, joined back, then the conditional quantiles.
    """
    th = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("system", alpha).alias("var_system"),
        F.percentile("asset", F.array(*[F.lit(p) for p in (alpha, 0.10, 0.40, 0.60)])).alias("_q"),
    ).filter(F.col("n") >= min_rows)
    d = df.join(th, keys)
    a, q, s = F.col("asset"), F.col("_q"), F.col("system")
    g = d.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("var_system").alias("var_system"),
        F.count_if(a <= q[0]).alias("_n0"),
        F.percentile(F.when(a <= q[0], s), alpha).alias("_d0"),
        F.percentile(F.when(a <= q[1], s), alpha).alias("_d1"),
        F.percentile(F.when((a >= q[2]) & (a <= q[3]), s), alpha).alias("_m"),
    )
    distress = F.when(F.col("_n0") < 10, F.col("_d1")).otherwise(F.col("_d0"))
    return g.select(
        *keys, "n", "var_system", F.coalesce(distress, "var_system").alias("covar_distress"),
        F.coalesce("_m", "var_system").alias("covar_median"),
    ).withColumn("delta_covar", F.col("covar_distress") - F.col("covar_median"))


def covar_historical(df: DataFrame, keys=("series_id",), alpha: float = 0.05, min_rows: int = 50) -> DataFrame:
    return covar_from(df, list(keys), alpha, min_rows)


def tail_dependence(df: DataFrame, keys: list[str], x: str, y: str, threshold: float = 0.10) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    d = df.select(*keys, (average_rank(x, keys) / (n + 1)).alias("u"), (average_rank(y, keys) / (n + 1)).alias("v"))
    u, v, hi = F.col("u"), F.col("v"), 1 - threshold
    up, lo = F.count_if(u > hi), F.count_if(u < threshold)
    g = d.groupBy(*keys).agg(
        F.coalesce(F.count_if((u > hi) & (v > hi)) / F.nullif(up, F.lit(0)), F.lit(0.0)).alias("upper_tail"),
        F.coalesce(F.count_if((u < threshold) & (v < threshold)) / F.nullif(lo, F.lit(0)), F.lit(0.0)).alias("lower_tail"),
    )
    return g.withColumn("asymmetry", F.abs(F.col("upper_tail") - F.col("lower_tail")))


def tail_risk_score(df: DataFrame, keys=("series_id",)) -> DataFrame:
    keys = list(keys)
    c = covar_historical(df, keys)
    t = tail_dependence(df, keys, "asset", "system")
    ratio = F.abs(F.col("delta_covar") / F.nullif(F.col("var_system"), F.lit(0.0)))
    raw = 0.6 * F.coalesce(ratio, F.lit(0.0)) + 0.4 * (F.col("upper_tail") + F.col("lower_tail")) / 2.0
    return t.join(c, keys, "left").select(*keys, (F.least(F.lit(1.0), raw / 0.4) * 100.0).alias("score"))


def confusion_ratios(df: DataFrame, zero_precision: float = 0.0) -> DataFrame:
    """Adds the ratios to columns tp, fp, tn, fn; every empty denominator gives 0."""
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "tn", "fn")}

    def ratio(a, b, empty=0.0):
        return F.when(b > 0, a / b).otherwise(F.lit(empty))

    tp, fp, tn, fn_ = c["tp"], c["fp"], c["tn"], c["fn"]
    out = df.withColumn("precision", ratio(tp, tp + fp, zero_precision)).withColumn("recall", ratio(tp, tp + fn_))
    out = out.withColumn("specificity", ratio(tn, tn + fp))
    p, r, s = F.col("precision"), F.col("recall"), F.col("specificity")
    den = F.sqrt((tp + fp) * (tp + fn_) * (tn + fp) * (tn + fn_))
    return out.withColumns({
        "f1": ratio(2 * p * r, p + r), "youden": r + s - 1.0, "balanced": (r + s) / 2.0,
        "mcc": ratio(tp * tn - fp * fn_, den),
    })


def confusion(df: DataFrame, keys: list[str], label: str, flag: Column) -> DataFrame:
    y = F.col(label) == 1
    g = df.groupBy(*keys).agg(
        F.count_if(y & flag).alias("tp"), F.count_if(~y & flag).alias("fp"),
        F.count_if(~y & ~flag).alias("tn"), F.count_if(y & ~flag).alias("fn"),
    )
    return confusion_ratios(g)


def news_score(h: DataFrame, keys: list[str], terms: list[str], negative: list[str]) -> DataFrame:
    from stressloom.functions import scoring as fn

    reg = fn.has_term("title", terms)
    risk = fn.sentiment_risk("sentiment", fn.has_term("title", negative)) * fn.term_weight("title", terms)
    g = h.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("article_count"), F.count_if(reg).alias("regulatory_count"),
        F.avg("sentiment").alias("avg_sentiment"), F.coalesce(F.avg(F.when(reg, risk)), F.lit(50.0)).alias("reg_score"),
    )
    mood = (1.0 - F.coalesce("avg_sentiment", F.lit(0.0))) / 2.0 * 100.0
    g = g.withColumn("market_mood", mood)
    score = F.when(F.col("article_count") == 0, F.lit(50.0)).otherwise(F.col("reg_score") * 0.7 + F.col("market_mood") * 0.3)
    return g.withColumn("score", score)
