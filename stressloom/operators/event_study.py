"""Event studies: abnormal signal, lead times, serial-correlation-robust tests, placebo dates, backtests.

Each (series, event) window becomes one short array ordered by relative day (its length is fixed by the profile),
and every statistic is an expression over it. For placebo studies the same arrays come from a calendar window
frame, so each date is an event without any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.functions import arrays as A
from stressloom.functions import scoring as fn
from stressloom.operators import eventjoin as ev
from stressloom.operators.rolling import expanding_quantiles
from stressloom.operators.windows import day_range, epoch_day
from stressloom.session import spread


def window_arrays(series: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(series_id, event, event_date, pts) with pts = array of (rel, x) ordered by rel."""
    w = ev.event_window(series.select("series_id", "ds", "idx"), events, before, after)
    return w.groupBy("series_id", "event", "event_date").agg(
        F.array_sort(F.collect_list(F.struct("rel", F.col("idx").alias("x")))).alias("pts"))


def every_date_arrays(series: DataFrame, before: int, after: int) -> DataFrame:
    """The same arrays with every date of a series as its own event."""
    day = epoch_day()
    pts = F.collect_list(F.struct(day.alias("day"), F.col("idx").alias("x"))).over(day_range(-before, after))
    keep = [c for c in ("eligible",) if c in series.columns]
    d = series.select("series_id", F.col("ds").alias("event_date"), pts.alias("_p"), day.alias("_d"), *keep)
    if keep:
        d = d.filter("eligible")
    rel = A.let(F.col("_d"), lambda c: F.transform("_p", lambda p: F.struct((p["day"] - c).alias("rel"), p["x"].alias("x"))))
    return d.select("series_id", "event_date", rel.alias("pts"))


def part(lo: int, hi: int, pts: str = "pts") -> Column:
    """Values with lo <= rel <= hi."""
    return F.transform(F.filter(F.col(pts), lambda p: (p["rel"] >= lo) & (p["rel"] <= hi)), lambda p: p["x"])


def abnormal(arrays: DataFrame, est, evt, least_est: int = 20, least_evt: int = 5) -> DataFrame:
    """Adds mu, sd, ab (abnormal values), n, cas, t_stat; windows with too few rows are dropped."""
    d = arrays.withColumn("_e", part(*est)).withColumn("_v", part(*evt))
    d = d.filter((F.size("_e") >= least_est) & (F.size("_v") >= least_evt))
    d = d.withColumn("mu", A.amean(F.col("_e"))).withColumn("sd", A.astd(F.col("_e")))
    d = d.withColumn("ab", A.minus(F.col("_v"), F.col("mu"))).withColumn("n", F.size("_v"))
    d = d.withColumn("cas", A.asum(F.col("ab")))
    se = F.col("sd") * F.sqrt(F.col("n"))
    return d.withColumn("t_stat", F.when(se > 0, F.col("cas") / se).otherwise(0.0))


def _first_rel(pts: Column, cond) -> Column:
    """Days before the event of the earliest point that meets the condition; 0 if there is none."""
    hits = F.filter(pts, cond)
    return F.coalesce(-F.try_element_at(hits, F.lit(1))["rel"], F.lit(0))


def lead_sigma(lookback: int, sigma: float = S.LEAD_SIGMA) -> Column:
    thr = F.col("mu") + F.lit(sigma) * F.col("sd")
    return A.let(thr, lambda t: _first_rel(F.col("pts"), lambda p: (p["rel"] >= -lookback) & (p["rel"] <= 0) & (p["x"] > t)))


def lead_level(lookback: int, level: float = S.LEAD_LEVEL) -> Column:
    return _first_rel(F.col("pts"), lambda p: (p["rel"] >= -lookback) & (p["rel"] <= 0) & (p["x"] >= level))


def lead_sustained(lookback: int, level: float = S.LEAD_LEVEL) -> Column:
    """Last up-crossing after which the value stays at or above the level through the event day: the point right
    after the last value below the level, if there is one."""

    def body(look: Column) -> Column:
        last_low = F.try_element_at(F.filter(look, lambda p: p["x"] < level), F.lit(-1))["rel"]
        return A.let(last_low, lambda low: F.coalesce(-F.try_element_at(F.filter(look, lambda p: p["rel"] > low), F.lit(1))["rel"], F.lit(0)))

    return A.let(F.filter("pts", lambda p: (p["rel"] >= -lookback) & (p["rel"] <= 0)), body)


def lead_by(method: str, lookback: int) -> Column:
    return {"first_sigma_breach": lead_sigma, "first_threshold_crossing": lead_level, "final_sustained_threshold": lead_sustained}[method](lookback)


def study(series: DataFrame, events: DataFrame, profile: str = "paper_v2") -> DataFrame:
    p = S.EVENT_PROFILES[profile]
    before = max(-p["est"][0], p["lookback"])
    d = abnormal(window_arrays(series, events, before, p["evt"][1]), p["est"], p["evt"])
    return d.select(
        "series_id", "event", F.lit(profile).alias("profile"), "n", F.col("mu").alias("expected"), F.col("sd").alias("expected_sd"),
        "cas", "t_stat", F.array_max(part(*p["evt"])).alias("peak"), lead_by(p["lead_method"], p["lookback"]).alias("lead_days"))


def lead_times(series: DataFrame, events: DataFrame, lookback: int = 60) -> DataFrame:
    d = abnormal(window_arrays(series, events, 90, 10), (-90, -31), (-30, 10))
    return d.select("series_id", "event", lead_sigma(lookback).alias("first_sigma"), lead_level(lookback).alias("first_level"),
                    lead_sustained(lookback).alias("sustained"))


def hac_columns(e: Column, lags: int) -> Column:
    """(se_mean, t_hac) of the mean of an array with Bartlett weights, bound so that each step runs once per row."""

    def body(v: Column) -> Column:
        m = A.amean(v)
        se = A.let(A.minus(v, m), lambda dev: F.sqrt(A.long_run_sum(dev, lags)) / F.size(dev))
        return A.let(se, lambda s: F.struct(s.alias("se_mean"), (A.amean(v) / F.nullif(s, F.lit(0.0))).alias("t_hac")))

    return A.let(e, body)


def hac(series: DataFrame, events: DataFrame, lags=tuple(S.HAC_LAGS)) -> DataFrame:
    d = abnormal(window_arrays(series, events, 90, 10), (-90, -31), (-30, 10))
    cells = []
    for k in lags:
        cells.append(F.struct(F.lit(k).alias("lag"), F.when(F.col("n") > k, hac_columns(F.col("ab"), k)).alias("_h")))
    out = d.select("series_id", "event", "n", "cas", "t_stat", F.inline(F.array(*cells)))
    out = out.select("series_id", "event", "n", "cas", "t_stat", "lag", "_h.se_mean", "_h.t_hac")
    return out.withColumn("beyond_fixed_b", F.abs("t_hac") > S.FIXED_B_CRITICAL)


def serial_correlation(series: DataFrame, events: DataFrame, lags=(5, 10, 20)) -> DataFrame:
    d = abnormal(window_arrays(series, events, 90, 10), (-90, -31), (-30, 10))
    d = d.withColumn("_est", A.adev(F.col("_e"))).withColumn("_evt", A.adev(F.col("ab")))
    return d.select("series_id", "event", A.ar1(F.col("_est")).alias("ar1_est"), A.ar1(F.col("_evt")).alias("ar1_evt"),
                    *[A.ljung_box(F.col("_evt"), k).alias(f"q{k}") for k in lags])


def placebo_table(series: DataFrame, events: DataFrame, gap: int = 90) -> DataFrame:
    """Robust and naive t at every eligible date. Dates are marked before the frames are built, so the arrays never
    cross a shuffle."""
    ok = ev.eligible_dates(series.select("series_id", "ds"), events, gap, 90).withColumn("eligible", F.lit(True))
    marked = series.select("series_id", "ds", "idx").join(ok, ["series_id", "ds"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    d = abnormal(every_date_arrays(spread(marked, "series_id"), 90, 10), (-90, -31), (-30, 10))
    d = d.filter(F.col("n") > S.HAC_PRIMARY_LAG + 1)
    t = hac_columns(F.col("ab"), S.HAC_PRIMARY_LAG)["t_hac"]
    return d.select("series_id", "event_date", "n", "cas", F.col("t_stat").alias("t_naive"), t.alias("t_hac"))


def placebo_summary(table: DataFrame) -> DataFrame:
    a = F.abs("t_hac")
    return table.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n_dates"), F.avg(a).alias("mean_abs_t"), F.max(a).alias("max_abs_t"),
        F.percentile(a, 0.5).alias("median_abs_t"), F.percentile(a, 0.95).alias("q95_abs_t"),
        F.count_if(a > S.FIXED_B_CRITICAL).alias("n_beyond"),
        (F.count_if(a > S.FIXED_B_CRITICAL) / F.count(F.lit(1))).alias("share_beyond"))


def placebo_p(table: DataFrame, observed: DataFrame) -> DataFrame:
    """Empirical p of each event against all placebo dates of its series: share of placebo t at least as large. Both are ranked
    in one order per series, so dates and events do not meet in pairs."""
    placebo = table.select("series_id", "t_hac", F.lit(1).alias("_n"), F.lit(None).cast("string").alias("event"))
    both = placebo.unionByName(observed.select("series_id", "t_hac", F.lit(0).alias("_n"), "event"))
    every = Window.partitionBy("series_id")

    def share(t):
        down = every.orderBy(F.desc(t), F.desc("_n")).rowsBetween(Window.unboundedPreceding, 0)  # on ties placebo dates count
        return F.sum("_n").over(down) / F.sum("_n").over(every)

    ranked = both.select("series_id", "event", "_n", share(F.col("t_hac")).alias("p_one_sided"), share(F.abs("t_hac")).alias("p_two_sided"))
    return ranked.filter((F.col("_n") == 0) & F.col("p_one_sided").isNotNull()).drop("_n")


def backtest(series: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Per event: first, peak and last value, band at the peak, channels at the peak and the pass rule."""
    w = series.join(ev.unfold(events, before, after), "ds")
    at = F.struct(*S.CHANNELS)
    g = w.groupBy("series_id", "event", "expected_level", "key_channels").agg(
        F.min_by("idx", "ds").alias("first"), F.max("idx").alias("peak"), F.max_by("idx", "ds").alias("last"),
        F.max_by(at, F.struct("idx", -F.col("rel"))).alias("at_peak"))
    rank = lambda c: F.array_position(F.array(*[F.lit(b) for b in S.BAND_ORDER]), c)
    g = g.withColumn("peak_alert", fn.alert_five("peak"))
    passed = (rank(F.col("peak_alert")) >= rank(F.col("expected_level")) - 1) & (F.col("peak") > F.lit(1.1) * F.col("first"))
    values = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"at_peak.{c}").alias("v")) for c in S.CHANNELS])
    elevated = F.transform(F.filter(values, lambda p: F.array_contains("key_channels", p["name"]) & (p["v"] > 60)), lambda p: p["name"])
    return g.withColumn("passed", passed).withColumn("elevated_channels", elevated)


def walk_forward(series: DataFrame, events: DataFrame, q: float = 0.9, gap: int = 90, window: int = 30, least: int = 60) -> DataFrame:
    """Threshold = quantile of all history before event - gap; detection and lead in [event - window, event).

    History sets are nested, so the quantile of each is read from the expanding one at its last row instead of copying
    the history once per event.
    """
    hist = expanding_quantiles(series.select("series_id", "ds", "idx"), ["idx"], q)
    hist = hist.select("series_id", "ds", F.col("q_idx").alias("thr"), F.col("n").alias("n_train"))
    e = events.select("event", "event_date")
    # the last history row before the cut lies within a year of it
    cut = ev.unfold(e, gap + 366, -(gap + 1)).select("event", "event_date", "ds")
    at = hist.join(cut, "ds").groupBy("series_id", "event", "event_date").agg(
        F.max_by("thr", "ds").alias("threshold"), F.max("n_train").alias("n_train")).filter(F.col("n_train") >= least)
    test = ev.event_window(series.select("series_id", "ds", "idx"), e, window, -1)
    j = test.join(at.select("series_id", "event", "threshold", "n_train"), ["series_id", "event"])
    hit = F.col("idx") >= F.col("threshold")
    return j.groupBy("series_id", "event").agg(
        F.first("threshold").alias("threshold"), F.first("n_train").alias("n_train"), F.max("idx").alias("peak"), F.max(hit).alias("detected"),
        F.coalesce(F.max(F.when(hit, -F.col("rel"))), F.lit(0)).alias("lead"))
