"""Sensitivity, ablation, walk-forward and lag studies. Grids are exploded next to rows that can matter (event windows)
or folded into one partial aggregation; nothing loops over grid points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stressloom.functions.stats import corr
from stressloom import schema as S
from stressloom.functions import scoring as fn
from stressloom.operators import aggregates as ag
from stressloom.operators import classify, compose, grids, paths
from stressloom.operators import eventjoin as ev
from stressloom.operators.windows import by_day, day_range


def threshold_table(series: DataFrame, events: DataFrame, thresholds: list[float], days: int = 30) -> DataFrame:
    """Per threshold: alerts are idx > t; an alert is true when an event follows within (0, days]; an event is found
    when any alert precedes it that closely. One pass marks each date, one aggregation counts all thresholds."""
    ahead = ev.unfold(events.select("event", "event_date"), days, -1)
    marks = ahead.groupBy("ds").agg(F.collect_set("event").alias("_ev"))
    n_events = events.count()  # a parameter table
    d = series.select("series_id", "ds", "idx").join(marks, "ds", "left")
    g = grids.explode_grid(d, [dict(threshold=t) for t in thresholds])
    on, pre = F.col("idx") > F.col("threshold"), F.col("_ev").isNotNull()
    a = g.groupBy("series_id", "threshold").agg(
        F.count_if(on).alias("alerts"), F.count_if(on & pre).alias("true_alerts"), F.count_if(~on).alias("quiet"),
        F.count_if(~on & ~pre).alias("true_quiet"), F.array_distinct(F.flatten(F.collect_set(F.when(on, F.col("_ev"))))).alias("_hit"))
    div = lambda x, y: F.coalesce(x / F.nullif(y, F.lit(0)), F.lit(0.0))
    p, r = div(F.col("true_alerts"), F.col("alerts")), div(F.size("_hit"), F.lit(n_events))
    a = a.withColumn("precision", p).withColumn("recall", r)
    pr = F.col("precision") + F.col("recall")
    f1 = F.coalesce(2.0 * F.col("precision") * F.col("recall") / F.nullif(pr, F.lit(0.0)), F.lit(0.0))
    return a.select("series_id", "threshold", "alerts", "precision", "recall", f1.alias("f1"), div(F.col("true_quiet"), F.col("quiet")).alias("specificity"))


def best_by(df: DataFrame, keys: list[str], score: str, grid_key: str) -> DataFrame:
    """Row with the highest score; the smallest grid key on ties."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.round(score, 12)), grid_key)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def window_table(df: DataFrame, ret: str, score: str, widths: list[int], drawdown: float = -0.20, alert: float = 70.0) -> DataFrame:
    """AUC, F1 at the alert level and mean lead of crisis starts, for several forward widths in one pass."""
    d, w = df, by_day()
    cells = []
    for k in widths:
        d = paths.forward_labels(d, ret, k, drawdown).withColumnRenamed("label", f"_y{k}").drop("drawdown")
        first_alert = F.min(F.when(F.col(score) >= alert, F.col("ds"))).over(day_range(-k, -1))
        d = d.withColumn(f"_l{k}", F.coalesce(F.datediff("ds", first_alert), F.lit(0)))
    for k in widths:
        d = d.withColumn(f"_s{k}", (F.col(f"_y{k}") == 1) & (F.coalesce(F.lag(f"_y{k}").over(w), F.lit(0)) == 0))
        cells.append(F.struct(F.lit(k).alias("width"), F.col(f"_y{k}").alias("label"), F.col(f"_l{k}").alias("lead"), F.col(f"_s{k}").alias("start")))
    long = d.select("series_id", F.col(score).alias("score"), F.inline(F.array(*cells)))
    keys = ["series_id", "width"]
    c = classify.curve(long, keys)
    auc = c.groupBy(*keys).agg(classify.auroc().alias("auc"))
    rest = ag.confusion(long, keys, "label", F.col("score") >= alert).select(*keys, "f1")
    lead = long.groupBy(*keys).agg(F.coalesce(F.avg(F.when(F.col("start"), F.col("lead"))), F.lit(0.0)).alias("lead"))
    return auc.join(rest, keys).join(lead, keys)


def perturbed(base: dict, name: str, delta: float) -> list[float]:
    w = {k: (min(max(v + delta, 0.01), 0.99) if k == name else v) for k, v in base.items()}
    return grids.renormalise(list(w.values()))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def weight_table(panel: DataFrame, events: DataFrame, lo: float = -0.15, hi: float = 0.15, steps: int = 7, threshold: float = 70.0, days: int = 30) -> DataFrame:
    """Moments and detection rate per perturbed weight vector."""
    grid = [dict(channel=c, step=i, delta=x, w=perturbed(S.CHANNEL_WEIGHTS, c, x)) for c in S.CHANNELS for i, x in enumerate(linspace(lo, hi, steps))]
    keys = ["series_id", "channel", "step", "delta"]
    moments = grids.explode_grid(panel, grid).groupBy(*keys).agg(
        F.avg(grids.grid_index()).alias("mean"), F.stddev_samp(grids.grid_index()).alias("std"), F.max(grids.grid_index()).alias("max"))
    near = panel.join(ev.unfold(events.select("event", "event_date"), days, -1), "ds")
    hit = grids.explode_grid(near, grid).groupBy(*keys, "event").agg(F.max(F.round(grids.grid_index(), 9) >= threshold).alias("hit"))
    n = hit.groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias("detection_rate"))
    return moments.join(n, keys, "left")


def weight_summary(table: DataFrame) -> DataFrame:
    best = F.max_by("delta", F.struct("detection_rate", -F.col("step")))
    g = table.groupBy("series_id", "channel").agg((F.max("detection_rate") - F.min("detection_rate")).alias("range"), best.alias("best_delta"), F.max("detection_rate").alias("best_rate"))
    return g.withColumn("robust", F.col("range") < 0.15)


def ablation(panel: DataFrame, events: DataFrame, threshold: float = 50.0, days: int = 30) -> DataFrame:
    """Leave one channel out: detection, lead, change against the baseline, role of the channel."""
    grid = [dict(dropped="none", w=list(S.CHANNEL_WEIGHTS.values()))] + [dict(dropped=c, w=grids.ablated_weights(S.CHANNEL_WEIGHTS, c)) for c in S.CHANNELS]
    near = panel.join(ev.unfold(events.select("event", "event_date"), days, -1), "ds")
    g = grids.explode_grid(near, grid).withColumn("value", grids.grid_index())
    hit = F.col("value") >= threshold
    det = g.groupBy("series_id", "dropped", "event").agg(F.max(hit).alias("detected"), F.coalesce(F.max(F.when(hit, -F.col("rel"))), F.lit(0)).alias("lead"))
    s = compose.detection_summary(det, ["series_id", "dropped"]).join(
        det.groupBy("series_id", "dropped").agg(F.count(F.lit(1)).alias("n_events")), ["series_id", "dropped"])
    w = Window.partitionBy("series_id")
    base = lambda c: F.max(F.when(F.col("dropped") == "none", F.col(c))).over(w)
    s = s.withColumn("lead_delta", F.col("avg_lead") - base("avg_lead"))
    s = s.withColumn("importance", (base("n_detected") - F.col("n_detected")) / F.col("n_events"))
    role = F.when(F.col("dropped") == "none", "baseline").when(F.col("importance") > 0, "critical").otherwise("redundant")
    return s.withColumn("role", role).drop("n_events")


DURATIONS = [("short", 0.25), ("mixed", 0.5), ("moderate", 1.0), ("extended", 2.0), ("long", 5.0)]  # fixed values, years


def duration_table(panel: DataFrame, yields: DataFrame, events: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Channel and index under other average durations; days without a yield keep the default of 50."""
    d = panel.join(yields.select("ds", "yield"), "ds", "left")
    d = d.join(ev.unfold(events.select("event", "event_date"), 30, -1).select("ds", "event"), "ds", "left")
    g = grids.explode_grid(d, [dict(scenario=n, duration=x) for n, x in DURATIONS])
    risk = lambda y: F.coalesce(fn.duration_risk("yield", y), F.lit(50.0))
    g = g.withColumn("channel", F.col("stablecoin_risk") + 0.3 * (risk(F.col("duration")) - risk(0.25)))
    rest = sum((F.lit(S.CHANNEL_WEIGHTS[c]) * F.col(c) for c in S.CHANNELS[1:]), F.lit(S.CHANNEL_WEIGHTS["stablecoin_risk"]) * F.col("channel"))
    g = g.withColumn("value", rest)
    found = F.countDistinct(F.when(F.col("value") >= threshold, F.col("event")))
    return g.groupBy("series_id", "scenario").agg(
        F.avg("channel").alias("channel_mean"), F.stddev_samp("channel").alias("channel_std"), F.max("channel").alias("channel_max"),
        F.avg("value").alias("idx_mean"), F.stddev_samp("value").alias("idx_std"), F.max("value").alias("idx_max"), found.alias("detections"))


CHANNEL_SOURCE = {"stablecoin_risk": "stablecoins", "defi_liquidity_risk": "tvl", "contagion_risk": "treasury", "arbitrage_opacity": "news"}


def lag_impact(panel: DataFrame, events: DataFrame, threshold: float = 50.0, before: int = 5, after: int = 9) -> DataFrame:
    """Each channel replaced by its last value already published at the day; peak loss, lead change, detection kept."""
    lagged = {}
    for c in S.CHANNELS:
        days = -(-S.PUBLICATION_LAG_HOURS[CHANNEL_SOURCE[c]] // 24)
        lagged[c] = F.last(c, ignorenulls=True).over(day_range(-100000, -days))
    d = panel.select("series_id", "ds", F.col("idx").alias("now"), *[lagged[c].alias(c) for c in S.CHANNELS])
    d = d.withColumn("late", fn.composite()).drop(*S.CHANNELS)
    w = d.join(ev.unfold(events.select("event", "event_date"), before, after), "ds")
    lead = lambda c: F.coalesce(-F.min(F.when(F.col(c) >= threshold, F.col("rel"))), F.lit(0))
    g = w.groupBy("series_id", "event").agg(F.max("now").alias("peak"), F.max("late").alias("late_peak"), lead("now").alias("_a"), lead("late").alias("_b"))
    loss = F.when(F.col("peak") > 0, (F.col("peak") - F.col("late_peak")) / F.col("peak") * 100.0).otherwise(0.0)
    kept = F.when(F.col("peak") >= threshold, F.col("late_peak") >= threshold).otherwise(F.lit(True))
    return g.select("series_id", "event", "peak", "late_peak", loss.alias("loss_percent"), (F.col("_b") - F.col("_a")).alias("lead_change"), kept.alias("kept"))


def purged_folds(df: DataFrame, n_splits: int = 5, purge: int = 30, least_train: int = 365, expanding: bool = True) -> DataFrame:
    """Fold bounds per series by row position: backward test folds, a purge gap, expanding or capped training."""
    n = df.groupBy("series_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    size = F.floor((F.col("n") - least_train - purge) / n_splits).cast("int")
    f = n.withColumn("_size", size).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    f = f.withColumn("test_end", F.col("n") - F.col("fold") * F.col("_size")).withColumn("test_start", F.col("test_end") - F.col("_size"))
    f = f.withColumn("train_end", F.col("test_start") - purge)
    start = F.lit(0) if expanding else F.greatest(F.lit(0), F.col("train_end") - F.least(F.col("train_end"), F.lit(2 * least_train)))
    f = f.withColumn("train_start", start)
    ok = (F.col("n") - least_train - purge >= n_splits) & (F.col("test_start") >= least_train + purge) & (F.col("train_end") - F.col("train_start") >= least_train)
    return f.filter(ok).select("series_id", "fold", "train_start", "train_end", "test_start", "test_end")


def fold_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with (fold, split); zero-based half-open positions. The few folds of a series sit next to each row."""
    pos = df.withColumn("_p", F.row_number().over(by_day()) - 1)
    packed = folds.groupBy("series_id").agg(F.collect_list(F.struct("fold", "train_start", "train_end", "test_start", "test_end")).alias("_f"))
    d = pos.join(packed, "series_id").withColumn("_x", F.explode("_f"))
    p = F.col("_p")
    split = F.when((p >= F.col("_x.train_start")) & (p < F.col("_x.train_end")), "train").when((p >= F.col("_x.test_start")) & (p < F.col("_x.test_end")), "test")
    return d.withColumn("fold", F.col("_x.fold")).withColumn("split", split).filter(F.col("split").isNotNull()).drop("_p", "_f", "_x")


def fit_scores(df: DataFrame, keys: list[str], pred: str = "pred", target: str = "target") -> DataFrame:
    """n, R2, MSE per key; R2 = 1 - SSE/SST, 0 without variation."""
    e = F.col(target) - F.col(pred)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.var_pop(target).alias("_v"), F.countDistinct(target).alias("n_distinct"))
    r2 = F.coalesce(1.0 - F.col("_sse") / F.nullif(F.col("_v") * F.col("n"), F.lit(0.0)), F.lit(0.0))
    return g.select(*keys, "n", r2.alias("r2"), (F.col("_sse") / F.col("n")).alias("mse"), "n_distinct")


def rank_correlation(df: DataFrame, keys: list[str], x: str = "pred", y: str = "target") -> DataFrame:
    r = df.select(*keys, ag.average_rank(x, keys).alias("_x"), ag.average_rank(y, keys).alias("_y"))
    return r.groupBy(*keys).agg(corr("_x", "_y").alias("spearman"))


def walk_forward(df: DataFrame, n_splits: int = 5, purge: int = 30) -> DataFrame:
    """Per fold: train and test R2, test MSE, |Spearman| when the test target has at most ten values."""
    rows = fold_rows(df, purged_folds(df, n_splits, purge))
    s = fit_scores(rows, ["series_id", "fold", "split"])
    test = rows.filter(F.col("split") == "test")
    rho = rank_correlation(test, ["series_id", "fold"])
    side = lambda k: s.filter(F.col("split") == k)
    out = side("test").select("series_id", "fold", F.col("n").alias("test_n"), F.col("r2").alias("test_r2"), F.col("mse").alias("test_mse"), "n_distinct")
    out = out.join(side("train").select("series_id", "fold", F.col("r2").alias("train_r2")), ["series_id", "fold"]).join(rho, ["series_id", "fold"])
    return out.withColumn("test_rho", F.when(F.col("n_distinct") <= 10, F.abs("spearman"))).drop("n_distinct", "spearman")


def holdout(df: DataFrame, split: str) -> DataFrame:
    """Train and test fit before and after a date, and the loss between them."""
    d = df.withColumn("part", F.when(F.col("ds") <= F.lit(split).cast("date"), "train").otherwise("test"))
    keys = ["series_id", "part"]
    s = fit_scores(d, keys).drop("n_distinct").join(rank_correlation(d, keys), keys)
    side = lambda k: s.filter(F.col("part") == k).select("series_id", *[F.col(c).alias(f"{k}_{c}") for c in ("n", "r2", "mse", "spearman")])
    return side("train").join(side("test"), "series_id").withColumn("degradation", F.col("train_r2") - F.col("test_r2"))


def rolling_validation(df: DataFrame, width: int = 365, step: int = 90) -> DataFrame:
    """Train/test windows by row position: mean shift, error against the last training value, within two deviations.
    A row belongs to at most width/step + 1 windows, unfolded next to it."""
    pos = df.withColumn("_p", F.row_number().over(by_day()) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("series_id")))
    lo = F.greatest(F.lit(0), F.ceil((F.col("_p") - (width + step - 1)) / step)).cast("int")
    hi = F.floor(F.col("_p") / step).cast("int")
    d = pos.withColumn("window", F.explode(F.sequence(lo, hi)))
    d = d.filter(F.col("window") * step < F.col("_n") - width - step)
    off = F.col("_p") - F.col("window") * step
    train = off < width
    x = F.col("idx")
    g = d.groupBy("series_id", "window").agg(
        F.avg(F.when(train, x)).alias("train_mean"), F.stddev_samp(F.when(train, x)).alias("_sd"), F.avg(F.when(~train, x)).alias("test_mean"),
        F.max(F.when(off == width - 1, x)).alias("_last"), F.collect_list(F.when(~train, x)).alias("_t"), F.max(F.when(train, F.col("ds"))).alias("train_end"))
    mae = F.aggregate("_t", F.lit(0.0), lambda s, v: s + F.abs(v - F.col("_last"))) / F.size("_t")
    return g.select("series_id", "window", "train_end", "train_mean", "test_mean", mae.alias("mae"),
                    (F.abs(F.col("test_mean") - F.col("train_mean")) < 2 * F.col("_sd")).alias("within"))


def naive_benchmarks(tvl: DataFrame, vix: DataFrame, seed: int = 42) -> DataFrame:
    """Long frame of simple indices: drawdown of the total, min-max of a second series, momentum, random walk."""
    w, e = by_day(), Window.partitionBy("series_id")
    t = tvl.select("series_id", "ds", "tvl")
    mom = F.col("tvl") / F.lag("tvl", 30).over(w) - 1
    # a normal draw from the row key alone, so that it does not depend on partitioning
    from stressloom.operators.resample import M, draw as drawn

    row = F.datediff("ds", F.lit("1970-01-01").cast("date")) + F.crc32(F.col("series_id").cast("binary")) % 1000003
    u = lambda salt: (drawn(seed, row, F.lit(salt)).cast("double") + 0.5) / float(M)
    draw = F.sqrt(-2.0 * F.log(u(1))) * F.cos(2.0 * 3.141592653589793 * u(2))
    t = t.withColumn("drawdown", 100.0 * (1.0 - F.col("tvl") / F.max("tvl").over(e))).withColumn("momentum", 50.0 - 50.0 * F.least(F.greatest(mom, F.lit(-1.0)), F.lit(1.0)))
    t = t.withColumn("_z", draw).withColumn("_walk", F.sum("_z").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("random_walk", 100.0 * (F.col("_walk") - F.min("_walk").over(e)) / (F.max("_walk").over(e) - F.min("_walk").over(e)))
    long = t.unpivot(["series_id", "ds"], ["drawdown", "momentum", "random_walk"], "model", "score")
    v = vix.withColumn("score", 100.0 * (F.col("value") - F.min("value").over(e)) / (F.max("value").over(e) - F.min("value").over(e)))
    return long.unionByName(v.select("series_id", "ds", F.lit("vix").alias("model"), "score"))


def lead_confirm(panel: DataFrame, events: DataFrame) -> DataFrame:
    """z of the week before and after the onset (first day on or after the event) against days -30..-15 before it."""
    on = ev.event_window(panel.select("series_id", "ds"), events, 0, 30).groupBy("series_id", "event").agg(F.min("ds").alias("event_date"))
    w = ev.unfold(on, 30, 7)
    long = panel.unpivot(["series_id", "ds"], S.CHANNELS, "channel", "value").join(w, ["series_id", "ds"])
    r, v = F.col("rel"), F.col("value")
    g = long.groupBy("series_id", "channel", "event").agg(
        F.count_if(r <= -15).alias("_n"), F.avg(F.when(r <= -15, v)).alias("_mu"), F.stddev_samp(F.when(r <= -15, v)).alias("_sd"),
        F.avg(F.when((r >= -7) & (r <= -1), v)).alias("_pre"), F.avg(F.when(r >= 1, v)).alias("_post"))
    g = g.filter((F.col("_n") >= 3) & (F.col("_sd") > 0))
    z = lambda c: (F.col(c) - F.col("_mu")) / F.col("_sd")
    s = g.groupBy("series_id", "channel").agg(F.avg(z("_pre")).alias("pre_z"), F.avg(z("_post")).alias("post_z"), F.count(F.lit(1)).alias("n_events"))
    return s.withColumn("role", F.when(F.col("pre_z") >= F.col("post_z"), "leading").otherwise("confirming"))


def anomaly_probe(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Window counts, missing share, deviation ratio, peak z and the hypotheses they support, per event."""
    overall = panel.groupBy("series_id").agg(F.stddev_samp("idx").alias("_all"))
    w = ev.event_window(panel.select("series_id", "ds", "idx", "stablecoin_risk"), events, 90, 30)
    r, x = F.col("rel"), F.col("idx")
    est, pre = r <= -31, (r >= -30) & (r <= 0)
    g = w.groupBy("series_id", "event").agg(
        F.count(F.lit(1)).alias("points"), F.stddev_samp(F.when(est, x)).alias("est_std"), F.avg(F.when(est, x)).alias("_mu"),
        F.max(F.when(pre, x)).alias("peak"), F.max(F.when(pre, F.col("stablecoin_risk"))).alias("channel_peak"))
    g = g.join(overall, "series_id")
    g = g.withColumn("missing_percent", (1.0 - F.col("points") / 121.0) * 100.0).withColumn("std_ratio", F.col("est_std") / F.col("_all"))
    g = g.withColumn("peak_z", (F.col("peak") - F.col("_mu")) / F.col("est_std"))
    marks = F.array_compact(F.array(F.when(F.col("std_ratio") < 0.7, "low variance"), F.when(F.col("peak_z") > 5, "extreme signal"), F.when(F.col("channel_peak") > 80, "one channel")))
    return g.select("series_id", "event", "points", "missing_percent", "est_std", "std_ratio", "peak", "peak_z", "channel_peak", F.array_join(marks, ",").alias("hypotheses"))


def best_lead(df: DataFrame, keys: list[str], x: str, y: str, longest: int) -> DataFrame:
    """(keys, abs_spearman, lead, lead_spearman): |rank correlation| of x with y of the same day, and the number of rows (0 to longest) that x
    leads y by where it is highest; of equal ones the shortest."""
    w = Window.partitionBy(*keys).orderBy("ds")
    ahead = F.array(*[F.struct(F.lit(k).alias("lead"), F.lead(y, k).over(w).alias("ahead")) for k in range(longest + 1)])
    long = df.select(*keys, x, ahead.alias("_a")).select(*keys, x, F.inline("_a")).where(F.col("ahead").isNotNull())
    rho = rank_correlation(long, [*keys, "lead"], x, "ahead").select(*keys, "lead", F.round(F.abs("spearman"), 12).alias("rho"))
    best = F.max(F.struct("rho", (-F.col("lead")).alias("less")))
    g = rho.groupBy(*keys).agg(F.max(F.when(F.col("lead") == 0, F.col("rho"))).alias("abs_spearman"), best.alias("_b"))
    return g.select(*keys, "abs_spearman", (-F.col("_b.less")).alias("lead"), F.col("_b.rho").alias("lead_spearman"))
