"""Index composition: linear, CES, geometric, extreme, correlation-weighted, tail-boosted; method comparison."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stressloom import schema as S
from stressloom.operators import eventjoin as ev
from stressloom.operators import grids

WEIGHTS = list(S.CHANNEL_WEIGHTS.values())
FLOOR = 1e-6


def _add(xs) -> Column:
    return reduce(lambda a, b: a + b, xs)


def linear(weights=None, normalise: bool = False) -> Column:
    w = list(weights or WEIGHTS)
    if normalise:
        w = grids.renormalise(w)
    return _add(F.lit(float(a)) * F.col(c) for a, c in zip(w, S.CHANNELS))


def geometric(weights=None) -> Column:
    w = weights or WEIGHTS
    return F.exp(_add(F.lit(float(a)) * F.log(F.greatest(F.col(c), F.lit(FLOOR))) for a, c in zip(w, S.CHANNELS)))


def ces(rho: float | Column, weights=None) -> Column:
    """(sum w x^rho)^(1/rho) with x floored; the geometric mean near rho = 0."""
    w = weights or WEIGHTS
    r = rho if isinstance(rho, Column) else F.lit(float(rho))
    body = _add(F.lit(float(a)) * F.pow(F.greatest(F.col(c), F.lit(FLOOR)), r) for a, c in zip(w, S.CHANNELS))
    if not isinstance(rho, Column):
        return geometric(w) if abs(rho) < FLOOR else F.pow(body, F.lit(1.0 / rho))
    return F.when(F.abs(r) < FLOOR, geometric(w)).otherwise(F.pow(body, 1.0 / r))


def extreme(mode: str = "max") -> Column:
    hi, lo = F.greatest(*S.CHANNELS), F.least(*S.CHANNELS)
    return {"max": hi, "min": lo, "range": hi - lo}[mode]


def row_methods() -> dict[str, Column]:
    return {
        "linear": linear(), "ces_0.5": ces(0.5), "ces_0": ces(0.0), "ces_-0.5": ces(-0.5), "ces_-1": ces(-1.0),
        "geometric": geometric(), "max": extreme("max"),
    }


def methods_wide(panel: DataFrame, names: list[str], keep=()) -> DataFrame:
    m = row_methods()
    return panel.select("series_id", "ds", *keep, *[m[n].alias(n) for n in names])


def load_methods(panel: DataFrame, names: list[str]) -> DataFrame:
    """Long frame (series_id, ds, method, value); every method is computed in the same scan."""
    m = row_methods()
    cells = F.array(*[F.struct(F.lit(n).alias("method"), m[n].alias("value")) for n in names])
    return panel.select("series_id", "ds", F.inline(cells))


def detection(long: DataFrame, events: DataFrame, keys: list[str], threshold, days: int = 30) -> DataFrame:
    """Per key and event: did the value reach the threshold in [event - days, event), and how early."""
    w = long.join(ev.unfold(events.select("event", "event_date"), days, -1), "ds")
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit = F.col("value") >= thr
    return w.groupBy(*keys, "event").agg(
        F.max("value").alias("peak"), F.max(hit).alias("detected"),
        F.coalesce(F.max(F.when(hit, -F.col("rel"))), F.lit(0)).alias("lead"))


def detection_summary(det: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count_if("detected")
    return det.groupBy(*keys).agg(
        n.alias("n_detected"),
        F.coalesce(F.sum(F.when(F.col("detected"), F.col("lead"))) / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("avg_lead"))


def compare_methods(panel: DataFrame, events: DataFrame, threshold: float = 50.0) -> DataFrame:
    long = load_methods(panel, list(row_methods()))
    keys = ["series_id", "method"]
    stats = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("max_value"),
        F.min("value").alias("min_value"), F.skewness("value").alias("skew"))
    det = detection_summary(detection(long, events, keys, threshold), keys)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return stats.join(det, keys, "left").select(*keys, "mean", "std", "max_value", "min_value", "skew", zero("n_detected"), zero("avg_lead"))


def fit_ces_rho(panel: DataFrame, events: DataFrame, threshold: float = 50.0, lo: float = -2.0, hi: float = 1.0, points: int = 50) -> DataFrame:
    """Best rho on an even grid: most detections, then longest mean lead, then smallest rho. Only rows inside event
    windows meet the grid."""
    grid = [dict(k=i, rho=lo + (hi - lo) * i / (points - 1)) for i in range(points)]
    near = panel.join(ev.unfold(events.select("event", "event_date"), 30, -1), "ds")
    g = grids.explode_grid(near, grid).withColumn("value", ces(F.col("rho")))
    hit = F.col("value") >= threshold
    keys = ["series_id", "k", "rho"]
    det = g.groupBy(*keys, "event").agg(F.max(hit).alias("detected"), F.coalesce(F.max(F.when(hit, -F.col("rel"))), F.lit(0)).alias("lead"))
    s = detection_summary(det, keys)
    score = F.when(F.col("n_detected") == 0, F.lit(-1000.0)).otherwise(F.col("n_detected") * 100.0 + F.col("avg_lead"))
    s = s.withColumn("score", score)
    rn = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("score"), "k"))
    return s.withColumn("_rn", rn).filter("_rn = 1").select("series_id", "rho", "n_detected", "avg_lead", "score")


def crisis_metrics(long: DataFrame, events: DataFrame, threshold: float = 70.0, before: int = 30, baseline: int = 60) -> DataFrame:
    """Per method and event: detection above the threshold, lead, peak, abnormal sum against the baseline, t."""
    w = long.join(ev.unfold(events.select("event", "event_date"), before + baseline, -1), "ds")
    v, pre = F.col("value"), F.col("rel") >= -before
    hit = pre & (v > threshold)
    g = w.groupBy("series_id", "event", "method").agg(
        F.count_if(hit).alias("_hits"), F.max(F.when(hit, -F.col("rel"))).alias("_lead"), F.max(F.when(pre, v)).alias("peak"),
        F.sum(F.when(pre, v)).alias("_sum"), F.count_if(pre).alias("_n"), F.avg(F.when(~pre, v)).alias("_mu"),
        F.stddev_samp(F.when(~pre, v)).alias("_sd"), F.count_if(~pre).alias("_nb"))
    g = g.filter((F.col("_nb") >= 10) & (F.col("_n") >= 5))
    cas = F.col("_sum") - F.col("_n") * F.col("_mu")
    se = F.when(F.col("_sd") > 0, F.col("_sd") * F.sqrt("_n")).otherwise(1.0)
    return g.select("series_id", "event", "method", (F.col("_hits") > 0).cast("int").alias("detected"),
                    F.coalesce("_lead", F.lit(0)).alias("lead_time"), "peak", cas.alias("cas"), (cas / se).alias("t_stat"))


def method_summary(metrics: DataFrame) -> DataFrame:
    g = metrics.groupBy("method").agg(F.avg("detected").alias("detected"), F.avg("lead_time").alias("lead"),
                                      F.avg("t_stat").alias("t"), F.avg("peak").alias("peak"))
    return g.withColumn("detection_rank", F.rank().over(Window.orderBy(F.desc(F.round("detected", 9)))))


PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]
BLOCK = 256


def ewma_products(panel: DataFrame, lam: float = 0.94, warmup: int = 30) -> DataFrame:
    """Exponentially weighted covariance of channel changes, ten products c_ij per row.

    The first `warmup` changes give a running mean; afterwards c = lam*c + (1-lam)*x. The recursion is unrolled into
    block-wise prefix sums: inside a block the decay is factored out, and earlier blocks enter through lags. Lags stop
    where lam^(BLOCK*k) is below double precision, so nothing of the recursion is lost.
    """
    w = Window.partitionBy("series_id").orderBy("ds")
    diffs = panel.select("series_id", "ds", *S.CHANNELS, *[(F.col(c) - F.lag(c).over(w)).alias(f"_d{i}") for i, c in enumerate(S.CHANNELS)])
    t = F.row_number().over(w) - 2  # zero-based position among the changes; -1 for the first row
    d = diffs.withColumn("_t", t).select(
        "series_id", "ds", "_t", *S.CHANNELS, *[(F.col(f"_d{i}") * F.col(f"_d{j}")).alias(f"o{i}{j}") for i, j in PAIRS])
    last = warmup - 1
    grow = w.rowsBetween(Window.unboundedPreceding, 0)
    names = [f"{i}{j}" for i, j in PAIRS]
    run = d.select("*", *[F.avg(f"o{n}").over(grow).alias(f"m{n}") for n in names])
    seed = lambda n: F.when(F.col("_t") == last, F.col(f"m{n}") / (1 - lam)).when(F.col("_t") > last, F.col(f"o{n}")).otherwise(0.0)
    pos = F.greatest(F.col("_t") - last, F.lit(0))
    run = run.select("*", F.floor(pos / BLOCK).alias("_blk"), (pos % BLOCK).alias("_off"))
    run = run.select("*", *[(seed(n) * F.pow(F.lit(lam), -F.col("_off"))).alias(f"s{n}") for n in names])
    wb = Window.partitionBy("series_id", "_blk").orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    run = run.select("*", *[F.sum(f"s{n}").over(wb).alias(f"p{n}") for n in names])
    back, k = [], 0
    while lam ** (BLOCK * k) > 1e-18:
        back.append(lam ** (BLOCK * k + BLOCK - 1))
        k += 1
    # the total of the block i+1 back is a range frame over block numbers, so nothing is joined
    block = [Window.partitionBy("series_id").orderBy("_blk").rangeBetween(-i - 1, -i - 1) for i in range(len(back))]
    out = run.select("*", *[_add(F.coalesce(F.sum(f"s{n}").over(w), F.lit(0.0)) * f for w, f in zip(block, back)).alias(f"b{n}") for n in names])
    dec = lambda n: (F.col(f"p{n}") * F.pow(F.lit(lam), F.col("_off")) + F.col(f"b{n}") * F.pow(F.lit(lam), F.col("_off") + 1)) * (1 - lam)
    return out.select("series_id", "ds", *S.CHANNELS, *[
        F.when(F.col("_t") < 0, F.lit(None)).when(F.col("_t") <= last, F.col(f"m{n}")).otherwise(dec(n)).alias(f"c{n}") for n in names])


def correlation_from(i: int, j: int, shrink: float = 0.01) -> Column:
    """Clipped correlation from the covariance columns, shrunk towards the identity."""
    den = F.sqrt(F.col(f"c{i}{i}") * F.col(f"c{j}{j}"))
    r = F.when(den > 0, F.col(f"c{i}{j}") / den).otherwise(0.0)
    return F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)) * (1 - shrink)


def portfolio(panel: DataFrame, lam: float = 0.94) -> DataFrame:
    """sqrt(max(0, s'Cs)) with s the weighted channels and C the correlation of that day."""
    e = ewma_products(panel, lam)
    s = [F.col(c) * F.lit(a) for c, a in zip(S.CHANNELS, WEIGHTS)]
    offs = [(i, j) for i, j in PAIRS if i < j]
    var = _add(x * x for x in s) + 2.0 * _add(s[i] * s[j] * correlation_from(i, j) for i, j in offs)
    mean = _add(correlation_from(i, j) for i, j in offs) / len(offs)
    known = F.col("c00").isNotNull()
    return e.select("series_id", "ds", F.when(known, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("value"), linear().alias("linear"),
                    F.when(known, mean).alias("mean_correlation"), *[F.when(known, correlation_from(i, j)).alias(f"r{i}{j}") for i, j in offs])


def expanding_scale(x: str, keys=("series_id",)) -> Column:
    """100*(x-min)/(max-min) against the history so far; null while the range is empty."""
    w = Window.partitionBy(*keys).orderBy("ds").rowsBetween(Window.unboundedPreceding, 0)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, 100.0 * (F.col(x) - lo) / (hi - lo))


def fixed_scale(x: str, keys=("series_id",)) -> Column:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, 100.0 * (F.col(x) - lo) / (hi - lo)).otherwise(50.0)


def tail_days(panel: DataFrame, q: float = 0.90, least: int = 30) -> DataFrame:
    """Any channel above its own expanding quantile, current row included."""
    from stressloom.operators.rolling import expanding_quantiles

    d = expanding_quantiles(panel, S.CHANNELS, q)
    over = reduce(lambda a, b: a | b, [F.col(c) > F.col("q_" + c) for c in S.CHANNELS])
    return d.select(*panel.columns, ((F.col("n") >= least) & over).alias("tail"))


def tail_boost(panel: DataFrame, lam_col: str, q: float = 0.90, boost: float = 1.5) -> DataFrame:
    """Weights grow with the channel level on tail days and are renormalised; base weights otherwise."""
    t = tail_days(panel, q)
    bw = [F.lit(a) * (1.0 + boost * F.col(lam_col) * F.col(c) / 100.0) for a, c in zip(WEIGHTS, S.CHANNELS)]
    boosted = _add(b * F.col(c) for b, c in zip(bw, S.CHANNELS)) / _add(bw)
    return t.withColumn("value", F.when(F.col("tail"), boosted).otherwise(linear()))


# Five-point Gauss-Legendre nodes and weights on [-1, 1].
GAUSS_NODES = [-0.9061798459386640, -0.5384693101056831, 0.0, 0.5384693101056831, 0.9061798459386640]
GAUSS_WEIGHTS = [0.2369268850561891, 0.4786286704993665, 0.5688888888888889, 0.4786286704993665, 0.2369268850561891]


def debye(theta: Column, panels: int = 8) -> Column:
    """(1/theta) * integral of t/(e^t - 1) on [0, |theta|] by composite Gauss-Legendre."""
    a = F.abs(theta)
    h = a / panels
    terms = []
    for p in range(panels):
        for x, w in zip(GAUSS_NODES, GAUSS_WEIGHTS):
            t = h * (p + (x + 1.0) / 2.0)
            terms.append(F.lit(w / 2.0) * t / F.expm1(t))
    return F.when(a < 1e-10, F.lit(1.0)).otherwise(_add(terms) * h / a)


def family_fit(tau: Column, family: str) -> dict[str, Column]:
    """Moment fit of one family from mean tau: parameter, lower and upper tail coefficient, implied tau."""
    if family == "clayton":
        t = F.when(tau >= 1, 0.99).when(tau < 0, 0.01).otherwise(tau)
        th = F.greatest(F.lit(0.01), 2.0 * t / (1.0 - t))
        return dict(theta=th, lambda_l=F.pow(F.lit(2.0), -1.0 / th), lambda_u=F.lit(0.0), tau=th / (th + 2.0))
    if family == "gumbel":
        t = F.when(tau >= 1, 0.99).otherwise(tau)
        th = F.greatest(F.lit(1.0), 1.0 / (1.0 - t))
        return dict(theta=th, lambda_l=F.lit(0.0), lambda_u=2.0 - F.pow(F.lit(2.0), 1.0 / th), tau=1.0 - 1.0 / th)
    th = F.when(tau < 1, 3.0 * tau / (1.0 - tau)).otherwise(10.0)
    implied = F.when(F.abs(th) > 0.01, 1.0 - 4.0 / th * (1.0 - debye(th))).otherwise(0.0)
    return dict(theta=th, lambda_l=F.lit(0.0), lambda_u=F.lit(0.0), tau=implied)


def mean_tau(panel: DataFrame, least: int = 50) -> DataFrame:
    from stressloom.operators import aggregates as ag

    taus = ag.kendall(ag.channel_pairs(panel, ["series_id"]), ["series_id", "ch_a", "ch_b"])
    g = taus.groupBy("series_id").agg(F.avg("tau").alias("tau"), F.max("n").alias("n"))
    return g.filter(F.col("n") >= least).withColumn("tau", F.coalesce("tau", F.lit(0.3)))


def fit_families(panel: DataFrame, families=("clayton", "gumbel", "frank")) -> DataFrame:
    m = mean_tau(panel)
    cells = []
    for f in families:
        fit = family_fit(F.col("tau"), f)
        cells.append(F.struct(F.lit(f).alias("family"), *[fit[k].cast("double").alias(n) for k, n in
                     (("theta", "theta"), ("lambda_l", "lambda_l"), ("lambda_u", "lambda_u"), ("tau", "implied_tau"))]))
    return m.select("series_id", "n", "tau", F.inline(F.array(*cells)))


def normalise_scales(long: DataFrame, how: str, reference: str | None = None) -> DataFrame:
    from stressloom.operators import aggregates as ag

    keys = ["series_id", "method"]
    if how == "minmax":
        return long.withColumn("scaled", fixed_scale("value", keys))
    w = Window.partitionBy(*keys)
    if how == "zscore":
        sd = F.stddev_samp("value").over(w)
        return long.withColumn("scaled", F.when(sd > 0, (F.col("value") - F.avg("value").over(w)) / sd).otherwise(0.0))
    if how == "quantile":
        d = long.withColumn("_r", F.round("value", 9))  # equal up to the order of summation counts as a tie
        return d.withColumn("scaled", 100.0 * ag.average_rank("_r", keys) / F.count("value").over(w)).drop("_r")
    ref = long.filter(F.col("method") == reference).groupBy("series_id").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_samp("value").over(w), F.lit(0.0))
    return long.withColumn("_z", z).join(ref, "series_id").withColumn("scaled", F.coalesce("_z", F.lit(0.0)) * F.col("_s") + F.col("_m")).drop("_z", "_m", "_s")


def out_of_sample(long: DataFrame, split: str, crisis: str, threshold: float = 50.0, before: int = 30) -> DataFrame:
    """Train and test moments per method, detection in the test part before the given date."""
    sp, cr = F.lit(split).cast("date"), F.lit(crisis).cast("date")
    test = F.col("ds") > sp
    pre = test & (F.col("ds") >= F.date_sub(cr, before)) & (F.col("ds") < cr)
    v = F.col("value")
    hit = pre & (v > threshold)
    return long.groupBy("series_id", "method").agg(
        F.max(hit).alias("detected"), F.datediff(cr, F.min(F.when(hit, F.col("ds")))).alias("lead"), F.max(F.when(pre, v)).alias("peak"),
        F.avg(F.when(~test, v)).alias("train_mean"), F.stddev_samp(F.when(~test, v)).alias("train_std"),
        F.avg(F.when(test, v)).alias("test_mean"), F.stddev_samp(F.when(test, v)).alias("test_std"))
